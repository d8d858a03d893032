"""Language of texts by a byte convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes, the last one filled up with zeros. Over each window run filters of 2, 3
and 4 bytes; the largest response of each filter goes through a softmax. A text's probabilities are the means over its
windows, by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .sampling import labelled_sample
from .tokens import forget

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled documents of each language that training takes, and windows of each document.
SAMPLE, WINDOWS_EACH = 800, 4
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 5
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNetwork:
    """tables[w]: (w, 256, FILTERS), what a byte at each place of a filter adds; out, bias: the softmax layer."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(labels)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(labels)), np.float32)

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest responses (n, filters of all widths), and where they begin."""
        best, where = [], []
        for w, t in zip(WIDTHS, self.tables):
            size = x.shape[1] - w + 1
            response = t[0][x[:, :size]]
            for j in range(1, w):
                response += t[j][x[:, j : j + size]]
            where.append(response.argmax(axis=1))
            best.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        rng, steps = np.random.default_rng(seed), 0
        weights = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                pooled, where = self.pool(x[some])
                p = softmax(pooled @ self.out + self.bias)
                p[np.arange(len(some)), y[some]] -= 1
                p /= len(some)
                back = p @ self.out.T
                grads, rows = [], np.arange(len(some))[:, None]
                for k, w in enumerate(WIDTHS):
                    part, g = slice(k * FILTERS, (k + 1) * FILTERS), np.zeros_like(self.tables[k])
                    for j in range(w):
                        np.add.at(g[j], (x[some][rows, where[:, part] + j], np.arange(FILTERS)[None]), back[:, part])
                    grads.append(g)
                grads += [pooled.T @ p, p.sum(0)]
                steps += 1
                for p_, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p_ -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

    def ready(self) -> None:
        """Tables of two bytes, so that a filter of 4 takes two of them."""
        self.two = [(t[0][:, None] + t[1][None]).reshape(65536, FILTERS) for t in self.tables]
        self.rest = (self.tables[2][2][:, None] + self.tables[2][3][None]).reshape(65536, FILTERS)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """As softmax of pool(), 128 windows at a time."""
        out = []
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            both = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            best = [self.two[0][both].max(axis=1)]
            best.append((self.two[1][both[:, :-1]] + self.tables[1][2][part[:, 2:]]).max(axis=1))
            best.append((self.two[2][both[:, :-2]] + self.rest[both[:, 2:]]).max(axis=1))
            out.append(softmax(np.concatenate(best, 1) @ self.out + self.bias))
        return np.concatenate(out)

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores, held, size = [UNKNOWN] * len(texts), [0.0] * len(texts), [], 0

        def settle():
            x = np.concatenate([w for _, w, _ in held])
            p, at = self.probabilities(x), 0
            for i, w, n in held:
                weight = np.full(len(w), WINDOW, np.float64)
                weight[-1] = max(1, n - WINDOW * (len(w) - 1))
                mean = np.average(p[at : at + len(w)], axis=0, weights=weight)
                at += len(w)
                labels[i], scores[i] = self.labels[int(mean.argmax())], float(min(1.0, mean.max()))
            held.clear()

        for i, text in enumerate(texts):
            if not text or not self.labels or not any(map(str.isalpha, text)):
                continue
            data = text.encode()
            held.append((i, windows_of(data), len(data)))
            size += len(data)
            if size > 4 << 20:
                settle()
                size = 0
        if held:
            settle()
        return labels, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    """From doc_id, text and lang: at most `sample` documents of each language, WINDOWS_EACH windows of each.

    Rows without text, letter or lang are left out. Without rows, the network knows no language and says `und`.
    """
    taken, _ = labelled_sample(labelled.where("lang is not null").select("doc_id", "text", "lang"), "lang", F.col("doc_id"), sample)
    taken = taken[np.array([any(map(str.isalpha, t or "")) for t in taken["text"]], bool)]
    network = ByteNetwork(sorted(set(taken["lang"])))
    rng, x, y = np.random.default_rng(SEED), [], []
    for text, lang in zip(taken["text"], taken["lang"]):
        windows = windows_of(text.encode())
        some = rng.permutation(len(windows))[:WINDOWS_EACH]
        x.append(windows[some])
        y += [network.labels.index(lang)] * len(some)
    if len(network.labels) > 1:
        network.fit(np.concatenate(x), np.array(y))
    return network


def identify(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """doc_id, text, lang_pred, score for every row of docs: only the whole text is looked at.

    Null texts and those without a letter get `und` and score 0. Texts of any length are read window by window;
    repeated rows stay; an empty table gives an empty one.
    """

    def scan(batches):
        forget()
        network.ready()
        for batch in batches:
            labels, scores = network.classify(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(scan), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, network: ByteNetwork, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, of which the network names the language with a score of `least` or more."""
    names, schema = docs.columns, docs.schema

    def keep(batches):
        forget()
        network.ready()
        text = names.index("text")
        for batch in batches:
            labels, scores = network.classify(batch.column(text).to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(trimmed(keep), schema)
