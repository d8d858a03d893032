"""Toxicity of texts by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its character n-grams' vectors, so that a misspelling shares most of them. Vectors are
averaged over windows of SPAN words; the softmax's two classes are clean and toxic, and a text is as toxic as its most
toxic window, so that an insult in a long text counts. As the softmax sees only what an average weighs, each n-gram
comes down to one number once the model is trained.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .sampling import labelled_sample

SIZES, BUCKETS, DIMENSIONS = (3, 4, 5), 1 << 16, 8
SPAN, STEP = 4, 2
#: Labelled documents of each class that training takes.
SAMPLE = 2500
EPOCHS, PLAIN_EPOCHS, RATE, DECAY, SEED = 100, 6, 0.05, 1e-2, 3
#: The share of n-grams that a step of training takes for unknown, as they are in a misspelling.
HIDDEN = 0.6
KEPT_WORDS = 400_000
MARKS = ".,;:!?\"'()[]{}<>«»“”‘’…"


def core(word: str) -> str:
    return word.strip(MARKS).lower() or word


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words in order, and how many each word has. A word's ends are marked."""
    data = [b"<" + w.encode() + b">" for w in words]
    sizes = np.array(list(map(len, data)), np.int64)
    x = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            h = np.full(max(0, len(x) - n + 1), n, np.uint64)
            for j in range(n):
                h = (h ^ x[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = np.arange(len(h)) + n <= ends[: len(h)]
            found.append((h[inside] >> np.uint64(20)).astype(np.int64) % BUCKETS)
            owners.append(owner[: len(h)][inside])
    grams, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.bincount(owners, minlength=len(words))


def word_means(values: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[grams], axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1).reshape(-1, *[1] * (values.ndim - 1))


def window_means(values: np.ndarray) -> np.ndarray:
    """Means over windows of SPAN words, one each STEP words and one at the end; over all words if they are fewer."""
    n = len(values)
    if n <= SPAN:
        return np.array([values.mean() if n else 0.0])
    sums = np.append(0.0, np.cumsum(values))
    starts = np.append(np.arange(0, n - SPAN, STEP), n - SPAN)
    return (sums[starts + SPAN] - sums[starts]) / SPAN


class Toxicity:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias  # of each bucket, as the softmax sees it

    def start(self) -> None:
        self.words: dict[str, int] = {}
        self.cores: dict[str, float] = {}
        self.values = np.zeros(0)

    def learn(self, words: list[str]) -> None:
        cores = list(map(core, words))
        if new := [c for c in dict.fromkeys(cores) if c not in self.cores]:
            self.cores.update(zip(new, word_means(self.weights, *grams_of(new)).tolist()))
        at = len(self.words)
        for word in words:
            self.words[word] = len(self.words)
        if len(self.words) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(1 << 14, len(self.values), len(words)))])
        self.values[at : len(self.words)] = [self.cores[c] for c in cores]

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [(t or "").split() for t in texts]
        out = []
        for at in range(0, len(split), 64):
            part = split[at : at + 64]
            if len(self.words) > KEPT_WORDS:
                self.start()
            new = dict.fromkeys(w for words in part if None in map(self.words.get, words) for w in words)
            if new := [w for w in new if w not in self.words]:
                self.learn(new)
            for words in part:
                values = self.values[np.array(list(map(self.words.__getitem__, words)), np.int64)]
                out.append(float(1 / (1 + np.exp(-np.clip(window_means(values).max() + self.bias, -50, 50)))))
        return out


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Toxicity:
    """Adam over all texts at once: plain averages of texts at first, then their most toxic windows."""
    split = [[core(w) for w in t.split()] for t in texts]
    vocabulary = list(dict.fromkeys(w for words in split for w in words))
    number = {w: k for k, w in enumerate(vocabulary)}
    ids = [np.array([number[w] for w in words], np.int64) for words in split]
    grams, counts = grams_of(vocabulary) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(len(vocabulary)), counts)
    rng = np.random.default_rng(SEED)
    # vectors (BUCKETS, DIMENSIONS); softmax (DIMENSIONS, 2); bias (2)
    params = [rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = weight / weight.sum()
    for step in range(1, EPOCHS + 1):
        vectors, out, bias = params
        toward = out[:, 1] - out[:, 0]
        shown = rng.random(len(grams)) >= HIDDEN
        values = word_means((vectors @ toward)[grams] * shown, np.arange(len(grams)), counts)
        spans = []
        for words in ids:
            v = values[words]
            if step <= PLAIN_EPOCHS or len(words) <= SPAN:
                spans.append((0, len(words), v.mean() if len(words) else 0.0))
            else:
                means = window_means(v)
                k = int(means.argmax())
                begin = min(k * STEP, len(words) - SPAN)
                spans.append((begin, begin + SPAN, means[k]))
        logit = np.array([m for _, _, m in spans]) + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        error = (p - toxic) * weight
        used = np.concatenate([w[a:b] for w, (a, b, _) in zip(ids, spans)])
        each = np.concatenate([np.full(b - a, e / max(1, b - a)) for e, (a, b, _) in zip(error, spans)])
        by_word = np.bincount(used, each, minlength=len(vocabulary)) / np.maximum(counts, 1)
        by_gram = np.bincount(grams, by_word[owner] * shown, minlength=BUCKETS).astype(np.float32)
        g_vectors = by_gram[:, None] * toward[None] + DECAY / BUCKETS * vectors
        g_toward = by_gram @ vectors
        grads = [g_vectors, np.stack([-g_toward, g_toward], 1), np.array([-error.sum(), error.sum()], np.float32)]
        for q, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    vectors, out, bias = params
    return Toxicity((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """From docs (doc_id, text) and labels (doc_id, toxic: 0 or 1): at most `sample` labels of each, weighted as all are.

    Null and other labels are left out, as are labels without a document. Without both classes, every text scores
    that of all labels (none: 0.5).
    """
    taken, counts = labelled_sample(labels.where("toxic in (0, 1)").selectExpr("doc_id", "cast(toxic as int) toxic"), "toxic", F.col("doc_id"), sample)
    if len(counts) < 2:
        return Toxicity(np.zeros(BUCKETS), 0.0 if not counts else 20.0 * (1 if 1 in counts else -1))
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")  # at most 2 * sample rows
    taken = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").toPandas()
    taken = taken.sort_values(["doc_id", "text", "toxic"], kind="stable")
    if not len(taken):  # labels of no document
        return Toxicity(np.zeros(BUCKETS), 0.0)
    toxic = taken["toxic"].to_numpy(np.float64)
    weight = np.where(toxic == 1, counts[1] / max(1, toxic.sum()), counts[0] / max(1, (1 - toxic).sum()))
    return fit(taken["text"].tolist(), toxic, weight)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score (0 to 1, higher is more toxic) for every row of docs, from the whole text alone.

    Null and empty texts get the score of no words. Repeated rows stay; an empty table gives an empty one.
    """

    def scan(batches):
        model.start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(scan), "doc_id long, score double")
