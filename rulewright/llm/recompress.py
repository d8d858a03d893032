"""Recompression of word sequences, as numpy steps over many documents at once.

A round names maximal runs of a symbol, then pairs of a left and a right symbol; a symbol's name is a hash of what it
stands for, so that all tasks give equal parts equal names without asking one another. Which side a symbol is on also
follows from its name. Beside its words [start, end) each symbol has its context [low, high): the words that decided,
in any round, that it is a symbol here. Where a context lies within a window, each equal window elsewhere has the same
symbol at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
    """A hash of the ordered pair a, b."""
    with np.errstate(over="ignore"):
        x = (a * U(0x9E3779B97F4A7C15)) ^ ((b + U(tag)) * U(0xC2B2AE3D27D4EB4F))
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(29))


@dataclass
class Level:
    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    closes: np.ndarray  # the last symbol of its document


def words_level(hashes: np.ndarray, closes: np.ndarray) -> Level:
    at = np.arange(len(hashes))
    return Level(hashes, at, at + 1, at, at + 1, closes)


def runs(x: Level) -> Level:
    """Maximal runs of one name become one symbol; each depends on the neighbours that end it."""
    n = len(x.name)
    opens = np.append(True, x.closes[:-1])
    goes_on = np.append(x.name[1:] == x.name[:-1], False) & ~x.closes
    first = np.flatnonzero(np.append(True, ~goes_on[:-1]))
    last = np.append(first[1:], n) - 1
    count = last - first + 1
    name = x.name[first].copy()
    many = count > 1
    name[many] = mix(name[many], count[many].astype(U), 11)
    # beyond a document's edge there is nothing, which elsewhere may be otherwise: the context then leaves the document
    low = np.where(opens[first], x.start[first] - 1, x.low[np.maximum(first - 1, 0)])
    high = np.where(x.closes[last], x.end[last] + 1, x.high[np.minimum(last + 1, n - 1)])
    return Level(name, x.start[first], x.end[last], low, high, x.closes[last])


def pairs(x: Level, number: int) -> Level:
    """A left symbol and the right symbol after it become one; left ones depend on what follows, right ones on what precedes."""
    n = len(x.name)
    left = (mix(x.name, x.name, 100 + number) >> U(63)).astype(bool)
    opens = np.append(True, x.closes[:-1])
    joins = np.append(left[:-1] & ~left[1:], False) & ~x.closes
    first = np.flatnonzero(np.append(True, ~joins[:-1]))
    last = first + joins[first]
    two = joins[first]
    name = np.where(two, mix(x.name[first], x.name[last], 7), x.name[first])
    low = np.where(opens, x.start - 1, x.low[np.maximum(np.arange(n) - 1, 0)])
    high = np.where(x.closes, x.end + 1, x.high[np.minimum(np.arange(n) + 1, n - 1)])
    low = np.where(two | left[first], x.low[first], low[first])
    high = np.where(two | ~left[first], x.high[last], high[first])
    return Level(name, x.start[first], x.end[last], low, high, x.closes[last])


def levels(hashes: np.ndarray, closes: np.ndarray, rounds: int) -> list[Level]:
    out = [words_level(hashes, closes)]
    for number in range(rounds):
        out.append(pairs(runs(out[-1]), number))
    return out


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each span [start, end), wherever it stands."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(hashes), BASE))
        sums = np.append(U(0), np.cumsum(mix(hashes, hashes, 1) * powers))
        back = np.cumprod(np.append(U(1), np.full(len(hashes), BACK)))
        return (sums[end] - sums[start]) * back[start]


def representatives(found: list[Level], starts: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window [p, p + width), p in `starts`: name and first word of the symbol that stands for it.

    A symbol is named for this by its level, its name and the `reach` words from its first on. Of the symbols whose
    context and these words are inside the window, it is one of the highest level there, and of these the one of the
    least name (the first, if it occurs again). Equal windows get the same.
    """
    words = found[0].name
    n = len(starts)
    name, place = np.zeros(n, U), np.full(n, -1, np.int64)
    for number in range(len(found) - 1, -1, -1):
        todo = np.flatnonzero(place < 0)
        if not len(todo):
            break
        x = found[number]
        order = mix(mix(x.name, np.full(len(x.name), number, U), 3), span_hashes(words, x.start, np.minimum(x.start + reach, len(words))), 4)
        a = np.searchsorted(x.low, starts[todo])
        b = np.searchsorted(np.maximum(x.high, x.start + reach), starts[todo] + width, side="right")
        some = b > a
        a, b, todo = a[some], b[some], todo[some]
        if not len(todo):
            continue
        # the least of each range, by tables of the least of 1, 2, 4, ... symbols
        best, size = np.arange(len(order)), 1
        power = np.floor(np.log2(b - a)).astype(np.int64)
        for step in range(int(power.max()) + 1):
            at = np.flatnonzero(power == step)
            one, two = best[a[at]], best[b[at] - size]
            least = np.where(order[two] < order[one], two, one)
            name[todo[at]], place[todo[at]] = order[least], x.start[least]
            one, two = best[:-size], best[size:]
            best = np.where(order[two] < order[one], two, one)
            size *= 2
    return name, place
