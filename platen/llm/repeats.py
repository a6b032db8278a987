"""Periodic runs of words: stretches that repeat their first words at least four times.

Longest common extensions come from a difference cover: of the suffixes only those are sorted that begin at a
place whose rest modulo 13 is 0, 1, 3 or 9. Any two places reach two such places by the same step of at most
twelve words, which are compared one by one; from there the extension is the least entry between two ranks of
the table of neighbouring extensions, found in a sparse table. A second structure over the reversed words
extends to the left.

A run of period p with at least four periods holds four words p apart on the grid 0, p, 2p, ... that are equal,
whatever its place. The grids of all periods have n log n places a text. Where three neighbouring pairs are equal,
the extensions to both sides tell the whole stretch, and of one stretch the smallest period is the run's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices

MODULUS, COVER = 13, (0, 1, 3, 9)
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places that are extended at once, so that texts of one word repeated keep to some memory.
AT_ONCE = 1 << 20

_SLOT = np.full(MODULUS, -1, np.int64)
_SLOT[list(COVER)] = range(len(COVER))
#: The least step that takes places of rests i and j into the cover together.
_STEP = np.array([[next(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER) for j in range(MODULUS)] for i in range(MODULUS)])


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the numbers, equal numbers alike, from 0."""
    return np.unique(key, return_inverse=True)[1]


class Extensions:
    """How many words two places of a text have in common, counted from there to the right.

    ``words`` are numbers, equal for equal words. Memory and time of building: n log n.
    """

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        blocks = n // MODULUS + 2
        self.words = np.concatenate([words.astype(np.int64), np.full(blocks * MODULUS + MODULUS - n, -1, np.int64)])
        at = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)[None, :]).ravel()
        inside = int((at < n).sum())
        levels = [self._first(at)]
        step = 1  # in blocks
        while levels[-1].max() < inside and step * MODULUS <= n:
            ranks = levels[-1]
            after = np.zeros_like(ranks)  # behind the end lie only empty suffixes, the smallest
            after[step * len(COVER) :] = 0
            after[: len(ranks) - step * len(COVER)] = ranks[step * len(COVER) :]
            levels.append(_dense(ranks * (int(ranks.max()) + 1) + after))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        order = order[at[order] < n]
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(order))
        self.least = [self._neighbours(levels, at, order).astype(np.int32)]
        width = 1
        while 2 * width <= len(self.least[0]):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _first(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by as many words as the modulus."""
        base = int(self.words.max()) + 2
        key, size = np.zeros(len(at), np.int64), 1
        for t in range(MODULUS):
            if size > (1 << 62) // base:
                key = _dense(key)
                size = int(key.max()) + 1
            key, size = key * base + self.words[at + t] + 1, size * base
        return _dense(key)

    def _neighbours(self, levels: list[np.ndarray], at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The extensions of neighbouring suffixes in their order: by halving steps, then word by word."""
        a, b = order[:-1].copy(), order[1:].copy()
        found = np.zeros(len(a), np.int64)
        last = len(at) - 1
        for h in range(len(levels) - 2, -1, -1):
            same = levels[h][a] == levels[h][b]
            found[same] += MODULUS << h
            a[same] = np.minimum(a[same] + (len(COVER) << h), last)
            b[same] = np.minimum(b[same] + (len(COVER) << h), last)
        i, j, alive = at[order[:-1]] + found, at[order[1:]] + found, np.ones(len(a), bool)
        for _ in range(MODULUS):
            alive &= (self.words[np.minimum(i, self.n)] == self.words[np.minimum(j, self.n)]) & (np.maximum(i, j) < self.n)
            found += alive
            i, j = i + alive, j + alive
        return found

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common words from each i and j on, i and j differing, 0 to n."""
        step = _STEP[i % MODULUS, j % MODULUS]
        found = np.zeros(len(i), np.int64)
        left = np.flatnonzero(step > 0)
        for t in range(MODULUS - 1):
            left = left[self.words[i[left] + t] == self.words[j[left] + t]]
            found[left] += 1
            left = left[step[left] > t + 1]
            if not len(left):
                break
        both = np.flatnonzero((found == step) & (np.maximum(i, j) + step < self.n))
        a, b = (self.rank[x // MODULUS * len(COVER) + _SLOT[x % MODULUS]] for x in (i[both] + step[both], j[both] + step[both]))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for h in np.unique(level):
            own = np.flatnonzero(level == h)
            table = self.least[h]
            found[both[own]] += np.minimum(table[low[own]], table[high[own] - (1 << int(h))])
        return found


def runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """start, length, period of every run, a row each, by start and period; ``words`` are numbers.

    A run has its smallest period at least ``least_periods`` times (two or more) and at least ``least_words``
    words, and no neighbour continues it.
    """
    n = len(words)
    ended = np.append(words, -1)
    right = left = None
    found: dict[tuple[int, int], int] = {}
    pairs = least_periods - 1  # so many neighbouring pairs of the grid lie in every run
    for low in (1 << h for h in range(n.bit_length())):
        if low * least_periods > n:
            break
        periods = np.arange(low, min(2 * low, n // least_periods + 1))
        per = max(1, AT_ONCE // len(periods))  # grid places of a period that are looked at together
        for begin in range(0, (n - 1) // low + 1, per):
            grid = ended[np.minimum(periods[:, None] * np.arange(begin, min(begin + per + pairs, (n - 1) // low + 2 + pairs))[None, :], n)]
            same = (grid[:, 1:] == grid[:, :-1]) & (grid[:, 1:] >= 0)
            if same.shape[1] < pairs:
                continue
            all_ = same[:, : same.shape[1] - pairs + 1].copy()
            for k in range(1, pairs):
                all_ &= same[:, k : k + all_.shape[1]]
            row, column = np.nonzero(all_)
            if not len(row):
                continue
            if right is None:
                right, left = Extensions(words), Extensions(words[::-1])
                known = np.zeros((2, n), np.int64)  # period and end of the last run found to hold a place
            p = periods[row]
            i = (column + begin) * p
            while len(i):
                new = (known[0][i] == 0) | (p % np.maximum(known[0][i], 1) > 0) | (i + p + known[0][i] > known[1][i])
                i, p = i[new], p[new]  # in a run whose period divides p, p can only tell that run again
                few = 1024 + len(i) // 8
                at, q = i[:few], p[:few]
                start = at - left.of(n - at, n - at - q)
                end = at + q + right.of(at, at + q)
                long = end - start >= np.maximum(least_words, least_periods * q)
                for s, e, k in np.unique(np.stack([start, end, q], axis=1)[long], axis=0).tolist():
                    if (s, e) not in found:
                        found[s, e] = k
                        known[0][s:e], known[1][s:e] = k, e
                i, p = i[few:], p[few:]
    every = np.array([(s, e - s, k) for (s, e), k in found.items()], np.int64).reshape(-1, 3)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


RUNS = "array<struct<start: long, length: long, period: long>>"


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """key, n_words, runs (start, length, period by start and period; word numbers from 0) and collapsed, of every row.

    Words are what ASCII white space parts, compared by their bytes. ``collapsed`` holds the text's words, one
    space between them, without those that a run repeats. Nothing is shuffled; a text is one task's work, and
    its memory grows with n log n of that text's words.

    Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed
    text; a null key stays null; repeated rows each get their row; other columns don't come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sizes, ends, flat, texts = [], [0], [], []
            for value in part.column(1).cast(pa.large_binary()):
                words = (value.as_py() or b"").split()
                found = runs(_numbered(words))
                sizes.append(len(words))
                flat.append(found)
                ends.append(ends[-1] + len(found))
                texts.append(b" ".join(collapsed(words, found) if len(found) else words))
            columns = np.concatenate(flat) if flat else np.zeros((0, 3), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(c) for c in columns.T], ["start", "length", "period"])
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_words", "runs", "collapsed"])
            release()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, runs {RUNS}, collapsed string")


def with_repeats(words: Column, seed: Column) -> Column:
    """The words, from place seed mod n on replaced by repetitions of some of them: test rows for known repeats."""
    n = F.size(words)
    a = seed % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + seed % 8))
    again = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    rest = F.flatten(F.array_repeat(again, F.ceil((n - a) / p).cast("int")))
    return F.concat(F.slice(words, 1, a.cast("int")), F.slice(rest, 1, (n - a).cast("int")))
