"""Stupid-backoff scores of whole texts by n-gram counts of the whole corpus.

Texts are dealt to batches. A batch explodes its texts into n-grams, combines equal ones, and sends them with
their counts to the parts of the count table, by the n-grams' hashes; a part adds up what all batches sent,
joins the totals back to what each batch sent, and the batch sums its documents' scores. An n-gram that every
text has costs its part one entry a batch, not one an occurrence, so none is hot. Entries travel by the
thousand, packed, in a row per batch and part that have any in common: an entry goes out once and comes back
once, whatever the numbers of batches and parts.

A document is scored on what the others hold: its own occurrences are taken off the counts, or every n-gram
would have been seen and nothing would ever back off.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stage

#: Weight of a backoff step, and the occurrences that a word counts for which no other document has.
BACKOFF, UNSEEN = 0.4, 0.5
BATCH_CHARS, BUCKET_GRAMS = 6_000_000, 1_500_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all but the last word and of that."""
    x = before * _K[0] ^ (word + _K[1]) * _K[2]
    x = (x ^ x >> np.uint64(31)) * _K[1]
    return x ^ x >> np.uint64(29)


class Grams:
    """The distinct n-grams of a batch, shorter ones first, and where its texts have them.

    at[k - 1]: of each word that k - 1 words of its text are before, the place of the k-gram it ends; here[k - 1]:
    which words these are.
    """

    def __init__(self, texts: pa.ChunkedArray, order: int):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").combine_chunks())
        flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        self.owner = owner[real.to_numpy(zero_copy_only=False)].astype(np.int64)
        self.texts, self.sizes = len(lists), np.bincount(self.owner, minlength=len(lists))
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = [np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)]
        self.at, self.here = [word], [np.arange(len(word))]
        counts, most = [np.bincount(word, minlength=len(hashes[0]))], max(1, len(hashes[0]))
        for k in range(2, order + 1):
            here = self.here[-1][1:][self.owner[self.here[-1][1:]] == self.owner[self.here[-1][1:] - k + 1]] if k > 2 else np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1
            before = np.full(len(word), -1)
            before[self.here[-1]] = self.at[-1]
            codes, at, n = np.unique(before[here - 1] * most + word[here], return_inverse=True, return_counts=True)
            hashes.append(_mixed(hashes[-1][codes // most], hashes[0][codes % most]))
            counts.append(n)
            self.at.append(at)
            self.here.append(here)
        self.ends = np.cumsum([len(h) for h in hashes])
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts).astype(np.uint32)

    def by_part(self, parts_: int) -> list[tuple[int, np.ndarray]]:
        """The parts that the n-grams belong to, each with its own in the order of their hashes: that in which totals come back."""
        to = (self.hashes >> np.uint64(7)) % np.uint64(parts_)
        order = np.lexsort((self.hashes, to))
        starts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]])) if len(order) else []
        return [(int(to[order[a]]), own) for a, own in zip(starts, np.split(order, starts[1:]), strict=True)] if len(order) else []

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the sum of the logs, but for the corpus's size, and in how many of them that divides."""
        value, divided, before = np.zeros(len(self.owner)), np.ones(len(self.owner)), None
        for k, (at, here) in enumerate(zip(self.at, self.here, strict=True)):
            n = self.ends[k] - (self.ends[k - 1] if k else 0)
            _, places, own = np.unique(self.owner[here] * max(1, n) + at, return_inverse=True, return_counts=True)
            others = np.zeros(len(self.owner))  # of each word's k-gram: how often other texts have it
            others[here] = totals[self.ends[k] - n : self.ends[k]][at] - own[places]
            if not k:
                value = np.log(np.maximum(others, UNSEEN))
            else:
                seen, backed = here[others[here] > 0], here[others[here] <= 0]
                value[backed] += math.log(BACKOFF)
                value[seen], divided[seen] = np.log(others[seen]) - np.log(before[seen - 1]), 0
            before = others
        return np.bincount(self.owner, value, self.texts), np.bincount(self.owner, divided, self.texts).astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the high planes of small numbers are empty and compress to nothing."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(ascending: np.ndarray) -> bytes:
    """Ascending hashes as their differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _explode(parts_: int, order: int):
    def run(batch: pa.Table) -> pa.Table:
        g = Grams(batch.column("text"), order)
        each = g.by_part(parts_)
        own = batch.column("batch")[0].as_py()
        return pa.table({"batch": pa.array([own] * len(each), pa.int32()), "part": pa.array([b for b, _ in each], pa.int32()), "hashes": pa.array([packed(g.hashes[o]) for _, o in each], pa.binary()), "counts": pa.array([planes(g.counts[o]) for _, o in each], pa.binary())})

    return run


def _unpacked(part: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a part of the count table: entries of each row, distinct hashes, their places among all entries, their totals."""
    hashes = [unpacked(x) for x in part.column("hashes").to_pylist()]
    counts = np.concatenate([from_planes(x, np.uint32) for x in part.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return [len(h) for h in hashes], distinct, at, np.bincount(at, counts, len(distinct)).astype(np.uint64)


def _table(part: pa.Table) -> pa.Table:
    _, distinct, _, totals = _unpacked(part)
    return pa.table({"gram": pa.array(distinct.view(np.int64)), "n": pa.array(totals.view(np.int64))})


def _join(part: pa.Table) -> pa.Table:
    sizes, _, at, totals = _unpacked(part)
    answers = np.split(totals[at], np.cumsum(sizes)[:-1])
    return pa.table({"batch": part.column("batch"), "part": part.column("part"), "totals": pa.array([planes(a) for a in answers], pa.binary())})


def _score(parts_: int, order: int):
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        g = Grams(batch.column("text"), order)
        totals = np.zeros(len(g.hashes))
        got = dict(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        for b, own in g.by_part(parts_):
            totals[own] = from_planes(got[b], np.uint64)
        total, divided = g.scores(totals)
        return pa.table({"key": batch.column("key"), "n_words": pa.array(g.sizes.astype(np.int64)), "logs": pa.array(total), "divided": pa.array(divided)})

    return run


def _dealt(df: DataFrame, key: str, text: str, order: int) -> tuple[DataFrame, int]:
    """key, text and batch of every row, and the number of the count table's parts.

    Rows are dealt by their places, so rows that are equal, or null, don't pile up.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = parts(chars, BATCH_CHARS)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int"))
    return dealt, parts(chars * order // 12, BUCKET_GRAMS, 12)  # a word takes some six characters and more


def _exploded(dealt: DataFrame, parts_: int, order: int) -> DataFrame:
    return dealt.groupBy("batch").applyInArrow(_explode(parts_, order), "batch int, part int, hashes binary, counts binary")


def count_table(df: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """gram (a 64-bit hash, see ``gram_hash``), n: how often all texts together have each n-gram of up to ``order`` words."""
    dealt, parts_ = _dealt(df, key, text, order)
    return _exploded(dealt, parts_, order).groupBy("part").applyInArrow(_table, "gram long, n long")


def gram_hash(words: list[str]) -> int:
    """The number by which the count table knows an n-gram."""
    hashes = [np.array([xxhash.xxh64_intdigest(w.encode())], np.uint64) for w in words]
    out = hashes[0]
    for h in hashes[1:]:
        out = _mixed(out, h)
    return int(out.view(np.int64)[0])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """key, n_words and score of every row: the mean natural log of its words' stupid-backoff scores.

    S(w | u v) = c(u v w) / c(u v) if others have u v w, else BACKOFF * S(w | v), down to c(w) / N; words at a
    text's start have fewer before them. c counts what other rows hold, N all their words; c(w) is at least
    UNSEEN. Words are what lies between ASCII white space, as they are. Counts go by 64-bit hashes.

    df is read twice and has to give its rows in the same order each time, as a table does. Defined results: a
    null or empty text has no words and a null score; N is at least 1; repeated rows count as others to each other.
    """
    dealt, parts_ = _dealt(df, key, text, order)
    answers = _exploded(dealt, parts_, order).groupBy("part").applyInArrow(_join, "batch int, part int, totals binary")
    summed = stage(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(parts_, order), "key long, n_words long, logs double, divided long"), "language-model")
    n = summed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    others = F.greatest(F.lit(n) - F.col("n_words"), F.lit(1))
    mean = (F.col("logs") - F.col("divided") * F.log(others.cast("double"))) / F.col("n_words")
    return summed.select(F.col("key").alias(key), "n_words", F.when(F.col("n_words") > 0, mean).alias("score"))
