"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated model of word pairs, p(w | v) = max(n(vw) - D2, 0) / n(v) + freed(v) * p(w).
Its lower order goes by Kneser-Ney continuation counts: how many different words a word follows in the class's
texts, so that a text which repeats itself counts once. That in turn discounts a number of contexts of every
word and hands the freed mass to one distribution whose counts are shared by the classes:
p(w) = max(m(w) - D1, 0) / M + freed / M * p(w | shared). A rare expression therefore has the same odds
whatever it is, and only what a class uses in many contexts tells them apart.

Two length-normalised comparisons of the log-likelihoods go into a text's score: that of the whole text by
the models of pairs, and, as toxic words stand alone in long ordinary texts, the largest one of any stretch of
a few words, by the lower order. On labelled texts that the counts haven't seen, a logistic curve is fitted
that maps both to 0 ... 1; D1 and the stretch's length are chosen by its likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, stage

SHARED_DISCOUNT, PAIR_DISCOUNT, FOLDS = 0.75, 4, 5
#: What the held-back fold chooses from: discounts, and words in a stretch.
DISCOUNTS, SPANS = (1.0, 2.0, 4.0), (1, 2, 3)
#: At most about so many labelled documents, and words in them, are fitted on: a sample by the hash of their keys.
FIT_DOCUMENTS, FIT_CHARS = 24_000, 60_000_000


class Tables(NamedTuple):
    """Log odds, toxic over ordinary: the last entry of odds and contexts is that of all other words."""

    words: list[str]  # the first is the empty one, which is before a text
    odds: np.ndarray  # of p(w)
    contexts: np.ndarray  # of what a word before frees
    keys: np.ndarray  # ascending, place of v * (words + 1) + place of w
    pairs: np.ndarray  # of p(w | v)

    def ratios(self, split: tuple[pa.Array, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of every word: the log odds of p(w) and of p(w | v)."""
        flat, sizes = split
        n = len(self.words)
        at = pc.index_in(flat.cast(pa.string()), pa.array(self.words, pa.string())).fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64)
        one = self.odds[at]
        before = np.concatenate([[0], at[:-1]]) if len(at) else at
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        two = self.contexts[before] + one
        if len(self.keys):
            key = before * (n + 1) + at
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[near] == key
            two[hit] = self.pairs[near[hit]]
        return one, two

    def features(self, texts: pa.Array, spans_: tuple[int, ...]) -> np.ndarray:
        """Of each text (rows): the whole text's mean log odds, and the most toxic stretch's for each length."""
        out = [np.zeros((0, 1 + len(spans_)))]
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 0, 1 << 20):  # some twenty numbers a word are held
            split = words(part.column(0))
            one, two = self.ratios(split)
            out.append(np.stack([means(two, split[1]), *[spans(one, split[1], k) for k in spans_]], 1))
            release()
        return np.concatenate(out)


class Model(NamedTuple):
    tables: Tables
    span: int
    slopes: list[float]  # of the whole text, of the stretch
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.tables.features(texts, (self.span,)) @ np.array(self.slopes) + self.bias, -500, 500)))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of letters, digits and _, in lower case), and how many each text has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}\p{N}_]+")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(flat, "")
    return flat.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of each text's values; 0 without words."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some]) / sizes[some]
    return out


def spans(values: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """The largest mean of ``span`` neighbouring values of each text, of all if there are fewer; 0 without words."""
    out = np.zeros(len(sizes))
    if not len(values):
        return out
    run = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    width = np.minimum(sizes, span)
    last = np.repeat(ends - width, sizes)  # a stretch starts here at the latest
    start = np.minimum(np.arange(len(values)), last)
    each = (run[start + np.repeat(width, sizes)] - run[start]) / np.repeat(width, sizes)
    some = np.flatnonzero(sizes)
    out[some] = np.maximum.reduceat(each, (ends - sizes)[some])
    return out


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo FOLDS; null for a null key."""
    return F.crc32(key.cast("string")) % FOLDS


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1, 2 << 20):
        flat, sizes = words(part.column(1))
        before = np.arange(len(flat)) - 1
        starts = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]
        at = pa.array(np.maximum(before, 0))
        first = np.zeros(len(flat), bool)
        first[starts] = True
        previous = pc.if_else(pa.array(first), pa.scalar("", pa.large_string()), flat.take(at)) if len(flat) else flat
        toxic = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
        table = pa.table({"toxic": toxic, "before": previous, "word": flat}).group_by(["toxic", "before", "word"]).aggregate([([], "count_all")])
        release()
        columns = [table.column(c).cast(k) for c, k in (("toxic", pa.int32()), ("before", pa.string()), ("word", pa.string()), ("count_all", pa.int64()))]
        yield from pa.table(columns, ["toxic", "before", "word", "n"]).combine_chunks().to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """before, word, t, o: how often a word follows another (nothing: the empty word) in toxic and in ordinary texts."""
    seen = rows.select("toxic", "text").mapInArrow(_contexts, "toxic int, before string, word string, n long")
    own = lambda y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0))
    return seen.groupBy("before", "word").agg(own(1).alias("t"), own(0).alias("o"))


def fit_tables(rows: DataFrame) -> dict[float, Tables]:
    """The tables of each discount from rows of toxic (0 or 1) and text; none if a class has no word.

    The driver gets the words that have more contexts than the smallest discount and the pairs that occur more
    often than theirs: rows are a bounded sample, and so are these.
    """
    pairs = stage(pair_counts(rows), "toxicity-pairs")
    per = pairs.groupBy("word").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"), F.count(F.lit(1)).alias("both"))
    per = stage(per, "toxicity-words")
    freed = [F.coalesce(F.sum(F.least(F.col(c), F.lit(d))), F.lit(0.0)).alias(f"{c}_{d}") for c in ("t", "o") for d in DISCOUNTS]
    totals = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("t", "o", "both")], *freed).first().asDict()
    if not totals["t"] or not totals["o"]:
        return {}
    held = lambda c: F.sum(F.least(F.col(c), F.lit(PAIR_DISCOUNT)))
    contexts = pairs.groupBy("before").agg(F.sum("t").alias("v_t"), F.sum("o").alias("v_o"), held("t").alias("free_t"), held("o").alias("free_o"))
    contexts = contexts.filter("v_t > free_t or v_o > free_o")
    often = pairs.filter(f"t > {PAIR_DISCOUNT} or o > {PAIR_DISCOUNT}").withColumnsRenamed({"t": "n_t", "o": "n_o"})
    known = per.filter((F.col("t") > min(DISCOUNTS)) | (F.col("o") > min(DISCOUNTS))).orderBy("word").toPandas()
    before = contexts.orderBy("before").toPandas()
    kept = often.join(per, "word").orderBy("before", "word").toPandas().merge(before, on="before")
    words_ = ["", *sorted(({*known["word"], *before["before"], *kept["word"]}) - {""})]
    place = {w: i for i, w in enumerate(words_)}
    free = {c: np.where(before[f"v_{c}"] > 0, before[f"free_{c}"] / np.maximum(before[f"v_{c}"], 1), 1.0) for c in "to"}
    around = np.zeros(len(words_) + 1)
    around[[place[v] for v in before["before"]]] = np.log(free["t"]) - np.log(free["o"])
    keys = np.array([place[v] * (len(words_) + 1) + place[w] for v, w in zip(kept["before"], kept["word"], strict=True)], np.int64)
    order = np.argsort(keys)
    out = {}
    for d in DISCOUNTS:
        shared = lambda x: np.maximum(x["both"] - SHARED_DISCOUNT, 0) / totals["both"] + SHARED_DISCOUNT / totals["both"]
        low = lambda x, c, d=d: np.maximum(x[c] - d, 0) / totals[c] + totals[f"{c}_{d}"] / totals[c] * shared(x)
        other = math.log(totals[f"t_{d}"] / totals["t"]) - math.log(totals[f"o_{d}"] / totals["o"])
        odds = np.full(len(words_) + 1, other)
        odds[[place[w] for w in known["word"]]] = np.log(low(known, "t")) - np.log(low(known, "o"))
        given = lambda c: np.where(kept[f"v_{c}"] > 0, (np.maximum(kept[f"n_{c}"] - PAIR_DISCOUNT, 0) + kept[f"free_{c}"] * low(kept, c)) / np.maximum(kept[f"v_{c}"], 1), low(kept, c))  # noqa: E731, B023
        each = np.log(given("t")) - np.log(given("o"))
        out[d] = Tables(words_, odds, around, keys[order], np.asarray(each, float)[order])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, list[float], float]:
    """The loss, and slopes and bias by Newton's method, the slopes held by a small ridge."""
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)  # what differs by rounding only tells nothing
    design, theta = np.column_stack([(x - x.mean(axis=0)) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ theta)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ theta, -30, 30))), 1e-12, 1 - 1e-12)
    slopes = theta[:-1] / scale
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), slopes.tolist(), float(theta[-1] - slopes @ x.mean(axis=0))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled documents outside fold 0: fold 1 for the logistic curve, the others for counts.

    The sample is bounded by FIT_DOCUMENTS and FIT_CHARS, so the model has a bounded size too: a word in it
    has more contexts than the smallest discount. Null labels, keys and texts take no part. Where a class has no
    document, every text scores 0.
    """
    known = labels.select(F.col(key).cast("long").alias("fit_key"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold(F.col("fit_key")) != 0))
    known = known.groupBy("fit_key").agg(F.max("toxic").alias("toxic"))
    sizes = documents.select(F.col(key).cast("long").alias("fit_key"), F.octet_length(text).alias("size")).join(known, "fit_key")
    sizes = stage(sizes.groupBy("fit_key").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")), "toxicity-sizes")
    n, chars = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rate = min(1.0, FIT_DOCUMENTS / max(1, n), FIT_CHARS / max(1, chars))
    drawn = F.xxhash64("fit_key").bitwiseAND(F.lit((1 << 63) - 1))  # of 63 bits: no rate rounds to none
    chosen = sizes if rate >= 1 else sizes.filter(drawn < F.lit(max(1, int(rate * (1 << 63)))))
    chosen = chosen.select("fit_key", "toxic")
    few = chosen.count() <= 2 * FIT_DOCUMENTS  # all of them have a document, so that is all that is ever expected
    rows = documents.select(F.col(key).cast("long").alias("fit_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen) if few else chosen, "fit_key")
    rows = stage(rows.select("toxic", "text", (fold(F.col("fit_key")) == 1).alias("held")), "toxicity-sample")
    tables = fit_tables(rows.filter(~F.col("held")))
    if not tables:
        return Model(Tables([""], np.zeros(2), np.zeros(2), np.zeros(0, np.int64), np.zeros(0)), 1, [0.0, 0.0], -500.0)
    sent = documents.sparkSession.sparkContext.broadcast([tuple(t) for t in tables.values()])

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        own = pa.array(texts, pa.large_string(), from_pandas=True)
        return pd.Series(list(np.concatenate([Tables(*t).features(own, SPANS) for t in sent.value], axis=1)))

    held = rows.filter("held")
    if held.select("toxic").distinct().count() < 2:  # too few to hold any back
        held = rows
    points = held.select("toxic", each("text").alias("x")).toPandas()
    width = 1 + len(SPANS)
    x, y = np.stack(points["x"].to_list()).reshape(len(points), -1), points["toxic"].to_numpy(float)
    curves = {(i, j): _logistic(x[:, [i * width, i * width + 1 + j]], y) for i in range(len(DISCOUNTS)) for j in range(len(SPANS))}
    i, j = min(curves, key=lambda c: curves[c][0])
    return Model(tables[DISCOUNTS[i]], SPANS[j], *curves[i, j][1:])


def score_udf(documents: DataFrame, model: Model):
    """A column function: the toxicity, 0 to 1, of a whole text; the model is broadcast (its size is bounded, see fit)."""
    sent = documents.sparkSession.sparkContext.broadcast((tuple(model.tables), *model[1:]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = Model(Tables(*sent.value[0]), *sent.value[1:])
        return pd.Series(own.scores(pa.array(texts, pa.large_string(), from_pandas=True)))

    return score


def without_toxic(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents but those that score 0.5 or more. Null and empty texts stay unless the curve itself rejects them."""
    score = score_udf(documents, fit(documents, labels, key, text))
    return documents.filter(score(F.col(text)) < 0.5)
