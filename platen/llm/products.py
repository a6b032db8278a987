"""Exact top-k by inner product: vectors in buckets of like length, pruned by local cosine thresholds.

Vectors are whole numbers, ordered by falling length and cut into buckets of BUCKET. A query keeps the k-th best
product that it has seen. Against a bucket that is a threshold on the cosine: product / (length of the query times
the bucket's greatest length). Above 1 the whole bucket goes, and all behind it, as lengths only fall. Below, each
bucket prunes its queries in one of two ways, parted at the local threshold that makes the bucket's work least:
low ones by length (only the vectors long enough), high ones by coordinates (in the query's largest coordinates
a vector must lie near the query's own, a range in a sorted list). What is left is verified by whole products.

Buckets are visited in rounds of 1, 8, 64, ... of them, so that the longest vectors raise the thresholds before
the many short ones are read. In a round a bucket meets its queries in blocks of at most BUCKET; nothing is
pruned by a limit that could cost a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stage

#: Vectors of a bucket, and queries of a block.
BUCKET = 8192
#: How many times as many buckets each round visits.
GROWTH = 8
#: Coordinates that a query prunes by, its largest.
FOCUS = 3
#: What a query by coordinates costs besides its candidates, in products.
SEARCH = 400

_KINDS = [("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
FOUND = "query long, vec_id long, score long"
LONG = (1 << 63) - 1


def whole(df: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """vec_id, dim, v (the components floor(factor * x) as doubles' bytes) and length of the vectors that take part.

    Vectors that are null or empty or hold a null or non-finite component take no part, nor do those without an id.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat, ends = batch.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = flat[(ends[own] - d)[:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x[good] * factor), -np.finfo(float).max, np.finfo(float).max) + 0.0
                ids = batch.column(0).take(pa.array(own[good]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(_length(x))], ["vec_id", "dim", "v", "length"])

    return rows.mapInArrow(run, "vec_id long, dim int, v binary, length double")


def _length(x: np.ndarray) -> np.ndarray:
    """Lengths, not too small by rounding, without overflow."""
    top = np.maximum(np.abs(x).max(axis=1, initial=1.0), 1.0)
    return np.linalg.norm(x / top[:, None], axis=1) * top * (1 + 1e-12)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of one row with all of x: doubles where they hold them, else whole numbers kept to a long's range."""
    if len(x) and _length(q[None, :])[0] * _length(x).max() >= 2**53:
        own = [int(a) for a in q]
        return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(own, r, strict=True)))) for r in x], np.int64)
    return (x @ q).astype(np.int64)


def _ranges(q: np.ndarray, cosine: np.ndarray, lists: np.ndarray, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the one behind the last in the sorted list of each focus coordinate for every (unit) query.

    Two unit vectors of cosine t or more, of which one has c in a coordinate, differ there by so little that the other
    lies in c t -+ sqrt((1 - t^2) (1 - c^2)); a slack covers rounding. Negative thresholds prune nothing.
    """
    t = np.clip(cosine, 0.0, 1.0)[:, None]
    c = np.take_along_axis(q, focus, axis=1)
    wide = np.sqrt((1 - t * t) * np.maximum(1 - c * c, 0)) + 1e-9
    first, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
    for f in np.unique(focus):
        at = np.nonzero(focus == f)
        first[at] = np.searchsorted(lists[f], (c * t - wide)[at], "left")
        end[at] = np.searchsorted(lists[f], (c * t + wide)[at], "right")
    all_ = (cosine <= 0)[:, None]
    return np.where(all_, 0, first), np.where(all_, lists.shape[1], end)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        own = np.flatnonzero(scores >= least)
        return own[np.lexsort((ids[own], -scores[own]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def part_at(cosine: np.ndarray, by_length: np.ndarray, by_coordinates: np.ndarray) -> float:
    """The local threshold from which on coordinates prune: where both ways' work together is least."""
    order = np.argsort(cosine)
    low = np.concatenate([[0], np.cumsum(by_length[order])])
    high = np.concatenate([np.cumsum(by_coordinates[order][::-1])[::-1], [0]])
    at = int(np.argmin(low + high))
    return float(cosine[order][at]) if at < len(order) else np.inf


def _meet(k: int):
    """The k best of a bucket for each query of a block, by whole products; those below a query's k-th best so far may be left out."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in _KINDS]
        if rows.num_rows and asked.num_rows:
            lengths = rows.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            x, ids, lengths = _matrix(rows.column("v"))[order], rows.column("vec_id").to_numpy()[order], lengths[order]
            q, keys, own = _matrix(asked.column("v")), asked.column("query").to_numpy(), asked.column("vec_id").to_numpy()
            floor, sizes = asked.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), asked.column("length").to_numpy()
            least = np.divide(np.nextafter(floor, -np.inf), sizes, out=np.full(len(q), -np.inf), where=sizes > 0)  # a vector's length must be that at least, if positive
            cosine = np.divide(least, lengths[0], out=np.full(len(q), -np.inf), where=lengths[0] > 0)
            count = np.where(least > 0, np.searchsorted(-lengths, -least * (1 - 1e-9), "right"), len(x))
            unit = q / np.maximum(sizes, 1e-300)[:, None]
            with np.errstate(invalid="ignore"):
                bar = x / np.maximum(lengths, 1e-300)[:, None]
            focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
            places = np.argsort(bar, axis=0, kind="stable").T
            lists = np.take_along_axis(bar.T, places, axis=1)
            first, end = _ranges(unit, cosine, lists, focus)
            shortest = (end - first).argmin(axis=1)
            n = (end - first)[np.arange(len(q)), shortest]
            split = part_at(cosine, count.astype(np.float64), n + SEARCH)

            def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
                good = (ids[at] != own[i]) & (scores >= floor[i])
                at, scores = at[good], scores[good]
                top = _best(scores, ids[at], k)
                for column, values in zip(out, (np.full(len(top), keys[i]), ids[at[top]], scores[top]), strict=True):
                    column.append(values)

            exact = float(sizes.max()) * float(lengths[0]) < 2**53
            some = np.flatnonzero((count > 0) & ((cosine < split) | (least <= 0)))
            some = some[np.argsort(count[some], kind="stable")]  # of like count together
            for begin in range(0, len(some), 256):
                block = some[begin : begin + 256]
                m = int(count[block].max())
                s = (q[block] @ x[:m].T).astype(np.int64) if exact else np.array([_products(q[i], x[:m]) for i in block])
                for r, i in enumerate(block):
                    keep(i, np.arange(m), s[r])
            for i in np.flatnonzero((count > 0) & (cosine >= split) & (least > 0)):
                f = shortest[i]
                at = places[focus[i, f], first[i, f] : end[i, f]]
                at = at[at < count[i]]
                for g in range(focus.shape[1]):
                    if g != f:
                        values, sorted_ = bar[at, focus[i, g]], lists[focus[i, g]]
                        low = sorted_[first[i, g]] if first[i, g] < len(x) else np.inf
                        high = sorted_[end[i, g] - 1] if end[i, g] else -np.inf
                        at = at[(values >= low) & (values <= high)]
                keep(i, at, _products(q[i], x[at]))
        return pa.table([pa.array(np.concatenate(c), t) for c, (_, t) in zip(out, _KINDS, strict=True)], names=[name for name, _ in _KINDS])

    return run


def buckets(kept: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """kept with bucket (by rank of falling length in a dimension, from 0), staged, and the greatest length of each (dim, bucket).

    What the driver gathers is a count per partition and one per dimension.
    """
    spark = kept.sparkSession
    total = {r["dim"]: r["count"] for r in kept.groupBy("dim").count().collect()}
    order = ["dim", F.desc("length"), "vec_id", "v"]
    ranged = kept.repartitionByRange(parts(sum(total.values()), 100_000, 12), *order).sortWithinPartitions(*order)
    ranked = stage(ranged.withColumn("mid", F.monotonically_increasing_id()), "products-ranked")
    per = sorted((r["p"], r["count"]) for r in ranked.groupBy(F.shiftright("mid", 33).alias("p")).count().collect())
    begins = list(accumulate([0] + [n for _, n in per]))
    before = spark.createDataFrame([(p, b) for (p, _), b in zip(per, begins, strict=False)], "p long, before long")
    dims = sorted(total)
    firsts = spark.createDataFrame(list(zip(dims, accumulate([0] + [total[d] for d in dims]), strict=False)), "dim int, first long")
    at = F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("first")
    own = ranked.withColumn("p", F.shiftright("mid", 33)).join(F.broadcast(before), "p").join(F.broadcast(firsts), "dim")
    out = stage(own.select("vec_id", "dim", "v", "length", F.floor(at / size).alias("bucket")), "products-buckets")
    return out, out.groupBy("dim", "bucket").agg(F.max("length").alias("greatest"))


def search(df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: int = 256, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row for which ``asks`` holds of vec_id, the k largest inner
    products of its components floor(factor * x), exact whole numbers, over all rows of its dimension but those of its own id.

    Ties go to the smaller id. Rows that share an id, equal or not, are each candidates and each queries. See
    ``whole`` for vectors that take no part; zero vectors do. Products beyond a long count as the nearest long.

    Of equal vectors only so many can matter: at most k rows of an id and 2 k rows of a vector stay, by id, before
    anything is ranked, and Spark cuts each task's share to that before it shuffles.
    """
    rows = stage(whole(df, key, vector, factor), "products-vectors")
    asked = rows.filter(asks).withColumn("query", F.monotonically_increasing_id())
    asked = stage(asked, "products-queries")
    by_id, by_vector = Window.partitionBy("v", "vec_id").orderBy("dim"), Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k)
    kept = kept.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= 2 * k).drop("nth", "place")
    ranked, greatest = buckets(stage(kept, "products-kept"), bucket)
    greatest = stage(greatest, "products-greatest")
    last = greatest.agg(F.max("bucket")).first()[0]
    best = None
    begin, many, asked_n = 0, 1, asked.count()
    state = asked.withColumn("floor", F.lit(-LONG - 1).cast("long"))
    while last is not None and begin <= last and asked_n:
        span = F.col("bucket").between(begin, begin + many - 1)
        # queries of like reach lie together: their number in that order makes the blocks
        reach = F.col("floor") / F.greatest("length", F.lit(1e-300))
        blocks = parts(asked_n, bucket)
        dealt = state.repartitionByRange(blocks, reach, "query").withColumn("block", F.spark_partition_id()) if blocks > 1 else state.withColumn("block", F.lit(0))
        tops = greatest.filter(span).withColumnRenamed("dim", "d")
        open_ = (F.col("d") == F.col("dim")) & ((F.col("floor") <= 0) | (F.col("greatest") * F.col("length") * (1 + 1e-9) >= F.col("floor")))
        looks = stage(dealt.join(F.broadcast(tops), open_).select("query", "vec_id", "v", "length", "floor", "dim", "bucket", "block"), "products-looks")
        meet = looks.select(*(F.col(c).alias(c) for c in ("dim", "bucket", "block"))).distinct()
        vectors = ranked.filter(span).join(meet, ["dim", "bucket"])
        found = vectors.groupBy("dim", "bucket", "block").cogroup(looks.groupBy("dim", "bucket", "block")).applyInArrow(_meet(k), FOUND)
        best = _top(found if best is None else best.unionByName(found), k)
        best = stage(best, "products-best")
        floors = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") == k).select("query", "low")
        state = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("low", F.lit(-LONG - 1).cast("long"))).drop("low")
        begin, many = begin + many, many * GROWTH
    if best is None:
        best = df.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    placed = best.withColumn("rank", F.row_number().over(order))
    return placed.join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
