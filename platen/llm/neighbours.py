"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted and quantised, and ordered by their Hilbert key
on several curves. Spark range-partitions the keys of all curves; a row's place on a curve is its rank there,
whichever partitions it fell into, and each curve is cut into blocks of so many neighbouring keys. A query's
window is its own block and the one on either side. Vectors travel to their blocks, queries to three blocks a
curve, the best of all windows merge and are reranked by exact scores.

The work is linear: every vector goes to one block a curve. What that finds depends on how the vectors lie:
nearly everything where they have structure, and less the more vectors without any there are.

Equal vectors are searched once: of each, only the k + 1 smallest ids can be among anyone's k nearest. Rows
equal in id and vector are one row with a count. A query leaves out every row of its own id, however many, so
lists are cut only where k rows are left without any one id: at k + 1 rows of different ids, at 2 k at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import join_counted, parts, stage

DIRECTIONS, BITS = 8, 7
FOUND = "query long, vec_id long, copies int, score double"

KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.float64())


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (rows) with ``bits`` bits a coordinate, as unsigned 64-bit numbers.

    The transposed index is found plane by plane from the highest bit: where a coordinate has the plane's
    bit, the first coordinate's lower bits are inverted, elsewhere both swap theirs; a Gray decoding ends it.
    """
    x = points.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        low = np.uint64((1 << plane) - 1)
        for i in range(n):
            has = (x[i] >> np.uint64(plane) & one).astype(bool)
            swap = np.where(has, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> np.uint64(plane) & one).astype(bool), flip ^ np.uint64((1 << plane) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(plane) & one)
    return key


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one dimension from their bytes, in double precision."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)


def valid(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """vec_id, dim, v (the numbers' bytes) of the vectors that take part, staged, and the numbers' type.

    Vectors that are null, zero, empty or hold a null or non-finite component take no part, nor do those
    without an id.
    """
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("e")).filter(F.col("vec_id").isNotNull() & (F.size("e") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat, ends = batch.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind), np.cumsum(sizes)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                x = flat[(ends[own] - d)[:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                ids = batch.column(0).take(pa.array(own[good]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), d, np.int32)), pa.array([r.tobytes() for r in x[good] + np.array(0, kind)], pa.binary())], ["vec_id", "dim", "v"])

    return stage(rows.mapInArrow(run, "vec_id long, dim int, v binary"), "vectors"), kind


def _keys(kind: str, dims: dict[int, int], curves: int, seed: int):
    """Curve, key, id and number of each row on each curve; the curves of the i-th dimension begin at i * curves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            each = batch.column(1).to_numpy()
            for d in np.unique(each):
                own = pa.array(np.flatnonzero(each == d))
                if d not in planes:
                    rng = np.random.default_rng([seed, d])
                    planes[d] = [(np.linalg.qr(rng.standard_normal((d, min(d, DIRECTIONS))))[0], rng.random(min(d, DIRECTIONS))) for _ in range(curves)]
                x = _matrix(batch.column(2).take(own), kind)
                unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                for c, (plane, shift) in enumerate(planes[d]):
                    spread = unit @ plane * math.sqrt(d) / 8  # a component of a random unit vector times sqrt(d) is about normal
                    cells = np.clip((spread + 0.5 + (shift - 0.5) / 4) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dims[d] * curves + c, np.int32)), pa.array(hilbert(cells, BITS).astype(np.int64)), batch.column(0).take(own), batch.column(3).take(own)], ["curve", "at", "vec_id", "row"])

    return run


def places(kept: DataFrame, kind: str, curves: int, seed: int) -> DataFrame:
    """row and places (curve, at: the rank on it) of every row of kept.

    What the driver gathers is a count per partition and one per dimension, no row.
    """
    spark = kept.sparkSession
    sizes = {r["dim"]: r["count"] for r in kept.groupBy("dim").count().collect()}
    dims = {d: i for i, d in enumerate(sorted(sizes))}
    keyed = kept.select("vec_id", "dim", "v", "row").mapInArrow(_keys(kind, dims, curves, seed), "curve int, at long, vec_id long, row long")
    order = ["curve", "at", "vec_id", "row"]
    ranged = keyed.repartitionByRange(parts(sum(sizes.values()) * curves, 500_000), *order).sortWithinPartitions(*order)
    ranked = stage(ranged.select("curve", "row", F.monotonically_increasing_id().alias("mid")), "ranks")
    per = sorted((r["p"], r["count"]) for r in ranked.groupBy(F.shiftright("mid", 33).alias("p")).count().collect())
    begins = list(accumulate([0] + [n for _, n in per]))
    before = spark.createDataFrame([(p, b) for (p, _), b in zip(per, begins, strict=False)], "p long, before long")
    firsts = list(accumulate([0] + [sizes[d] for d in dims for _ in range(curves)]))
    first = spark.createDataFrame([(c, f) for c, f in enumerate(firsts)], "curve int, first long")
    own = ranked.withColumn("p", F.shiftright("mid", 33)).join(F.broadcast(before), "p").join(F.broadcast(first), "curve")
    at = F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("first")
    return own.groupBy("row").agg(F.collect_list(F.struct("curve", at.alias("at"))).alias("places"))  # one a curve


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the best, ties to the smaller id, until k are left without any one id; of one id k at most."""
    order = np.lexsort((ids, -scores))
    if len(np.unique(ids[order[: k + 1]])) == len(order[: k + 1]):
        return order[: k + 1]
    own = ids[order]
    by = np.argsort(own, kind="stable")
    begins = np.concatenate([[True], own[by][1:] != own[by][:-1]])
    nth = np.empty(len(own), np.int64)
    nth[by] = np.arange(len(own)) - np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0)) + 1
    order, nth = order[nth <= k], nth[nth <= k]
    short = np.arange(1, len(order) + 1) - np.maximum.accumulate(nth) < k
    return order[: int(short.sum()) + 1]


def _near(kind: str, k: int):
    """The best of a block for each query that it is in the window of, by exact scores."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            x, ids, copies = _matrix(rows.column("v"), kind), rows.column("vec_id").to_numpy(), rows.column("copies").to_numpy()
            unique = len(np.unique(ids)) == len(ids)
            q, keys = _matrix(asked.column("v"), kind), asked.column("query").to_pylist()
            for at in range(0, len(q), 512):
                s = q[at : at + 512] @ x.T
                slack = 1e-9 * np.abs(s).max()
                least = np.partition(s, -k - 1, axis=1)[:, -k - 1] if s.shape[1] > k + 1 else np.full(len(s), -np.inf)
                for i in range(len(s)):
                    low = least[i] if unique else s[i][_best(s[i], ids, k)].min()
                    over = np.flatnonzero(s[i] >= low - slack)  # all that may be among the best, rounding allowed for
                    exact = np.array([math.fsum(r) for r in x[over] * q[at + i]])
                    out += [(keys[at + i], int(ids[over[j]]), int(copies[over[j]]), float(exact[j])) for j in _best(exact, ids[over], k)]
        columns = list(zip(*out, strict=True)) or [[]] * len(KINDS)
        return pa.table([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=["query", "vec_id", "copies", "score"])

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """The best of each query, ties to the smaller id, until k are left without any one id; nth: a row's place among its id's.

    Of an id k at most count, so that 2 k always do; Spark cuts each task's share to that before it shuffles.
    """
    own = Window.partitionBy("query", "vec_id").orderBy(F.desc("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "nth")
    capped = found.withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= k)
    placed = capped.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * k)
    most = F.coalesce(F.max("nth").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("most", most).filter(F.col("place") - 1 - F.col("most") < k).drop("place", "most")


def search(df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, curves: int = 12, block: int = 2048, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by inner product of every row for which ``asks`` holds of vec_id.

    Candidates are all rows of the query's dimension but those of its own id. Ties go to the smaller id;
    scores are rounded once (the exact sum). See ``valid`` for vectors that take no part. Rows that share an
    id, equal or not, are each candidates and each queries; a query then leaves out all of them. A curve of at
    most two blocks is searched whole, so small tables have exact results. Reruns agree.
    """
    rows, kind = valid(df, key, vector)
    asked = rows.filter(asks)
    distinct = asked.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("query", F.monotonically_increasing_id())
    distinct = stage(distinct, "queries")  # an id may have several vectors, so each has a number of its own
    by_id = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.groupBy("v", "dim", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    kept = kept.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1).join(distinct.select("v", "query"), "v", "left")
    kept = stage(kept.select("vec_id", "dim", "v", "copies", F.when(F.col("place") == 1, F.col("query")).alias("query"), F.monotonically_increasing_id().alias("row")), "vectors-kept")
    placed = kept.join(places(kept, kind, curves, seed), "row").select("vec_id", "v", "copies", "query", F.transform("places", lambda p: F.struct(p["curve"].alias("curve"), F.floor(p["at"] / block).alias("block"))).alias("places"))
    placed = stage(placed, "placed")
    dealt = placed.select("vec_id", "v", "copies", F.inline("places"))
    down = placed.filter(F.col("query").isNotNull()).select("query", "v", F.inline("places"))
    down = down.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    found = dealt.groupBy("curve", "block").cogroup(down.groupBy("curve", "block")).applyInArrow(_near(kind, k), FOUND)
    found = top(found.repartition("query").distinct(), k)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "copies"))).alias("found"))  # 2 k at most
    lists = stage(distinct.join(lists, "query").select("v", "n", "found"), "found")
    each = join_counted(asked.withColumnRenamed("vec_id", "query_id"), lists, "v", "n", asked.count())
    others = F.transform(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), lambda x: F.array_repeat(x, x["copies"]))
    others = F.slice(F.flatten(others), 1, k)
    return each.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
