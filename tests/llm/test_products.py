"""Exact top-k products against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platen.llm import products, queries

SF = "/root/testdata/sf0.001"


def brute(rows, divisor=50, k=5, factor=256):
    """(query_id, rank, vec_id, score) of every query, from (vec_id, components)."""
    good = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % divisor == 0:
            scored = sorted((-max(-products.LONG - 1, min(products.LONG, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return Counter(out)


def found(df, **more):
    out = products.search(df, F.col("vec_id") % 50 == 0, **more)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return Counter(map(tuple, out.collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("query", "length", "bucket", "v", "score", "block")})


def test_lengths_that_differ_much(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    x = (centres[rng.integers(0, 12, 2500)] + 0.1 * rng.standard_normal((2500, 8))) * np.exp(rng.standard_normal(2500))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(frame(spark, rows), bucket=100) == brute(rows)  # 25 buckets in three rounds, and blocks


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(300)]
    rows += [(50, [0.0] * 4), (100, [0.0] * 4), (7, None), (150, None), (8, []), (9, [1.0, None, 1.0, 1.0]), (10, [float("nan")] * 4), (200, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1200)] + [(1050, [0.5, 0.5, 0.5, 0.5])] * 30  # many copies, an id of many rows
    rows += [(2000, [1.0]), (2050, [2.0]), (2051, [-3.0]), (3000, [-1e300] * 4), (3001, [1e300] * 4), (3050, [3e15, 0.0, 0.0, 1.0]), (3051, [1.0, 2.0, 3.0, 1e9])]
    with np.errstate(over="ignore"):
        want = brute([(i, None if v and any(x and abs(x) > 1e200 for x in v if x == x) and i not in (3000, 3001) else v) for i, v in rows])
    assert found(frame(spark, rows), bucket=64) == want
    assert found(frame(spark, rows).limit(0)) == Counter()
    assert found(frame(spark, [(50, [1.0, 2.0])])) == Counter()
    assert found(frame(spark, [(3, [1.0, 2.0]), (4, [1.0, 2.0])])) == Counter()


def test_query_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert Counter(map(tuple, queries.op12_top_products(spark, SF).collect())) == brute(rows)


@given(st.integers(0, 10_000), st.floats(0, 3), st.integers(2, 6), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_a_bucket_loses_nothing(seed, spread, d, k):
    rng = np.random.default_rng(seed)
    x = np.floor(50 * rng.standard_normal((200, d)) * np.exp(spread * rng.standard_normal(200))[:, None]) + 0.0
    q = np.floor(50 * rng.standard_normal((30, d))) + 0.0
    scores = (q @ x.T).astype(np.int64)
    floor = np.sort(scores, axis=1)[:, -rng.integers(1, 40)]
    pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    rows = pa.table({"v": pack(x), "vec_id": np.arange(200), "length": products._length(x)})
    asked = pa.table({"v": pack(q), "query": np.arange(30), "vec_id": np.arange(30), "length": products._length(q), "floor": floor})
    got = products._meet(k)(rows, asked).to_pylist()
    for i in range(30):
        want = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if j != i and s >= floor[i])[:k]
        assert sorted((-r["score"], r["vec_id"]) for r in got if r["query"] == i) == want


@pytest.mark.parametrize("share", [0, 1])
def test_either_way_of_pruning(monkeypatch, share):
    """The same results whether all queries prune by length or all by coordinates."""
    monkeypatch.setattr(products, "part_at", lambda *_: np.inf if share else -np.inf)
    rng = np.random.default_rng(9)
    x, q = np.floor(256 * rng.standard_normal((500, 6))), np.floor(256 * rng.standard_normal((40, 6)))
    scores = (q @ x.T).astype(np.int64)
    floor = np.sort(scores, axis=1)[:, -7]
    pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    rows = pa.table({"v": pack(x), "vec_id": np.arange(1000, 1500), "length": products._length(x)})
    asked = pa.table({"v": pack(q), "query": np.arange(40), "vec_id": np.arange(40), "length": products._length(q), "floor": floor})
    got = products._meet(7)(rows, asked).to_pylist()
    for i in range(40):
        assert sorted(r["score"] for r in got if r["query"] == i) == np.sort(scores[i])[-7:].tolist()


def test_threshold_of_least_work():
    cosine, by_length, by_coordinates = np.array([0.1, 0.5, 0.9]), np.array([100.0, 100.0, 100.0]), np.array([300.0, 150.0, 5.0])
    assert products.part_at(cosine, by_length, by_coordinates) == 0.9
    assert products.part_at(cosine, by_length, by_coordinates + 1000) == np.inf
    assert products.part_at(cosine, by_length, by_coordinates / 10) == 0.1
