"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platen.llm import queries, repeats

from .edge import clashing, documents

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every maximal stretch of every period, the shortest period of each, sorted."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@given(st.integers(1, 4), st.integers(0, 60), st.integers(1, 20), st.integers(0, 30), st.randoms(use_true_random=False))
@settings(max_examples=400, deadline=None)
def test_runs_of_mixed_texts(kinds, before, period, times, rng):
    words = [rng.randrange(kinds) for _ in range(before)]
    again = [rng.randrange(kinds) for _ in range(period)]
    words += again * times + [rng.randrange(kinds) for _ in range(before // 2)]
    assert [tuple(r) for r in repeats.runs(np.array(words, np.int64)).tolist()] == brute(words)


@given(st.lists(st.integers(0, 2), min_size=2, max_size=150), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_extensions_word_by_word(words, rng):
    n = len(words)
    pairs = [(i, j) for i, j in ((rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(60)) if i != j]
    if not pairs:
        return
    got = repeats.Extensions(np.array(words, np.int64)).of(*np.array(pairs).T)
    for (i, j), k in zip(pairs, got.tolist(), strict=True):
        want = 0
        while max(i, j) + want < n and words[i + want] == words[j + want]:
            want += 1
        assert k == want


def test_long_texts_take_time_in_proportion():
    assert repeats.runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    words = np.tile(np.arange(1000), 300)
    assert repeats.runs(words).tolist() == [[0, 300_000, 1000]]
    both = np.tile(np.concatenate([np.zeros(50, np.int64), np.arange(1, 51)]), 200)  # runs in every period of a run
    found = repeats.runs(both)
    assert len(found) == 201 and [0, 20_000, 100] in found.tolist()


def test_a_chunk_at_a_time(monkeypatch):
    monkeypatch.setattr(repeats, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = np.concatenate([rng.integers(0, 3, 20), np.tile(rng.integers(0, 3, 5), rng.integers(2, 9)), rng.integers(0, 2, 30)])
        assert [tuple(r) for r in repeats.runs(words).tolist()] == brute(words.tolist())


def by_period(words):
    """As brute, a period at a time."""
    numbers = {}
    w, found = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64), {}
    for q in range(1, len(w) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    """The contract's row, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_period(words)
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("source", ["edge", "table"])
def test_query_by_brute_force(spark, source, tmp_path):
    if source == "edge":
        more = [(i, "a b c " * 7 + "d", "en", "z") for i in range(100, 160)] + [(i, "x y " * 2, "en", "z") for i in range(200, 260)]
        from .edge import TEXTS

        docs = clashing(documents(spark, TEXTS + more))
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    else:
        sf = SF
        docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op11_periodic_runs(spark, sf).collect()
    want = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_runs"] for r in got) > 20


def test_what_stays_of_a_text(spark):
    docs = documents(spark, [(1, "so a b a b a b a b it ends", "en", "a"), (2, None, "en", "a"), (3, " \t\n", "en", "a"), (3, " \t\n", "en", "a")])
    got = {(r["key"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in repeats.periodic_runs(docs).collect()}
    assert got == {(1, 11, ((1, 8, 2),), "so a b it ends"), (2, 0, (), ""), (3, 0, (), "")}
    assert repeats.periodic_runs(docs.limit(0)).collect() == []
