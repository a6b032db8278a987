"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from platen.llm import queries, spelling

from .edge import TEXTS, clashing, documents

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slips=97, least=3):
    """word: (form, root, n, n_near, form_n), from (doc_id, text); partners by all edits of a word that are words."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= least}
    letters = sorted({c for w in n for c in w})
    form, out = {}, {}
    for w, k in n.items():
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near = [x for x in edits if x != w and x in n]
        assert all(one_edit(w, x) for x in near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * k else None
        out[w] = (k, len(near), form[w] and n[best])
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), *out[w]) for w in n}


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcde", "abcdefghijklmnoÀéœ字"])
def test_search_finds_all_pairs(letters):
    rng = random.Random(letters)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    members, same, longer = sorted({word(6) for _ in range(400)}), sorted({word(5) for _ in range(300)}), sorted({word(6) for _ in range(300)})
    for lookers in (same, longer):
        i, j = spelling._search(members, lookers)
        got = [(lookers[a], members[b]) for a, b in zip(i, j, strict=True)]
        assert sorted(got) == [(a, b) for a in lookers for b in members if one_edit(a, b)]


def test_many_words_of_the_same_letters():
    members = ["".join(p) for p in itertools.permutations("abcdef")]
    for lookers in (["".join(p) for p in itertools.permutations("abcdeg")], ["".join(p) for p in itertools.permutations("bcdef")]):
        i, j = spelling._search(members, lookers)
        assert len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True)))
        assert sorted((lookers[a], members[b]) for a, b in zip(i, j, strict=True)) == sorted((a, b) for a in lookers for b in members if one_edit(a, b))


def test_trees_that_spark_splits(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.choice((5, 5, 6, 7)))) for _ in range(3000)})
    words += ["".join(p) for p in itertools.permutations("vwxyz")] * 1  # a node that can't be split
    counts = {w: rng.choice((3, 3, 4, 7, 20, 300)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {(r["word"], r["other"], r["other_n"]) for r in spelling.near_words(df, leaf=40).collect()}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), []).append(w)
    want = {(a, b) for v in by.values() for a in v for b in v if a != b} | {p for w in words for i in range(len(w)) if (c := w[:i] + w[i + 1 :]) in counts for p in ((w, c), (c, w))}
    assert near == {(a, b, counts[b]) for a, b in want}
    assert spelling.near_words(df, leaf=40).count() == len(near)
    tree = spelling.splits(df, len(words), 40)
    assert len(tree) > 20
    got = {r["word"]: r for r in spelling.variants(df, leaf=40).collect()}
    assert set(got) == set(counts)
    for w, r in got.items():
        end = w
        while got[end]["form"]:
            end = got[end]["form"]
        assert r["root"] == end


@pytest.mark.parametrize("source", ["edge", "table"])
def test_query_by_brute_force(spark, source, tmp_path):
    sf = SF
    if source == "edge":
        more = [(i, "Colour colour colours Colour Étude étude etude x×÷yzw", "en", "z") for i in range(400)]
        clashing(documents(spark, TEXTS + more)).write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    df = queries.op13_spelling(spark, sf)
    got = rows_of(df)
    assert got == want and df.count() == len(want) and any(w[1] for w in want)


def test_empty_and_missing(spark):
    docs = documents(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "ab cd 12", "en", "a")])
    assert rows_of(spelling.variants(spelling.word_counts(docs))) == set()
    assert rows_of(spelling.variants(spelling.word_counts(docs.limit(0)))) == set()
    counts = spark.createDataFrame([("first", 9), ("firsts", 3), (None, 9), ("never", None), ("étoile", 8), ("etoile", 4)], "word string, n long")
    assert rows_of(spelling.variants(counts)) == {("first", None, "first", 9, 1, None), ("firsts", "first", "first", 3, 1, 9), ("étoile", None, "étoile", 8, 1, None), ("etoile", "étoile", "étoile", 4, 1, 8)}


def test_letters_beyond_a_to_z_only_come_nearer():
    rng = random.Random(4)
    words = ["".join(chr(rng.choice((97, 98, 233, 0x4E00, 0x1F600))) for _ in range(6)) for _ in range(200)]
    at = spelling.points(words).astype(int)
    for i, j in ((rng.randrange(200), rng.randrange(200)) for _ in range(2000)):
        a, b = Counter(words[i]), Counter(words[j])
        assert np.abs(at[i] - at[j]).sum() <= sum(abs(a[c] - b[c]) for c in a | b)
