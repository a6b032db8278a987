"""Language model, neighbours, toxicity, HTML extraction, licences and the pipeline on small tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platen.llm import html_text, language_model, licences, neighbours, queries, toxicity
from platen.llm.pages_labelled import labelled_pages

from .edge import clashing, documents

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_scores(texts, order=2):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1))
    counts = sum(map(grams, docs), Counter())
    total, out = sum(map(len, docs)), []
    for d in docs:
        own, rest = grams(d), max(1, total - len(d))

        def log(g, own=own, rest=rest):
            c = counts[g] - own[g]
            if len(g) == 1:
                return math.log(max(c, 0.5) / rest)
            return math.log(c / (counts[g[:-1]] - own[g[:-1]])) if c > 0 else math.log(0.4) + log(g[1:])

        logs = [log(tuple(d[max(0, i - order + 1) : i + 1])) for i in range(len(d))]
        out.append((len(d), sum(logs) / len(d) if d else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_language_model_by_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(language_model, "BATCH_CHARS", 20_000)
    monkeypatch.setattr(language_model, "BUCKET_GRAMS", 2_000)
    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id > 120"))
    rows = docs.collect()
    got = language_model.score(clashing(docs), order=order).collect()
    key = lambda k, n, s: (k, n, None if s is None else round(s, 9))
    assert Counter(key(*r) for r in got) == Counter(key(r["doc_id"], *x) for r, x in zip(rows, brute_scores([r["text"] for r in rows], order), strict=True))
    assert language_model.score(docs.limit(0)).count() == 0


def test_count_table_by_brute_force(spark):
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        d = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want.update(language_model.gram_hash(d[i : i + k]) for k in (1, 2, 3) for i in range(len(d) - k + 1))
    assert dict(want) == {r["gram"]: r["n"] for r in language_model.count_table(docs, 3).collect()}


def test_only_parts_that_occur_are_sent():
    import pyarrow as pa

    g = language_model.Grams(pa.chunked_array([["a b c", "a b"]]), 2)
    assert sum(len(own) for _, own in g.by_part(1 << 40)) == 5 and len(g.by_part(1 << 40)) == 5


def test_packed_hashes_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (language_model.unpacked(language_model.packed(x)) == x).all()


def brute_nearest(rows, k=20):
    ok = {i: v for i, v in rows if v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = set()
    for q, a in ok.items():
        if q % 20 == 0:
            best = sorted(((-math.fsum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok.items() if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(4))]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 460)]  # a hot vector, ties
    rows += [(460, None), (461, [0.0] * 4), (462, [1.0, float("nan"), 0.0, 0.0]), (463, [None, 1.0, 1.0, 1.0]), (464, [1.0, 2.0]), (480, []), (500, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("query", F.lit("x"))
    got = {tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute_nearest(rows)
    few = neighbours.search(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in np.float32(rng.standard_normal(4))]
    rows = [(i, vector()) for i in range(200)]
    rows += rows  # each row twice
    rows += [(220, rows[0][1])] * 30 + [(240, vector())] * 45  # hot keys of equal rows
    rows += [(260, vector()) for _ in range(60)] + [(280, rows[7][1])]  # a hot key of distinct vectors
    rows += [(20, rows[20][1][::-1]), (300, [0.5] * 4), (300, [0.5, 0.5, 0.5, -0.5]), (300, [-0.5, 0.5, 0.5, 0.5])]  # ids of several vectors, ties
    rows += [(i, rows[3][1]) for i in range(400, 440)] * 3  # a hot vector
    want = []
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((-math.fsum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0).collect())) == Counter(want)
    only = spark.createDataFrame([(20, [1.0, 0.0])] * 50 + [(1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(only, F.col("vec_id") == 20).distinct().collect()] == [(20, 1, 1, 1.0)]


def test_recall_of_windows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] + 0.15 * rng.standard_normal(32))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([v for _, v in rows])
    want = {(q, int(i)) for q in range(0, 3000, 20) for i in [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]}
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, curves=4, block=100).collect()}
    assert len(want & found) >= 0.9 * len(want)
    again = {(r["query_id"], r["vec_id"]) for r in neighbours.search(df.repartition(5), F.col("vec_id") % 20 == 0, curves=4, block=100).collect()}
    assert again == found  # whatever the partitions


def test_recall_on_the_table(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0, block=256).collect()}
    want = {(int(q), int(i)) for q in ids if q % 20 == 0 for i in [j for j in ids[np.argsort(-(m @ x[q]), kind="stable")] if j != q][:20]}
    assert len(want & found) >= 0.9 * len(want)


def test_neighbours_of_each_dimension(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0, 1.0]), (20, [0.0, 2.0, 0.0]), (3, [0.0, 1.0, 0.0]), (40, [1.0])]
    got = {tuple(r) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 1, 0.5), (20, 1, 2, 2.0), (20, 2, 3, 2.0)}


def test_hilbert_neighbours_are_one_step_apart():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.1", "documents"), queries.table(spark, "/root/testdata/sf0.1", "labels")
    out = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").filter("held_out and toxic is not null").collect()
    assert docs.count() == queries.op5_toxicity(spark, "/root/testdata/sf0.1").count()
    right = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    assert right > 0.96
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_toxicity_edge_cases(spark):
    docs = clashing(documents(spark))
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    score = toxicity.score_udf(docs, toxicity.fit(docs, nothing))
    assert all(r[0] < 1e-9 for r in docs.select(score("text")).collect())
    some = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (4, None, None), (5, 0, 1), (7, 1, 0), (8, 1, 0), (9, 1, 1), (None, 1, 1), (2, 1, 0)], nothing.schema)
    kept = toxicity.without_toxic(docs, some)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert toxicity.without_toxic(docs.limit(0), some).count() == 0


def test_toxic_words_are_learned_and_rare_ones_ignored(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))] + [f"rare{i}"]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    score = toxicity.score_udf(docs, toxicity.fit(docs, labels))
    got = {r[0]: r[1] for r in docs.select("doc_id", score("text")).collect()}
    assert sum((got[i] >= 0.5) == y for i, _, y in rows) / len(rows) > 0.99


def test_spans_by_brute_force():
    import pyarrow as pa

    texts = pa.array(["a b c", "", None, "c", "a a z", "Q, b! a"])
    tables = toxicity.Tables(["", "a", "b", "c"], np.array([0.25, 1.0, -2.0, 5.0, 0.25]), np.zeros(5), np.zeros(0, np.int64), np.zeros(0))
    odds = {"a": 1.0, "b": -2.0, "c": 5.0}
    got = tables.features(texts, (1, 2, 3))
    for t, row in zip(texts.to_pylist(), got, strict=True):
        w = [odds.get(v, 0.25) for v in re.findall(r"\w+", (t or "").lower())]
        assert row[0] == pytest.approx(sum(w) / len(w) if w else 0)
        for span, x in zip((1, 2, 3), row[1:], strict=True):
            n = min(span, len(w))
            assert x == pytest.approx(max((sum(w[i : i + n]) / n for i in range(len(w) - n + 1)), default=0) if w else 0)


def brute_kneser_ney(rows, d):
    """p(w) and p(w | v) of both classes, as the module's docstring words them."""
    pairs = {1: Counter(), 0: Counter()}
    for y, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        pairs[y].update(zip(["", *w], w, strict=False))
    both = Counter(w for _, w in {*pairs[0], *pairs[1]})
    total, cut = sum(both.values()), toxicity.PAIR_DISCOUNT
    models = {}
    for y in (0, 1):
        m = Counter(w for _, w in pairs[y])
        context, freed = Counter(), Counter()
        for (v, _), n in pairs[y].items():
            context[v] += n
            freed[v] += min(n, cut)

        def low(w, m=m):
            shared = (max(both[w] - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT) / total
            return max(m[w] - d, 0) / sum(m.values()) + sum(min(n, d) for n in m.values()) / sum(m.values()) * shared

        def high(v, w, y=y, low=low, context=context, freed=freed):
            return max(pairs[y][v, w] - cut, 0) / context[v] + freed[v] / context[v] * low(w) if context[v] else low(w)

        models[y] = low, high
    return pairs, models


def test_kneser_ney_by_brute_force(spark, monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(toxicity, "PAIR_DISCOUNT", 2)
    rng = random.Random(9)
    rows = [(int(i % 3 == 0), " ".join(rng.choice("aa bb cc dd ee ff".split() if i % 3 else "aa bb xx yy".split()) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(1, None), (0, "")]
    df = spark.createDataFrame(rows, "toxic int, text string")
    pairs, _ = brute_kneser_ney(rows, 1.0)
    assert {(r["before"], r["word"]): (r["t"], r["o"]) for r in toxicity.pair_counts(df).collect()} == {k: (pairs[1][k], pairs[0][k]) for k in {*pairs[0], *pairs[1]}}
    texts = ["xx yy aa bb", "aa bb cc dd ee", "new words aa", "aa", "", "xx xx xx xx"]
    for d, tables in toxicity.fit_tables(df).items():
        _, m = brute_kneser_ney(rows, d)
        one, two = tables.ratios(toxicity.words(pa.array(texts)))
        flat = [(v, w) for t in texts for v, w in zip(["", *t.split()], t.split(), strict=False)]
        known = [i for i, (_, w) in enumerate(flat) if any(p[1] == w for p in pairs[0] | pairs[1])]
        for i in known:
            v, w = flat[i]
            assert one[i] == pytest.approx(math.log(m[1][0](w) / m[0][0](w)))
            assert two[i] == pytest.approx(math.log(m[1][1](v, w) / m[0][1](v, w)))
        whole = tables.features(pa.array(texts), (1,))[:, 0]
        assert whole[1] == pytest.approx(np.mean([two[i] for i in range(4, 9)])) and whole[4] == 0
    model = toxicity.Model(toxicity.fit_tables(df)[1.0], 2, [0.5, 2.0], -1.0)
    x = model.tables.features(pa.array(texts), (2,))
    assert model.scores(pa.array(texts)) == pytest.approx(1 / (1 + np.exp(-(0.5 * x[:, 0] + 2 * x[:, 1] - 1))))


@pytest.fixture(scope="module")
def field():
    return html_text.fitted()


def test_extraction_on_held_out_layouts(field):
    wrong = total = 0
    for page in labelled_pages(150, seed=5):
        blocks = html_text.leaves(page)
        truth = [int(any(m for _, _, m in b.path)) for b in blocks]
        wrong += sum(a != b for a, b in zip(truth, field.labels(html_text.features(blocks)), strict=True))
        total += len(truth)
    assert wrong / total < 0.04


def test_extraction_of_whole_pages(spark, field):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        "<div class=ad>Buy now.</div><article><h1>A &amp; B</h1><p><b>First&nbsp; line&#33;<br><p>Second\n\t line</p><p>Third &eacute; &lt;x&gt;</p><ul><li>one<li>two</ul><script>x()</script></article>"
        "<div class=comments><p>I disagree with this.</p></div><form><p>Subscribe to us</p></form><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, page), (2, None), (3, ""), (4, page[: page.index("Third") + 14]), (5, "just text"), (6, "<p>" * 3000 + "deep"), (7, "<nav>only menu</nav>"), (8, "&#0;&bogus;<")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("x"))
    got = {r[0]: r[1] for r in df.select("page_id", html_text.extract(spark, F.col("html"), field)).collect()}
    assert got[1] == "A & B\nFirst line!\nSecond line\nThird é <x>\none\ntwo"
    assert got[2] == got[3] == got[7] == "" and got[4] == "A & B\nFirst line!\nSecond line\nThird é"
    assert df.limit(0).select(html_text.extract(spark, F.col("html"), field)).count() == 0


def test_leaves_of_open_heads_and_closed_elements():
    texts = lambda html: [b.text for b in html_text.leaves(html)]
    assert texts("<html><head><title>T</title><meta charset=utf-8><body><p>One</p><p>Two</p></body></html>") == ["One", "Two"]
    assert texts("<head><title>T</title><link rel=x href=y><script>s()</script><style>p{}</style><noscript>n</noscript>\n<article>One<p>Two") == ["One", "Two"]
    assert texts("<head><title>T</title>One <b>two</b>") == ["One two"]
    assert texts("<head><noscript><body><p>One") == ["One"]
    assert texts("<head><title>T</title></head><body><p>One<head></head></body>") == ["One"]
    assert texts("<div>One <svg/> two <math /> three<br/>four</div><p>Five") == ["One two three four", "Five"]
    assert texts("<head><svg/><p>One <svg><title/><g><svg/><path d=x /></g><text>no</text></svg> two") == ["One two"]
    assert texts("<div/>One<p>Two</p>") == ["One", "Two"]


def test_extraction_finds_every_article_of_the_table(spark):
    rows = spark.read.parquet(f"{SF01}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op6_html_text(spark, SF01).collect()}
    for r in rows:
        blocks = [b.text for b in html_text.leaves(r["html"] or "") if any(t == "article" for t, _, _ in b.path)]
        assert got[r["page_id"]] == "\n".join(blocks)


def test_viterbi_by_enumeration(field):
    import itertools

    rows = html_text.features(html_text.leaves(labelled_pages(1, seed=77)[0]))[:9]

    def total(y):
        s = field.start[y[0]] + sum(field.steps[a][b] for a, b in zip(y, y[1:], strict=False))
        return s + sum(sum(field.weights.get(f, 0) for f in row) for row, v in zip(rows, y, strict=True) if v)

    best = max(itertools.product((0, 1), repeat=len(rows)), key=total)
    assert total(best) == pytest.approx(total(field.labels(rows)))


def test_licences(spark):
    mit = " ".join(licences.SENTENCES[k][0].capitalize() + "." for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    texts = ["Intro. Released under the  MIT License. More", mit, "Licensed under the Apache License,\nVersion 2.0. You may not use this", None, "", "This program is free software; you can redistribute it.", "Licensed under CC BY-NC 4.0.\nX", "Not licensed under cc by 4.0.", "// SPDX-License-Identifier: Apache-2.0\nint x;"]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted(tuple(r)[:4] for r in licences.scan(df).collect())
    assert (0, "MIT", 1, 1) in got and (1, "MIT", 0, 3) in got and (2, "Apache-2.0", 0, 0) in got and (6, "CC-BY-NC-4.0", 0, 0) in got and (8, "Apache-2.0", 1, 1) in got
    assert {r[0] for r in got} == {0, 1, 2, 6, 8}
    assert licences.scan(df.limit(0)).count() == 0


def test_marker_words_leave_no_sentence_out():
    marks = licences.marker_words(licences.SENTENCES)
    assert all(any(m in s for m in marks) for forms in licences.SENTENCES.values() for s in forms)
    assert len(marks) < 20 and all(w.isalnum() for w in marks)


_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""


def _gnu(thing, kind, version, colon, later):
    return f"""This {thing} is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License {later}
{version}

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {thing}.  If not, see <https://www.gnu.org/licenses/>."""


_LATER = "as published by\nthe Free Software Foundation"
#: The licences as they are published.
STANDARD = {
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + _ENDORSE + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "GPL-2.0-or-later": _gnu("program", "", "either version 2 of the License, or\n(at your option) any later version.", ";", _LATER + ";"),
    "GPL-3.0-or-later": _gnu("program", "", "either version 3 of the License, or\n(at your option) any later version.", ":", _LATER + ","),
    "AGPL-3.0-or-later": _gnu("program", "Affero ", "either version 3 of the License, or\n(at your option) any later version.", ":", _LATER + ","),
    "LGPL-2.1-or-later": _gnu("library", "Lesser ", "either version 2.1 of the License, or\n(at your option) any later version.", ";", _LATER + ";"),
    "GPL-2.0-only": _gnu("program", "", "the Free Software Foundation.", ";", "version 2 as published by"),
}


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "-- "])
def test_licences_in_their_standard_wording(spark, leader):
    longest = {}
    for name, rule in licences.RULES:
        if len(rule) > len(longest.get(name, [])):
            longest[name] = rule
    texts = [(n, "\n".join((leader + line).rstrip() for line in ("Copyright me.\n\n" + t).split("\n"))) for n, t in STANDARD.items()]
    for a, b in (("* ", "* "), ("1) ", "2) "), ("(1) ", "(2) "), ("a. ", "b. "), ("- ", "- ")):
        texts.append(("BSD-2-Clause", "\n".join(leader + line for line in STANDARD["BSD-2-Clause"].replace("1. ", a).replace("2. ", b).split("\n"))))
    got = {}
    for r in licences.scan(spark.createDataFrame(texts + [(None, "v. 2.0. 1. 2. https://a.b/c\n\n")], "doc_id string, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["licence"], r["sentence_ids"]))
    assert {n: (n, ",".join(longest[n])) in rows for n, rows in got.items()} == dict.fromkeys(STANDARD, True)
    assert all(name == n for n, rows in got.items() for name, _ in rows)
    assert got["BSD-2-Clause"].count(("BSD-2-Clause", ",".join(longest["BSD-2-Clause"]))) == 6


def test_every_rule_applies(spark):
    every = [(i, " ".join(licences.SENTENCES[s][-1] + "." for s in rule)) for i, (_, rule) in enumerate(licences.RULES)]
    hits = {(r["doc_id"], r["licence"], r["sentence_ids"]) for r in licences.scan(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert {(i, name, ",".join(rule)) for i, (name, rule) in enumerate(licences.RULES)} <= hits


def test_licence_sql_on_standard_wordings(spark):
    import duckdb
    import pandas as pd

    from platen.llm import oracle

    rows = [(i, "\n".join(leader + line for line in ("Intro.\n\n" + t).split("\n"))) for i, (t, leader) in enumerate((t, x) for t in STANDARD.values() for x in ("", "# ", " * "))] + [(900, None), (901, "")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = Counter(duckdb.sql(oracle.LICENCES).fetchall())
    assert Counter(tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_pipeline_against_its_operators(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.table(spark, SF01, "documents")
    kept, names = docs, [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash", "mixing", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF01).cache()
        assert after.columns == docs.columns
        if name == "toxicity":
            score = toxicity.score_udf(kept, toxicity.fit(kept, queries.table(spark, SF01, "labels")))
            assert after.count() == kept.filter(score("text") < 0.5).count()
        if name == "simhash":
            from .test_light import brute_components, brute_simhash

            rows = kept.collect()
            groups = brute_components([brute_simhash(r["text"]) for r in rows])
            first = {}
            for r, g in zip(rows, groups, strict=True):
                first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
            assert sorted(first.values()) == sorted(r["doc_id"] for r in after.collect())
        kept = after
    pieces = pipeline.STAGES[-1][1](spark, kept, SF01).collect()
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    edge = documents(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, clashing(edge), SF01).count() >= 0
        assert stage(spark, edge.limit(0), SF01).count() == 0


def test_toxicity_samples_what_has_a_document(spark, monkeypatch):
    """Labels of no document neither shrink the sample nor reach a task; a low rate leaves few, not none."""
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "a calm day ") + "and so on " * 3) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)], "doc_id long, toxic int")
    more = labels.unionByName(spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    one, other = (toxicity.fit(docs, t) for t in (labels, more))
    assert all(np.array_equal(a, b) for a, b in zip(one.tables, other.tables, strict=True))
    texts = pa.array(["you idiot and so on", "a calm day and so on"])
    assert one.scores(texts) == pytest.approx(other.scores(texts))
    monkeypatch.setattr(toxicity, "FIT_DOCUMENTS", 300)
    high, low = toxicity.fit(docs, labels).scores(texts)
    assert high > 0.5 > low


#: Texts, and the licences that are in them.
WORDINGS = [
    *[(_BSD + _ENDORSE.replace("the copyright holder", who) + _AS_IS.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", loud), ["BSD-3-Clause"]) for who, loud in (("Google Inc.", "GOOGLE INC. AND CONTRIBUTORS"), ("the <ORGANIZATION>", "<COPYRIGHT HOLDER>"), ("John Q. Public", "JOHN Q PUBLIC AND CONTRIBUTORS"), ("Foo, Ltd.", "Foo, Ltd. and others"))],
    (_BSD, ["BSD"]),
    (_BSD + "\nSomething else is said here.\n\n" + _AS_IS, ["BSD"]),
    (STANDARD["MIT"].replace("conditions:\n\n", "conditions: "), ["MIT"]),
    ("This project is licensed under the MIT License - see the LICENSE.md file for details.", ["MIT"]),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0. See the notes.", ["Apache-2.0"]),
    ("The code is available under the terms of the MIT license, see LICENSE.txt for more information.", ["MIT"]),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["GPL-2.0-only"]),
    ("/* SPDX-License-Identifier: (LGPL-2.1+ AND (BSD-2-Clause OR 0BSD)) */", ["0BSD", "BSD-2-Clause", "LGPL-2.1-or-later"]),
    ("SPDX-License-Identifier: Unheard-1.0", []),
    ("In no event shall we meet. Neither the name nor the place is known. See the licence.", []),
    ("Neither the name of Foo Inc. is known. Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
]


def test_licence_names_and_expressions(spark):
    import duckdb
    import pandas as pd

    from platen.llm import oracle

    rows = [(i, t) for i, (t, _) in enumerate(WORDINGS)]
    got = [tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {i: sorted({r[1] for r in got if r[0] == i}) for i, _ in rows} == {i: sorted(names) for i, (_, names) in enumerate(WORDINGS)}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert Counter(got) == Counter(duckdb.sql(oracle.LICENCES).fetchall())
