"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import language_model, licences

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (
    SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sized GROUP BY source),
levels AS (
    SELECT *, row_number() OVER w AS turn,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
    FROM per
    WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST),
        before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE (3 * source_size)::DOUBLE / weight >= level ORDER BY turn LIMIT 1),
plan AS (
    SELECT source, source_size, coalesce(least((3 * source_size)::DOUBLE, weight * (SELECT level FROM chosen)), (3 * source_size)::DOUBLE) AS target FROM per),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM plan)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""

#: Every payload is a response but for those of which an equal one has a larger page_id.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, payload, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS latest FROM p)
SELECT page_id, payload_bytes,
    translate(array_to_string(list_transform(range(8), lambda k: to_base(('0x' || substr(digest, (1 + 5 * k)::BIGINT, 5))::BIGINT, 32, 4)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to,
    NULL::VARCHAR AS problem
FROM h
"""


LANGUAGE_MODEL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS spot FROM texts),
pairs AS (SELECT a.rid, a.w AS v, b.w, a.spot FROM words a JOIN words b ON a.rid = b.rid AND b.spot = a.spot + 1),
word_own AS (SELECT rid, w, count(*) AS own FROM words GROUP BY ALL),
word_rest AS (SELECT rid, w, own, sum(own) OVER (PARTITION BY w) - own AS others FROM word_own),
pair_own AS (SELECT rid, v, w, count(*) AS own FROM pairs GROUP BY ALL),
pair_rest AS (SELECT rid, v, w, own, sum(own) OVER (PARTITION BY v, w) - own AS others FROM pair_own),
size AS (SELECT rid, doc_id, len(ws) AS n, greatest(sum(len(ws)) OVER () - len(ws), 1)::DOUBLE AS rest FROM texts),
logs AS (
    SELECT p.rid, p.own * CASE WHEN p.others > 0 THEN ln(p.others) - ln(a.others) ELSE ln({language_model.BACKOFF}) + ln(greatest(b.others, {language_model.UNSEEN})) - ln(s.rest) END AS x
    FROM pair_rest p JOIN word_rest a ON a.rid = p.rid AND a.w = p.v JOIN word_rest b ON b.rid = p.rid AND b.w = p.w JOIN size s ON s.rid = p.rid
    UNION ALL
    SELECT f.rid, ln(greatest(r.others, {language_model.UNSEEN})) - ln(s.rest) FROM words f JOIN word_rest r ON r.rid = f.rid AND r.w = f.w JOIN size s ON s.rid = f.rid WHERE f.spot = 0)
SELECT any_value(s.doc_id) AS doc_id, any_value(s.n)::BIGINT AS n_words, round(sum(x) / any_value(s.n), 6) AS score
FROM size s LEFT JOIN logs ON logs.rid = s.rid GROUP BY s.rid
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _tidied(text: str) -> str:
    """The same steps, with references and line ends as DuckDB writes them."""
    for pattern, to in licences.TIDY:
        to = " || chr(10) || ".join(f"'{x}'" for x in to.replace("$", chr(92)).split(chr(10)))
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


def _unnamed(norm: str) -> str:
    for pattern, to in licences.NAMES:
        norm = f"regexp_replace({norm}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return norm


LICENCES = rf"""
WITH known(norm, id) AS (VALUES {_values([(s, i) for i, forms in licences.SENTENCES.items() for s in forms])}),
rules(place, licence, n, ids) AS (VALUES {_values([(k, name, len(own), ",".join(own)) for k, (name, own) in enumerate(licences.RULES)])}),
texts AS (
    SELECT row_number() OVER () AS rid, doc_id,
        string_split(regexp_replace(regexp_replace({_tidied("text")}, '{licences.ENDS}', '\1' || chr(1), 'g'), '{licences.GAPS}', chr(1), 'g'), chr(1)) AS parts
    FROM documents),
named AS (
    SELECT rid, doc_id, flatten(list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '{licences.TAG}') THEN
        list_transform(string_split_regex(regexp_replace(regexp_replace(s, '{licences.EXCEPT}', '', 'g'), '{licences.TAG}', ''), '{licences.JOINS}'),
            lambda x: 'SPDX-License-Identifier: ' || regexp_replace(x, '{licences.PLUS}', '-or-later')) ELSE [s] END)) AS parts
    FROM texts),
pieces AS (SELECT rid, doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS spot FROM named),
plain AS (SELECT rid, doc_id, spot, trim(regexp_replace(lower(s), '{licences.REST}', ' ', 'g')) AS norm FROM pieces),
sentences AS (SELECT rid, doc_id, spot, {_unnamed("norm")} AS norm FROM plain),
marks AS (
    SELECT s.rid, s.doc_id, s.spot, k.id, row_number() OVER (PARTITION BY s.rid ORDER BY s.spot) AS nth
    FROM sentences s LEFT JOIN known k ON k.norm = s.norm WHERE k.id IS NOT NULL OR NOT regexp_matches(s.norm, '{licences.ALONE}')),
tried AS (
    SELECT a.rid, a.doc_id, a.spot, a.nth, r.place, r.licence, r.n, r.ids, max(b.spot) AS last,
        string_agg(coalesce(b.id, '?'), ',' ORDER BY b.nth) AS found
    FROM marks a JOIN rules r ON split_part(r.ids, ',', 1) = a.id JOIN marks b ON b.rid = a.rid AND b.nth BETWEEN a.nth AND a.nth + r.n - 1
    GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY rid, nth ORDER BY place) AS turn FROM tried WHERE found = ids)
SELECT doc_id, licence, spot::INTEGER AS first_sentence, last::INTEGER AS last_sentence, ids AS sentence_ids FROM best WHERE turn = 1
"""


PRODUCTS = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

#: Near words share a form: a letter replaced by a mark, or the longer one's form without a letter.
SPELLING = r"""
WITH RECURSIVE tables AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT *, hex(encode(id || run)) AS code FROM per),
hashed AS (
    SELECT run, n, xor(list_reduce(list_transform(range(length(code) // 2), lambda k: ('0x' || substr(code, 2 * k + 1, 2))::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) AS h
    FROM coded, tables),
slipped AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
marked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS form FROM spots),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS form FROM spots),
longer AS (SELECT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN words w ON w.word = c.form),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM marked a JOIN marked b ON a.form = b.form AND a.word <> b.word
    UNION ALL SELECT a, b, bn FROM longer
    UNION ALL SELECT b, a, an FROM longer),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(encode(p.other)) AS other FROM pairs p JOIN near ON near.word = p.word AND p.other_n = near.top GROUP BY p.word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN decode(other) END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
    FROM words w LEFT JOIN near ON near.word = w.word LEFT JOIN best ON best.word = w.word),
walk AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
SELECT f.word, f.form, walk.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING, "op2_language_model": LANGUAGE_MODEL, "op8_licences": LICENCES, "op9_warc": WARC, "op12_top_products": PRODUCTS, "op13_spelling": SPELLING}
