"""Mixing, packing, WARC, fingerprints and SimHash against brute force on small tables."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from platen.llm import fingerprints, mixing, packing, queries, simhash, warc

from .edge import clashing, documents

SF = "/root/testdata/sf0.001"


def test_mixing_targets_by_iteration(spark):
    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    out = mixing.with_copies(clashing(docs), "doc_id", "source", mixing.words(F.col("text"))).collect()
    sizes, got = Counter(), defaultdict(int)
    for r in out:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["mix_size"]
        got[r["source"]] += r["mix_size"] * r["mix_copies"]
        assert r["mix_copies"] <= 3
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # as the contract words it
        free = [s for s in names if s not in capped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in out:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(target[r["source"]])
    assert len(out) == docs.count()
    assert mixing.mix(docs).count() == sum(r["mix_copies"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


INTERNAL = "mix_size mix_source_size mix_target mix_copies mix_source mix_rate mix_rows mix_copy llm_key llm_row n root".split()


def test_columns_of_any_name_stay(spark, monkeypatch):
    docs = documents(spark).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INTERNAL})
    for limit in (50_000, 0):  # broadcast plan, counted join
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        want = {r["doc_id"]: tuple(r) for r in docs.collect()}
        copies = Counter(r["doc_id"] for r in mixing.mix(documents(spark)).collect())
        assert Counter(r["doc_id"] for r in mixed.collect()) == copies
        assert all(tuple(r) == want[r["doc_id"]] for r in mixed.collect() if r["doc_id"] is not None and sum(x["doc_id"] == r["doc_id"] for x in docs.collect()) == 1)
    added = mixing.with_copies(docs, "doc_id", "source", mixing.words(F.col("text")))
    assert set(added.columns) == set(docs.columns) and added.schema["mix_size"].dataType.simpleString() == "bigint"
    kept = simhash.keep_one(docs)
    rows = {tuple(r) for r in docs.collect()}
    assert kept.columns == docs.columns and all(tuple(r) in rows for r in kept.collect())
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, (r["doc_id"] for r in simhash.keep_one(documents(spark)).collect())))


def test_the_same_one_stays_however_rows_lie(spark):
    rows = [(7, "one two three four", "b"), (7, "one two three four", "a"), (7, "one two three four", "a"), (9, "one two three four", "c"), (None, "one two three four", "d"), (None, None, "x"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(r) for r in simhash.keep_one(docs).collect()}
    assert len(kept) == 2 and {r[0] for r in kept} == {7, None}
    for n in (1, 3, 7):
        for again in (docs, docs.orderBy(F.desc("source"))):
            assert {tuple(r) for r in simhash.keep_one(again.repartition(n)).collect()} == kept


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id >= 100"))
    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(clashing(docs), queries.tokenizer_path(), group_tokens=30_000).collect()
    want = Counter((r["doc_id"], (*t.encode(r["text"] or "", add_special_tokens=False).ids, 2)) for r in docs.collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (key, n), own in pieces.items():
        same = [ids for (k, ids), c in want.items() for _ in range(c) if k == key and len(ids) == n]
        starts = Counter(r["start"] for r in own)
        assert sum(r["length"] for r in own) == sum(map(len, same))
        if len(same) == 1:
            assert max(starts.values()) == 1
            assert b"".join(r["ids"] for r in sorted(own, key=lambda r: r["start"])) == struct.pack(f"<{n}I", *same[0])
    assert sum(want.values()) == docs.count()
    padding = total = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        n = sum(n for _, n in own)
        assert n <= 4096
        total += n
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding == 0 and total == sum(len(ids) * c for (_, ids), c in want.items())
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_balances_cost():
    got = packing.assign([100] * 400 + [3000, 2000, 1500, 900, 4096, 5000], 4096, 1.0, 1 / 4096)
    cost, filled = defaultdict(float), Counter()
    for _, _, n, seq, offset, price in got:
        assert offset == filled[seq]
        filled[seq] += n
        cost[seq] += price
    assert set(filled.values()) <= {1 << k for k in range(13)}
    assert got == packing.assign([100] * 400 + [3000, 2000, 1500, 900, 4096, 5000], 4096, 1.0, 1 / 4096)


def test_special_strings_are_encoded_as_the_whole_text(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "x<|endoftext|>y 's't", " a b\x85c", "é é ́x ΣΑΣ", "", "  "]
    t = Tokenizer.from_file(queries.tokenizer_path())
    flat, ends = packing.WordIds(queries.tokenizer_path()).of_texts(pa.array(texts), 2)
    want = [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    assert flat.tolist() == want and len(ends) == len(texts)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, ids = ["Hello  World\n\tx's <|endoftext|>", "", "é È", None], packing.WordIds(path)
    assert not ids.by_word and packing.WordIds(queries.tokenizer_path()).by_word
    flat, ends = ids.of_texts(pa.array(texts), 2)
    t = Tokenizer.from_file(path)
    assert flat.tolist() == [i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]] and len(ends) == 4


def page_rows(spark):
    rows = [(1, "http://a/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u%2", "<p>same</p>"), (4, "http://b", None), (5, "http://c", ""), (6, "http://\r\nd", "ü" * 100000), (None, "http://e", "<p>same</p>"), (None, None, "alone"), (3, "again", "<p>same</p>")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, payload string, record_id string").withColumn("n", F.lit(1))


def test_warc_round_trip(spark):
    pages = page_rows(spark)
    full = pages.withColumn("payload", F.coalesce("payload", F.lit("")))
    manifest = warc.write_warc(warc.with_revisits(full), archive_bytes=1000)
    got = warc.read_archives(manifest).collect()
    want = Counter()
    for r in full.collect():
        data = r["payload"].encode()
        same = [x["page_id"] for x in full.collect() if x["payload"] == r["payload"] and x["page_id"] is not None]
        latest = max(same, default=None)
        old = latest is not None and r["page_id"] != latest
        want[r["page_id"], r["url"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if old else "response", latest if old else None, None if old else data] += 1
    assert want == Counter((r["page_id"], r["target_uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    assert not any(r["problem"] for r in got)
    folder = manifest.first()["path"].rpartition("/")[0]
    for most in (1 << 30, 0):  # through Spark's reader, as streams
        assert Counter((r["record_id"], r["payload_digest"], r["problem"]) for r in warc.read_warc(spark, folder, most).collect()) == Counter((r["record_id"], r["payload_digest"], None) for r in got)
    for r in manifest.collect():  # every archive begins with a dictionary
        with open(r["path"].removeprefix("file:"), "rb") as f:
            head = f.read()
        assert struct.unpack_from("<I", head)[0] == warc.SKIPPABLE and head[8:12] == struct.pack("<I", 0xEC30A437)
    clash = warc.with_revisits(full.withColumns({c: F.lit(c) for c in ("refers_to", "payload_digest", "record_type", "warc_payload", "warc_latest", "n")}))
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in clash.collect()) == Counter((k, t, to) for (k, _, _, _, t, to, _), c in want.items() for _ in range(c))
    assert {(r["warc_payload"], r["n"]) for r in clash.collect()} == {("warc_payload", "n")}
    assert warc.read_archives(warc.write_warc(warc.with_revisits(full.limit(0)))).count() == 0


def test_warc_reader_checks():
    good = warc.record_bytes(1, "http://a", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "response", None, "2000-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor(write_checksum=True).compress
    read = lambda data: [r.get("problem") for r in warc.read_records(data)]
    assert read(frame(good) + frame(good)) == [None, None]
    assert read(frame(good.replace(b"abc", b"abd")) + frame(good)) == ["payload digest doesn't match", None]
    assert read(frame(good[:-1])) == ["content-length doesn't match the record"]
    assert read(frame(good)[:-3]) == ["truncated frame"]
    assert read(frame(good.replace(b"WARC/1.1", b"WORC/1.1"))) == ["no WARC version"]
    assert read(struct.pack("<II", warc.SKIPPABLE, 99)) == ["truncated dictionary"]
    assert read(b"") == [] and read(frame(good) + b"xx")[0] is None and read(frame(good) + b"xx")[1].startswith("no frame")


def test_archives_with_plain_and_packed_dictionaries():
    import io

    rows = [(i, f"<html><p>page {i} of the archive</p>" * 20) for i in range(200)]
    made = [warc.record_bytes(i, f"http://a/{i}", p.encode(), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(), "response", None, "2000-01-01T00:00:00Z") for i, p in rows]
    words = warc.trained([p.encode() for _, p in rows], made[:5])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    frames = b"".join(map(packer.compress, made))
    for own in (words, zstandard.ZstdCompressor().compress(words)):
        archive = struct.pack("<II", warc.SKIPPABLE, len(own)) + own + frames + struct.pack("<II", 0x184D2A50, 3) + b"xyz" + packer.compress(made[0])
        for source in (archive, io.BytesIO(archive)):
            got = list(warc.read_records(source))
            assert [(r.get("page_id"), r.get("payload"), r.get("problem")) for r in got] == [(i, p.encode(), None) for i, p in [*rows, rows[0]]]
        for step in (1, 7, 1000):  # frames across reads
            cut = warc.Cut(io.BytesIO(archive), step)
            cut.take(8 + len(own))
            assert [zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompressobj().decompress(cut.frame()) for _ in rows] == made
    assert next(warc.read_records(frames))["problem"]  # without its dictionary nothing can be read
    assert len(warc.trained([], made[:1])) >= 100


def test_ranges_split_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(-(1 << 63)).cast("long")).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("at"))
    got = rows.withColumn("r", fingerprints.ranges_of(rows, 12)("k", "at")).collect()
    assert max(Counter(r["r"] for r in got).values()) < 600
    placed = [r["r"] for r in sorted(got, key=lambda r: (r["k"], r["at"]))]
    assert placed == sorted(placed)


def test_fingerprints_of_a_hot_key(spark):
    rows = [(None, f"text {i % 40}") for i in range(300)] + [(5, None)] * 50 + [(i, f"t {i}") for i in range(6, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.neighbours(df).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((k, len(t or "")) for k, t in rows)
    assert {r["near_next"] for r in got if r["doc_id"] and r["doc_id"] > 5} == {0.0} and sum(r["near_next"] for r in got if r["doc_id"] == 5) == 49


def test_fingerprints_by_brute_force(spark):
    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id >= 50"))
    got = fingerprints.neighbours(clashing(docs)).collect()
    at = {t: (h ^ 1 << 63) - (1 << 63) for t in (r["text"] or "" for r in docs.collect()) for h in [xxhash.xxh64_intdigest(t.encode(), 42)]}
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in docs.collect()), key=lambda r: (r[0], at[r[1]], r[1].encode()))
    want = Counter()
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (fingerprints.canonical(x) for x in (text, edited, after))
        want[None if key == -(1 << 63) else key, len(text), hashlib.sha256(edited.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(a), xxhash.xxh3_128_hexdigest(b), float(a == b), float(a == c)] += 1
    assert want == Counter(tuple(r) for r in got)
    assert fingerprints.neighbours(docs.limit(0)).count() == 0
    assert fingerprints.neighbours(docs.limit(1)).first()["near_next"] == 1.0


def test_fingerprints_of_equal_hash_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a  B"), (2, "A b"), (3, "c"), (4, None), (5, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.classes(docs).collect()}
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[2]["first_key"] == 1 and rows[2]["copies"] == 2
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] != rows[3]["fingerprint"]
    packed = spark.createDataFrame([("h", b"a"), ("h", b"b"), ("g", b"a"), ("g", b"a"), ("e", None)], "hash string, packed binary")
    assert [r[0] for r in fingerprints.mixed_buckets(packed).collect()] == ["h"]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark):
    docs = documents(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = simhash.near_duplicates(clashing(docs)).collect()
    rows = docs.collect()
    fps = [brute_simhash(r["text"]) for r in rows]
    groups = brute_components(fps)
    low = {}
    for r, g in zip(rows, groups, strict=True):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f - (1 << 64) * (f >> 63), low.get(g)) for r, f, g in zip(rows, fps, groups, strict=True))
    assert want == Counter((r["key"], r["fp"], r["component_id"]) for r in got)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(groups)) and kept[0].asDict().keys() == rows[0].asDict().keys()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_every_close_pair(spark):
    import random

    random.seed(5)
    bases = [random.getrandbits(64) for _ in range(60)]
    fps = {b for b in bases}
    for b in bases[:50]:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                fps.add(b ^ sum(1 << k for k in random.sample(range(64), n)))
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = defaultdict(set)
    for f, g in zip(signed, brute_components(fps), strict=True):
        want[g].add(f)
    got = defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("width", "radius"), [(5, 1), (2, 4), (1, 2), (3, 0)])
def test_simhash_of_other_widths_and_radii(spark, width, radius):
    docs = documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    got = [(r["fp"], r["root"]) for r in simhash.near_duplicates(docs, width=width, radius=radius).collect()]
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))] if words else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.simhash(r["text"] or "", width) == want
    fps = sorted({f for f, _ in got})
    root = {f: f for f in fps}
    for _ in fps:  # the smallest fingerprint in reach, by spreading it
        near = {f: min(root[g] for g in fps if ((f ^ g) & (1 << 64) - 1).bit_count() <= radius) for f in fps}
        if near == root:
            break
        root = near
    assert dict(got) == root
    assert len(simhash.keep_one(docs, width=width, radius=radius).collect()) == len(set(root.values()))
    with pytest.raises(ValueError, match="radius 5"):
        simhash.links(docs.select(F.lit(1).alias("fp")), 5)


def test_crc_is_of_little_endian_ids(spark):
    r = spark.createDataFrame([(struct.pack("<2I", 5, 49407),)], "ids binary").select(F.crc32("ids")).first()[0]
    assert r == zlib.crc32(struct.pack("<2I", 5, 49407))


def test_a_packing_worker_remembers_few_words():
    """Several workers share an executor's memory, so none keeps more than some hundred thousand words."""
    import pyarrow as pa

    from platen.llm import packing, queries

    ids = packing.WordIds(queries.tokenizer_path())
    for k in range(5):
        flat, ends = ids.of_texts(pa.array([" ".join(f"w{k * 80_000 + i:x}q" for i in range(80_000))]), 2)
        assert len(flat) == ends[-1] and len(ids.known) <= 300_000
