"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits the variants within half the radius of three: all at one differing bit,
and, if its own bits' sum is odd, those at two. Two fingerprints that differ in three bits have different
parity, so the odd one's two flips meet the even one's single flip; of any three bits two lie in the same
half of the word, so flips of two bits within a half are enough. Fingerprints that differ in two bits meet
at one flip each. Variants are dealt to buckets as packed arrays. Where variants collide, every member of
the run lies within three bits of a member at one flip or none, which becomes the run's root: a run of m
gives m - 1 links, never all pairs, and no connection is lost. Colliding pairs are verified and links
deduplicated before connected components are taken. Radii up to two need single flips only; for four every
fingerprint emits all flips of two bits, and any member of a run may be its root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, in_arrow, join_counted, parts, stage

BITS, RADIUS, WIDTH, SEED = 64, 3, 3, 42
_ONE = np.uint64(1)
_SINGLE = [1 << i for i in range(BITS)]
_PAIRS = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
#: What each code flips: nothing, one bit, two bits of a half, two bits across the halves (for a radius of four only).
FLIPS = np.array([0, *_SINGLE, *_PAIRS, *[1 << i | 1 << j for i in range(32) for j in range(32, 64)]], np.uint64)
NEAR = 1 + BITS  # codes below flip a bit at most
#: How many codes a radius needs, the least first; a larger radius needs flips of three bits, 41,664 more a fingerprint.
CODES = [1, NEAR, NEAR, NEAR + len(_PAIRS), len(FLIPS)]
#: Variants in a bucket, about.
BUCKET = 2_000_000


def simhash(text: str | bytes, width: int = WIDTH) -> int:
    """The fingerprint over shingles of so many words, as an unsigned number; 0 if the text has no word."""
    data = text.encode() if isinstance(text, str) else text
    joined = b" ".join(data.lower().split())  # both are of ASCII only, as the contract's words are
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(spaces) < width - 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(spaces + 1).tolist()]
        ends = [*spaces[width - 1 :].tolist(), len(joined)]
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65536):
        votes += np.unpackbits(raw[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


#: Up to so many rows of two numbers are broadcast, after they were counted.
BROADCAST_ROWS = 100_000


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns (but for maps, which have none)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def fingerprints(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """key, row_hash (to find the row again) and fp (the fingerprint's bits as a long) of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(2).cast(pa.binary()).to_pylist()
        fps = np.array([simhash(t or b"", width) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], ["key", "row_hash", "fp"])

    rows = df.select(F.col(key).cast("long").alias("key"), row_hash(df).alias("row_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(in_arrow(run, 2), "key long, row_hash long, fp long")


def _variants(buckets: int, radius: int):
    codes_of = CODES[radius]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fps = whole.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                two = fps[np.bitwise_count(fps) % 2 == 1] if radius == 3 else fps
                one = min(NEAR, codes_of)
                values = np.concatenate([(fps[:, None] ^ FLIPS[None, :one]).ravel(), (two[:, None] ^ FLIPS[None, one:codes_of]).ravel()])
                codes = np.concatenate([np.tile(np.arange(one, dtype=np.uint16), len(fps)), np.tile(np.arange(one, codes_of, dtype=np.uint16), len(two))])
                mixed = values * np.uint64(0x9E3779B97F4A7C15)
                to = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((values, to))
                values, codes, to = values[order], codes[order], to[order]
                starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))  # of the buckets that occur
                rows = [(int(to[s]), values[s:e].tobytes(), codes[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], len(to)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "variants", "codes"])

    return run


def _collide(radius: int):
    def run(group: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(group.column("variants").to_pylist()), np.uint64)
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint16)
        order = np.argsort(values, kind="stable")
        values = values[order]
        again = np.flatnonzero(values[1:] == values[:-1])
        touched = np.zeros(len(values), bool)
        touched[again] = touched[again + 1] = True
        values, codes = values[touched], codes[order][touched]
        order = np.lexsort((codes, values))
        values, codes = values[order], codes[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(values)]])))
        fps = values ^ FLIPS[codes]
        roots, root_codes = fps[starts][run], codes[starts][run]
        keep = ((root_codes < NEAR) | (radius > 3)) & (roots != fps) & (np.bitwise_count(roots ^ fps) <= radius)
        links = np.stack([np.minimum(roots, fps)[keep], np.maximum(roots, fps)[keep]], axis=1)
        links = np.unique(links, axis=0) if len(links) else links
        return pa.table({"a": pa.array(links[:, 0].view(np.int64) if len(links) else np.zeros(0, np.int64)), "b": pa.array(links[:, 1].view(np.int64) if len(links) else np.zeros(0, np.int64))})

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect whatever lies within a radius of 0 to 4 bits, from a staged table of distinct fingerprints fp."""
    if not 0 <= radius < len(CODES):
        raise ValueError(f"radius {radius}: only 0 to {len(CODES) - 1} bits can be linked")
    n = distinct.count()
    per = NEAR + (CODES[3] - NEAR) // 2 if radius == 3 else CODES[radius]
    buckets = parts(n * per, BUCKET, 12)
    packed = distinct.repartition(parts(n, 8192, 12)).mapInArrow(_variants(buckets, radius), "bucket int, variants binary, codes binary")
    return packed.groupBy("bucket").applyInArrow(_collide(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b): root is the component's smallest node.

    Alternating large and small stars: each round every node hands its smallest neighbour to the others,
    until the links are stars. Rounds grow with the logarithm of a component's width. Hubs are joined in
    place (join_counted), so a node with very many links fills no single task.
    """
    edges = stage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    total = edges.count()
    while total:
        both = stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
        low = stage(both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "links-low")
        large = join_counted(both.filter("v > u"), low, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links-large")
        low = stage(large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")), "links-low")
        others = join_counted(large, low, "u", "n", 2 * total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage(others.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = edges.count() == small.count() and not edges.join(small, ["u", "v"], "left_anti").take(1)
        edges, total = small, small.count()
        if same:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """key, row_hash, fp, root and component_id of every row: the component's smallest fingerprint, as a long, and the smallest key reachable over links of at most ``radius`` bits between fingerprints over ``width`` words.

    Defined results: a null or empty text has the fingerprint zero, which links like any other; a null key
    is never a component's smallest unless all its keys are null, component_id is then null; repeated rows
    each get a row and lie in one component.
    """
    rows = stage(fingerprints(df, key, text, width), "simhash")
    total = rows.count()
    nodes = stage(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")), "simhash-nodes")
    found = stage(components(links(nodes.select("fp"), radius)), "simhash-components")
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    lows, joined = stage(lows, "simhash-lows"), stage(joined, "simhash-joined")
    named = join_counted(joined.select("fp", "n", "root"), lows, "root", "nodes", nodes.count()).select("fp", "n", "root", "component_id")
    return join_counted(rows, stage(named, "simhash-named"), "fp", "n", total)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """df's rows, one of each component: that of the smallest key, among equal keys that of the smallest row hash.

    A null key is chosen only where a component has no other; of rows equal in every column one stays. Columns
    stay as they are, whatever their names. A chosen row that is there once, as nearly all are, is found by a
    join; only rows that are there several times are told apart by a shuffle, after their tasks have dropped theirs.
    """
    low = F.lit(-(1 << 63))
    names = free_names(df.columns, "llm_key", "llm_row")
    found = near_duplicates(df, key, text, width, radius)
    per = found.groupBy("root", "key", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row_hash", "n")).alias("first"))
    kept = stage(first.select(F.coalesce("first.key", low).alias(names[0]), F.col("first.row_hash").alias(names[1]), F.col("first.n").alias("n")), "simhash-kept")
    rows = df.withColumns({names[0]: F.coalesce(F.col(key).cast("long"), low), names[1]: row_hash(df)})
    total, again = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    out = join_counted(rows, kept.filter("n = 1"), names, "n", total)
    if again:
        several = kept.filter("n > 1")
        held = rows.join(F.broadcast(several.drop("n")), names) if again <= BROADCAST_ROWS else join_counted(rows, several, names, "n", total)
        out = out.unionByName(held.dropDuplicates(names))
    return out.select(*[f"`{c}`" for c in df.columns])
