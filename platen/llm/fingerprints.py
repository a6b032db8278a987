"""Canonical exact fingerprints.

A text is normalised (NFKC), case-folded, normalised again, its white space folded to single spaces, and
hashed to 128 bits by XXH3. Texts of equal hash are compared byte by byte: should a bucket hold different
bytes, its members' fingerprints get a second digest behind the first. So two texts of a table have the same
fingerprint exactly if their canonical bytes are equal (an edited text is none of the table: it goes by its
digests alone).

Bytes travel only for buckets of two or more texts, and the smallest and largest of each bucket are
combined before they are shuffled: a bucket is of one kind exactly if they are equal, however large it is.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_counted, shuffles, stage


def canonical(text: str) -> bytes:
    """The form whose bytes are compared."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def second(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


#: Up to so many hashes of mixed buckets are broadcast, after they were counted; beyond, copies are joined by their counts.
BROADCAST_HASHES = 10_000


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at (a hash of the text as it is) and hash of every row; a null text is an empty one."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [digest(canonical(t or "")) for t in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.string())], ["key", "at", "hash"])

    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(own).alias("at"), own.alias("text")).mapInArrow(in_arrow(run, 2), "key long, at long, hash string")


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """hash of the buckets whose packed texts (column packed, null for texts that are alone) aren't all equal, staged."""
    ends = rows.filter(F.col("packed").isNotNull()).groupBy("hash").agg(F.min("packed").alias("low"), F.max("packed").alias("high"))
    return stage(ends.filter(F.col("low") != F.col("high")).select("hash"), "mixed-buckets")


def _named(rows: DataFrame, mixed: DataFrame, hash_: str, more: str, out: str) -> DataFrame:
    """rows and out: the hash, and in mixed buckets the second digest behind it. Usually no bucket is mixed and nothing is joined."""
    n = mixed.count()
    if not n:
        return rows.withColumn(out, F.col(hash_))
    marks = mixed.select(F.col("hash").alias(hash_), F.lit(True).alias("mixed_bucket"))
    if n <= BROADCAST_HASHES:
        found = rows.join(F.broadcast(marks), hash_, "left")
    else:
        per = rows.groupBy(hash_).agg(F.count(F.lit(1)).alias("bucket_rows")).join(marks, hash_, "left")
        found = join_counted(rows, per, hash_, "bucket_rows", rows.count())
    return found.withColumn(out, F.when(F.col("mixed_bucket"), F.concat_ws("-", hash_, more)).otherwise(F.col(hash_))).drop("mixed_bucket")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint, copies (rows of that fingerprint) and first_key (their smallest key) of every row.

    Defined results: a null text is an empty one, empty texts are copies of each other; a null key stays
    null and is never first unless all are; repeated rows each get a row.
    """
    rows = stage(digests(df, key, text), "digests")
    total = rows.count()
    many = stage(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")

    def pack(part: pa.RecordBatch) -> pa.RecordBatch:
        packer, out = zstandard.ZstdCompressor(), [canonical(t or "") for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([digest(c) for c in out]), pa.array([second(c) for c in out]), pa.array([packer.compress(c) for c in out], pa.binary())], ["key", "hash", "more", "packed"])

    full = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(in_arrow(pack, 1), "key long, hash string, more string, packed binary")
    named = _named(full.select("key", "hash", "more"), mixed_buckets(join_counted(full.select("hash", "packed"), many, "hash", "n", total)), "hash", "more", "fingerprint")
    named = stage(named.select("key", "fingerprint"), "fingerprints")
    groups = stage(named.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key")), "groups")
    return join_counted(named, groups.withColumn("n", F.col("copies")), "fingerprint", "n", total).select(F.col("key").alias(key), "fingerprint", "copies", "first_key")


PAIR = "key long, n_chars long, edited_sha256 string, hash string, more string, edited_hash string, edited_more string, near_edited double, near_next double, packed binary"


def edited_text(text: str, after: str) -> str:
    """text, its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def ranges_of(rows: DataFrame, ranges: int):
    """A column function of (k, at): the number of a row's range, ascending in (k, at).

    Cuts are quantiles of k. A key that several quantiles fall on holds that share of all rows: it gets as many
    ranges, cut evenly over at, a hash.
    """
    probs = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("k", probs, 10 * ranges)).first()[0] if probs else None
    cuts, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    widths = np.where(times > 1, times + 1, 1)
    begins = np.concatenate([[0], 1 + np.cumsum(widths) - widths])

    @F.pandas_udf("int")
    def range_of(k: pd.Series, at: pd.Series) -> pd.Series:
        keys = k.to_numpy(np.int64)
        base = np.searchsorted(cuts, keys, side="right")
        if not len(cuts):
            return pd.Series(base)
        n, cut = times[np.maximum(base - 1, 0)], cuts[np.maximum(base - 1, 0)]
        shares = np.minimum(((at.to_numpy(np.float64) / 2.0**64 + 0.5) * n).astype(np.int64), n - 1)
        return pd.Series(begins[base] + np.where((base > 0) & (n > 1), np.where(keys == cut, shares, n), 0))

    return range_of


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's, and how like they and the next text's are (1 or 0).

    The next text is that of the next larger key; after the last comes the first. Rows are dealt to ranges
    of the key and, in a key that holds much, of the text's hash; the first row of each range goes to the
    range before it as well, and every range is sorted and streamed, so no task holds more than a batch.
    Defined results: a null text is an empty one; a null key comes first; rows that share a key follow each
    other in the order of their texts' hashes; a table of one row is its own next.
    """
    low = -(1 << 63)
    own_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("k"), F.xxhash64(own_text).alias("at"), own_text.alias("text"))
    ranges = shuffles(df.sparkSession)
    range_of = ranges_of(rows, ranges)

    firsts = sorted((r[0], r[1][0], r[1][1]) for r in rows.select(range_of("k", "at").alias("range"), F.struct("k", "at").alias("first")).groupBy("range").agg(F.min("first")).collect())  # one row a range
    before = [(last[0], own[1], own[2]) for own, last in zip(firsts, firsts[-1:] + firsts[:-1], strict=True)]
    spark = df.sparkSession
    halo = F.broadcast(spark.createDataFrame(before, "range int, k long, at long"))
    halo = rows.join(halo, ["k", "at"]).select("range", F.lit(1).alias("halo"), "k", "at", F.lit(1).alias("kind"), "id", "text").dropDuplicates(["range"])

    single = stage(digests(df, key, text), "digests")
    many = stage(single.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    marks = join_counted(single, many, "hash", "n", single.count()).select(F.coalesce("key", F.lit(low)).alias("k"), "at").distinct()
    marks = marks.select(range_of("k", "at").alias("range"), F.lit(0).alias("halo"), "k", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"))
    dealt = rows.select(range_of("k", "at").alias("range"), F.lit(0).alias("halo"), "k", "at", F.lit(1).alias("kind"), "id", "text")
    dealt = dealt.unionByName(halo).unionByName(marks).repartition(max(ranges, len(firsts)), "range").sortWithinPartitions("range", "halo", "k", "at", "kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, last, marked = zstandard.ZstdCompressor(), None, None
        for batch in batches:
            out = []
            for r, h, k, at, kind, id_, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    marked = (r, k, at)
                    continue
                form = canonical(t)
                if last is not None and last[0] == r and not last[1]:
                    _, _, key_, text_, form_, mark_ = last
                    edited = edited_text(text_, t)
                    changed = canonical(edited)
                    hash_ = digest(form_)
                    out.append((key_, len(text_), hashlib.sha256(edited.encode()).hexdigest(), hash_, second(form_), digest(changed), second(changed), float(changed == form_), float(form == form_), packer.compress(form_) if mark_ else None))
                last = (r, h, id_, t, form, marked == (r, k, at))
            if out:
                kinds = [pa.int64(), pa.int64()] + [pa.string()] * 5 + [pa.float64()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in PAIR.split(", ")])

    found = stage(dealt.mapInArrow(run, PAIR), "neighbours")
    mixed = mixed_buckets(found)
    named = _named(found.drop("packed"), mixed, "hash", "more", "fingerprint")
    named = _named(named, mixed, "edited_hash", "edited_more", "edited_fingerprint")
    return named.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
