"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target by water filling, and a document is emitted
floor(rate) times plus one copy drawn by a hash of its key with the rate's fraction as probability. The
draw needs no state, so reruns and recomputed partitions agree. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, join_counted, stage

#: Up to so many sources the plan (some 60 bytes a source) is broadcast; beyond, sources that hold much are, the others meet in a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key's MD5: 52 bits, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_plan(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source, rows, source_size, weight, target, rate.

    Sources in the order of their code points, null last, take ``weights`` in turn. All targets add up to
    all sizes. None is above ``most`` times its source's size: the excess goes to the others by weight
    until none is above. In closed form: sorted by cap over weight, the capped sources are a prefix, and
    it is the shortest prefix after which the common level doesn't exceed the next one's ratio.
    The windows are over all sources at once, so one task sorts a row per source, some 100 bytes each: ten
    million sources are a gigabyte.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("turn", F.row_number().over(by_ratio))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("turn", "level"))
    per = per.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    per = per.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    return per.select("source", "rows", "source_size", "weight", "target", rate.alias("rate"))


#: What with_copies adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _counted(df: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, list[str]]:
    """df and four columns, named as df names none: size, its source's size and target, how often the mix takes the row."""
    own, total, target, copies, name, rate, n = free_names(df.columns, *ADDED, "mix_source", "mix_rate", "mix_rows")
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("none"))
    sized = df.withColumn(own, size).withColumn(name, named(F.col(source)))
    plan = stage(source_plan(sized.select(F.col(source).alias("source"), F.col(own).alias("size")), "source", "size", weights, most), "mix-plan")
    plan = plan.select(named(F.col("source")).alias(name), F.col("source_size").alias(total), F.col("target").alias(target), F.col("rate").alias(rate), F.col("rows").alias(n))
    sources, rows = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    joined = sized.join(F.broadcast(plan.drop(n)), name) if sources <= BROADCAST_SOURCES else join_counted(sized, plan, name, n, rows)
    whole = F.floor(rate)
    chance = draw(F.col(key), seed) < F.col(rate) - whole
    return joined.withColumn(copies, (whole + chance.cast("long")).cast("long")), [own, total, target, copies]


def with_copies(df: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """df and mix_size, mix_source_size, mix_target, mix_copies (how often the mix takes the row).

    Defined results: a null or empty text has size 0 and, in a source of size 0, rate 1. A null source is
    a source. Rows that share a key share the draw; a null key draws as the empty string. An empty table
    gives an empty one. df's own columns stay as they are, but for those that have one of the four names.
    """
    out, names = _counted(df, key, source, size, weights, most, seed)
    return out.select(*[c for c in df.columns if c.lower() not in ADDED], *[F.col(a).alias(b) for a, b in zip(names, ADDED, strict=True)])


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: df's rows and columns, whatever their names, each as often as the mix takes it. See with_copies."""
    out, names = _counted(df, key, source, words(F.col(text)), weights, most, seed)
    (copy,) = free_names(out.columns, "mix_copy")
    out = out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(names[3]).cast("int"))))
    return out.select(*df.columns)
