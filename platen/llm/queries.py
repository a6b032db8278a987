"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, language_model, licences, mixing, neighbours, packing, products, repeats, simhash, spelling, toxicity, warc
from .common import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of the packing contract, where the installed package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.with_copies(docs, "doc_id", "source", mixing.words(F.col("text")))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score(table(spark, sf_dir, "documents"))
    return out.withColumn("score", F.round("score", 6))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.score_udf(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(spark, F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    records = warc.read_archives(warc.write_warc(warc.with_revisits(pages)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of docs, with a digest for their ids."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string"))
    split = F.when(seed % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", split.alias("words"))
    text = F.when(F.size("words") > 0, F.array_join(repeats.with_repeats(F.col("words"), F.floor(seed / 10)), " ")).otherwise(F.col("text"))
    found = repeats.periodic_runs(docs, text=text)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("long"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(F.lit(1000) * F.col("long.length") / F.col("long.period"))
    return out.select("doc_id", "n_runs", *(F.col(f"long.{c}").alias(c) for c in ("start", "length", "period")), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slips=97)).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language_model, op3_neighbours, op4_fingerprints, op5_toxicity, op6_html_text, op7_simhash, op8_licences, op9_warc, op10_packing, op11_periodic_runs, op12_top_products, op13_spelling)}
