"""A shop's configuration: one JSON document with materials, messages, rules and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MATERIAL

DOCUMENT = f"version int, materials array<struct<{','.join(f'{n}:{t}' for n, t in MATERIAL.items())}>>, messages map<string,string>, rules map<string,string>, templates array<struct<token:string,name:string,page_mm:array<double>,scale:int,outlines:array<struct<type:string,safe_base:boolean,closed:boolean,width_mm:double,height_mm:double,origin_mm:array<double>,segments:array<array<string>>>>>>"
#: A material's id, its largest margin, and the words it chooses from.
ID, LARGEST_MARGIN_MM, COLOURS, POSITIONS, LEVELS = r"^[a-z0-9][a-z0-9-]{0,59}$", 500.0, ["cmyk", "any"], ["panel", "below", "margin", "none"], ["off", "info", "amber", "red"]


def document(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; a missing file is an empty shop."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(DOCUMENT).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DOCUMENT)


def materials(doc: DataFrame) -> DataFrame:
    """Materials with problem: the first check that a row fails, or null; ord is their order."""
    return checked(doc.select(F.posexplode("materials").alias("ord", "m")).select("ord", "m.*"))


def checked(rows: DataFrame) -> DataFrame:
    """Rows of materials with problem, see materials."""
    bad = lambda c: (F.col(c) < 0) | F.isnan(c)
    optional = ["min_dpi", "max_width_mm", "panel_max_long_mm", "panel_max_short_mm", "finishing_mm", "min_text_mm"]
    problem = F.when(~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "id").when(F.trim(F.coalesce("name", F.lit(""))) == "", "name")
    for c in ("bleed_mm", "safe_mm"):
        problem = problem.when(F.col(c).isNull() | bad(c) | (F.col(c) > LARGEST_MARGIN_MM), c)
    for c in optional:
        problem = problem.when(F.coalesce(bad(c), F.lit(False)), c)
    problem = problem.when(F.col("colour").isNotNull() & ~F.col("colour").isin(COLOURS), "colour").when(F.col("spec_position").isNotNull() & ~F.col("spec_position").isin(POSITIONS), "spec_position")
    problem = problem.when(F.count(F.lit(1)).over(Window.partitionBy("id")) > 1, "duplicate id")
    return rows.withColumn("problem", problem)


def levels(doc: DataFrame) -> DataFrame:
    """rule_id, level: unknown levels are dropped, unknown rules stay."""
    return doc.select(F.explode("rules").alias("rule_id", "level")).filter(F.col("level").isin(LEVELS))


def wording(doc: DataFrame) -> DataFrame:
    """code, template; unknown codes stay."""
    return doc.select(F.explode("messages").alias("code", "template"))


def usable(templates: Column) -> Column:
    """Templates that have a token, a page of two sides, and outlines that all have segments."""
    return F.filter(templates, lambda t: (F.trim(F.coalesce(t["token"], F.lit(""))) != "") & (F.size(t["page_mm"]) == 2) & (F.size(t["outlines"]) > 0) & F.forall(t["outlines"], lambda o: F.size(o["segments"]) > 0))
