"""Tables of the engine's domain, derived from the driver's retail tables so that work grows with them.

The driver's data has nothing to do with print jobs: prices, keys and dates merely stand in for sizes,
materials and measurements. Each text below is SQL that Spark and DuckDB both read, so a query and its
oracle start from the same rows and part ways there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()

#: Five materials, as a shop has them: id, bleed, safe, least DPI, roll, finishing, least text, colour, place of the specification, cut work.
MATERIALS = [
    ("banner", 20.0, 30.0, 100.0, 1600.0, None, None, "cmyk", "panel", False),
    ("mesh", 20.0, 40.0, 72.0, 3200.0, 250.0, None, "cmyk", "panel", False),
    ("vinyl", 3.0, 3.0, 300.0, 1370.0, None, 4.0, "cmyk", "below", True),
    ("flag", 15.0, 60.0, 100.0, 1600.0, None, None, "any", "margin", False),
    ("poster", 0.0, 5.0, None, None, None, 6.0, "cmyk", "panel", False),
]
_MATERIAL_COLUMNS = "mat_id, mat_bleed, mat_safe, mat_dpi, mat_roll, mat_finishing, mat_text, mat_colour, mat_spec, mat_cut"


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)"


MATERIALS_SQL = f"SELECT * FROM (VALUES {', '.join('(' + str(i) + ', ' + ', '.join(map(_literal, m)) + ')' for i, m in enumerate(MATERIALS))}) AS t(mat, {_MATERIAL_COLUMNS})"

#: A line of an order as a returned file: what was ordered, what came, what was measured.
FILES_SQL = f"""
SELECT b.*,
    CASE kind WHEN 1 THEN bh WHEN 2 THEN nw WHEN 3 THEN bw / 10 WHEN 4 THEN bw * 2 WHEN 5 THEN bw + 200 WHEN 6 THEN bw + 700 WHEN 7 THEN bw - 50 ELSE bw END AS pw,
    CASE kind WHEN 1 THEN bw WHEN 2 THEN nh WHEN 3 THEN bh / 10 WHEN 5 THEN bh + 150 WHEN 6 THEN bh + 10 ELSE bh END AS ph
FROM (
    SELECT a.*, nw + 2 * mat_bleed AS bw, nh + 2 * mat_bleed AS bh FROM (
        SELECT l_orderkey AS ok, l_linenumber AS ln, l_orderkey % 8 AS kind,
            CAST(300 + (l_partkey % 37) * 100 AS DOUBLE) AS nw, CAST(300 + (l_suppkey % 29) * 100 AS DOUBLE) AS nh,
            m.*, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls, l_partkey AS pk, l_suppkey AS sk
        FROM lineitem JOIN ({MATERIALS_SQL}) m ON l_partkey % 5 = m.mat) a) b
"""

#: Outlines of a template: an order's lines are its outlines, its flag their type.
OUTLINES_SQL = """
SELECT l_orderkey AS token, l_linenumber AS ord,
    CASE l_partkey % 6 WHEN 0 THEN 'cut' WHEN 1 THEN 'CutContour' WHEN 2 THEN 'crease' WHEN 3 THEN 'bleed' WHEN 4 THEN 'safe' ELSE 'sew' END AS type,
    l_linestatus = 'O' AS safe_base,
    CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_suppkey % 70 AS DOUBLE) AS y,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(200 + l_partkey % 50 * 10 AS DOUBLE) END AS w, CAST(300 + l_suppkey % 40 * 10 AS DOUBLE) AS h,
    CAST(1200 AS DOUBLE) AS page_w, CAST(900 AS DOUBLE) AS page_h, CAST(10 AS DOUBLE) AS bleed_mm, CAST(25 AS DOUBLE) AS safe_mm
FROM lineitem
"""

#: Templates to be told apart: suppliers, each with the outlines of its nation and its own.
TEMPLATES_SQL = "SELECT s_suppkey AS token, s_name AS name, CAST(2000 + s_nationkey % 5 * 100 AS DOUBLE) AS page_w, CAST(1000 AS DOUBLE) AS page_h, s_suppkey AS ord FROM supplier"
CUTS_SQL = """
SELECT s_suppkey AS token, k AS ord, CASE WHEN k = 3 THEN 'sew' ELSE 'cut' END AS type,
    CAST(300 + k * 40 + s_suppkey % 23 * 7 AS DOUBLE) AS w, CAST(400 + k * 30 + s_nationkey * 3 AS DOUBLE) AS h
FROM supplier, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
"""
UPLOADS_SQL = """
SELECT c_custkey AS file_id, CAST(2000 + c_nationkey % 5 * 100 + c_custkey % 4 AS DOUBLE) AS page_w, CAST(999 AS DOUBLE) AS page_h,
    CAST(300 + k * 40 + c_custkey % 23 * 7 + 0.5 AS DOUBLE) AS w, CAST(400 + k * 30 + c_nationkey * 3 AS DOUBLE) AS h, (c_custkey + k) % 7 <> 0 AS closed
FROM customer, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n
"""

#: Rows of an order sheet, and the log of what was sent.
SHEET_SQL = """
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('job-', CAST(o_custkey % 300 AS VARCHAR(9))) END AS order_code,
    c_name AS client, c_mktsegment AS project, concat('PM ', CAST(c_nationkey AS VARCHAR(9))) AS pm,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Pm', CAST(c_nationkey AS VARCHAR(9)), '@Example.com') END AS pm_email,
    concat('a', CAST(c_nationkey % 4 AS VARCHAR(9)), '@w.example; A', CAST(c_nationkey % 4 AS VARCHAR(9)), '@W.example / b', CAST(o_orderkey % 9 AS VARCHAR(9)), '@w.example, nobody') AS warehouse_email,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('Item ', CAST(o_orderkey % 40 AS VARCHAR(9))) END AS product,
    CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Produkcja' ELSE 'transport' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('T', CAST(o_orderkey AS VARCHAR(19))) END AS tracking,
    CAST(o_orderdate AS DATE) AS delivery
FROM orders JOIN customer ON o_custkey = c_custkey
"""
LOG_SQL = """
SELECT o_orderdate AS sent_at, concat('JOB-', CAST(o_custkey % 300 AS VARCHAR(9)), '|pm', CAST(c_nationkey AS VARCHAR(9)), '@example.com') AS "group",
    CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Produkcja' ELSE 'transport' END AS status,
    CASE WHEN o_orderkey % 13 = 0 THEN '(invalidated — resend requested)' WHEN o_orderkey % 7 = 0 THEN '(nobody)' ELSE 'someone@example.com' END AS recipients,
    concat('item ', CAST(o_orderkey % 40 AS VARCHAR(9)), ' | Item ', CAST(o_orderkey % 17 AS VARCHAR(9))) AS items
FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01'
"""


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the driver's tables, which are passed by name instead of registered in the session."""
    import re

    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", sql).replace('"group"', "`group`"), **used)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id and the structs facts, expected, material that the rules judge."""
    from ..functions import names
    from ..schemas import EXPECTED, FACTS, MATERIAL, as_struct

    t = from_sql(spark, sf_dir, FILES_SQL).withColumn("file_id", F.concat_ws("-", "ok", "ln", "pk", "sk"))
    if spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        t = t.repartition("file_id")  # one small file would leave most cores without work; rows are still narrow
    c, array = F.col, lambda *x: F.array(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    name = F.concat(F.lit("job_"), (c("nw") / 10).cast("long"), F.lit("x"), (c("nh") / 10).cast("long"), F.when(c("ln") == 1, "cm").when(c("ln") == 2, "mm").otherwise(""), F.when(c("rf") == "A", ".v2.pdf").when(c("rf") == "N", "_łąka.pdf").otherwise(".pdf"))
    scale = F.when(c("kind") == 3, 10).otherwise(1)
    die = F.when(c("mat_cut") & (c("sk") % 4 != 0), F.struct(
        F.lit("Cut").alias("colorant"), F.array(c("mat_bleed") * (c("sk") % 3), F.lit(3.0)).alias("origin_mm"), F.array(c("nw"), c("nh")).alias("size_mm"), F.array(c("bw"), c("bh")).alias("page_mm"),
        ((c("nw") + c("nh")) * 2).alias("length_mm"), c("ln").cast("int").alias("contours"), (c("ls") == "O").alias("closed"), (c("rf") == "R").alias("filled"), F.when(c("ln") != 5, c("disc")).alias("bare_perimeter"),
    ))
    facts = {
        "filename": name, "page_mm": F.array("pw", "ph"), "measured_scale": scale, "pages": c("ln").cast("int"), "fonts": F.when(c("rf") != "R", F.when(c("ln") > 1, array("ABCDEF+Lato", "Arial")).otherwise(F.array().cast("array<string>"))),
        "producer": F.when(c("pk") % 50 == 0, "Microsoft Word 365").otherwise("pdf library"), "shows_text": c("ls") == "O", "colour_spaces": F.when(c("sk") % 4 == 0, array("DeviceRGB", "ICCBased")).when(c("sk") % 4 == 1, array("ICCBased(CMYK)")).when(c("sk") % 4 == 2, array("DeviceCMYK")),
        "spot_names": F.when(c("pk") % 4 == 0, array("Cut", "PANTONE 711 C")).when(c("pk") % 4 == 1, array("Magenta", "Crease 2")).when(c("pk") % 4 == 2, F.array().cast("array<string>")), "overprint": c("tax") > 0.06,
        "raster_alpha": F.when(c("pk") % 9 == 0, c("sk") % 2 == 0), "raster_mode": F.lit("RGBA"), "declared_boxes_mm": F.when(c("sk") % 3 == 0, F.create_map(F.lit("trimbox"), F.array(c("nw") / scale, c("nh") / scale), F.lit("mediabox"), F.array("pw", "ph"))).when(c("sk") % 3 == 1, F.create_map(F.lit("trimbox"), F.array(c("nh") / scale, c("nw") / scale), F.lit("mediabox"), F.array("pw", "ph"))),
        "blank_edges_mm": F.when(c("pk") % 10 != 0, F.array(c("tax") * 200, F.lit(0.0), c("disc") * 100, F.lit(0.25))), "bleed_shortfall": F.when(c("pk") % 3 == 0, F.struct(c("disc").alias("share"), (c("tax") * 150).alias("missing_mm"))),
        "safe_intrusion_mm": F.when(c("pk") % 8 != 0, c("disc") * 20), "min_dpi": F.when(c("sk") % 7 != 0, c("qty") * 8), "text_min_height_mm": F.when(c("pk") % 7 != 0, c("qty") / 2), "guides_present": F.when(c("ln") != 4, c("disc") == 0.05),
        "die": die, "named_size": names.named_size(name), "has_diacritics": c("rf") == "N", "extra_dots": names.extra_dots(name),
    }
    expected = {"netto_mm": F.array("nw", "nh"), "brutto_mm": F.array("bw", "bh"), "bleed_mm": c("mat_bleed"), "safe_mm": c("mat_safe"), "scale": F.lit(1), "strip_mm": F.when(c("mat_spec") == "below", 22.0).otherwise(0.0)}
    material = {"id": "mat_id", "bleed_mm": "mat_bleed", "safe_mm": "mat_safe", "min_dpi": "mat_dpi", "max_width_mm": "mat_roll", "finishing_mm": "mat_finishing", "min_text_mm": "mat_text", "colour": "mat_colour", "spec_position": "mat_spec", "cut_path": "mat_cut"}
    named = {f"f_{k}": v for k, v in facts.items()} | {f"e_{k}": v for k, v in expected.items()} | {f"m_{k}": c(v) for k, v in material.items()}
    t = t.select("file_id", *[v.alias(k) for k, v in named.items()])
    return t.select("file_id", as_struct(t, FACTS, "f_").alias("facts"), as_struct(t, EXPECTED, "e_").alias("expected"), as_struct(t, MATERIAL, "m_").alias("material"))
