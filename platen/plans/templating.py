"""Queries of templates, stamps, the editor and wording on derived rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editor
from ..operators import outlines, rules, scenes, stamps, templates, wording
from ..sources import shop
from . import derived

#: Elements of a design: an order's lines, drawn in their order, and the point that is asked about.
ELEMENTS_SQL = """
SELECT l_orderkey AS design, l_linenumber AS z, l_partkey AS pk, l_suppkey AS sk, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y, 0.5 + CAST(l_linenumber % 4 AS DOUBLE) / 2 AS scale,
    CAST(l_partkey % 7 AS DOUBLE) * 0.5 AS rotation, CAST(120 + l_partkey % 90 AS DOUBLE) AS width, CAST(80 + l_suppkey % 70 AS DOUBLE) AS height,
    CAST(l_orderkey % 400 AS DOUBLE) AS px, CAST(l_orderkey % 300 AS DOUBLE) AS py, CAST(l_orderkey % 390 + 5 AS DOUBLE) AS qx, CAST(l_orderkey % 310 + 3 AS DOUBLE) AS qy
FROM lineitem
"""


def _element() -> Column:
    return F.struct(*[F.col(c) for c in ("x", "y", "scale", "rotation", "width", "height")])


def _spot(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def editor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each element: its bounds, whether a point lies on it, which handle it grabs, and the element after drags."""
    t = derived.from_sql(spark, sf_dir, ELEMENTS_SQL).withColumns({"e": _element(), "p": _spot("px", "py"), "q": _spot("qx", "qy")})
    e, p, q = F.col("e"), F.col("p"), F.col("q")
    six = lambda c: F.round(c, 6)
    box = editor.bounds(e)
    moved, scaled, turned = (editor.dragged(e, F.lit(mode), p, q) for mode in ("move", "scale", "rotate"))
    kept = editor.held(moved, F.lit(380.0), F.lit(280.0))
    return t.select(
        "design", "z", "pk", "sk", *[six(box[k]).alias(k) for k in ("x0", "y0", "x1", "y1")], editor.contains(e, p).alias("under"), editor.handle_at(e, p, F.lit(0.5)).alias("handle"),
        kept["x"].alias("held_x"), kept["y"].alias("held_y"), six(scaled["scale"]).alias("scaled"), six(turned["rotation"]).alias("turned"),
        six(editor.new_image(e["width"], e["height"], F.lit(300.0), F.lit(200.0))["scale"]).alias("new_scale"), six(editor.new_text(F.lpad(F.lit(""), F.col("z").cast("int"), "x"), e["height"], F.lit(300.0), F.lit(200.0))["width"]).alias("text_width"),
    )


_FRAME = f"""
WITH e AS (SELECT *, cos(rotation) AS c, sin(rotation) AS s FROM ({ELEMENTS_SQL}) e),
f AS (SELECT *, (abs(width * c) + abs(height * s)) / 2 * scale AS half_w, (abs(width * s) + abs(height * c)) / 2 * scale AS half_h,
    ((px - x) * c + (py - y) * s) / scale AS lx, ((py - y) * c - (px - x) * s) / scale AS ly,
    x + (height / 2 + 44 / scale) * s * scale AS rx, y - (height / 2 + 44 / scale) * c * scale AS ry, x + (width / 2 * c - height / 2 * s) * scale AS hx, y + (width / 2 * s + height / 2 * c) * scale AS hy,
    sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS near, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS far FROM e)"""
FRAMES = f"""{_FRAME}
SELECT design, z, pk, sk, round(x - half_w, 6) AS x0, round(y - half_h, 6) AS y0, round(x + half_w, 6) AS x1, round(y + half_h, 6) AS y1, abs(lx) <= width / 2 AND abs(ly) <= height / 2 AS under,
    CASE WHEN sqrt((rx - px) * (rx - px) + (ry - py) * (ry - py)) <= 36 THEN 'rotate' WHEN sqrt((hx - px) * (hx - px) + (hy - py) * (hy - py)) <= 36 THEN 'scale' END AS handle,
    least(380.0, greatest(0.0, x + qx - px))::DOUBLE AS held_x, least(280.0, greatest(0.0, y + qy - py))::DOUBLE AS held_y, round(least(20.0, greatest(0.05, scale * far / CASE WHEN near = 0 THEN 1 ELSE near END)), 6)::DOUBLE AS scaled,
    round(rotation + atan2(qy - y, qx - x) - atan2(py - y, px - x), 6) AS turned, round(least(1.0, 100.0 / width, 200.0 / 3 / height), 6)::DOUBLE AS new_scale, round(height * z * 0.6, 6)::DOUBLE AS text_width FROM f"""


def topmost_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each design the element that lies on top under a point."""
    t = derived.from_sql(spark, sf_dir, ELEMENTS_SQL)
    return templates.topmost_row(t.withColumn("z", F.struct("z", "pk", "sk")), "design", "z", editor.contains(_element(), _spot("px", "py"))).select("design", F.col("z.z").alias("z"))


TOPMOST = f"{_FRAME} SELECT design, max(z) AS z FROM f WHERE abs(lx) <= width / 2 AND abs(ly) <= height / 2 GROUP BY design"


def design_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each design holds, in words, and whether all of it can be placed."""
    t = derived.from_sql(spark, sf_dir, ELEMENTS_SQL).groupBy("design").agg(F.collect_list(F.when(F.col("pk") % 3 == 0, "image").otherwise("text")).alias("types"), F.collect_list(F.struct("x", "y", "scale", "rotation", F.when(F.col("sk") % 25 == 0, 0.0).otherwise(F.col("width")).alias("width"), "height")).alias("elements"))
    return t.select("design", editor.summary(F.col("types"), {"image": ("grafika", "grafiki", "grafik"), "text": ("napis", "napisy", "napisów")}).alias("summary"), F.size(editor.placed(F.col("elements"))).cast("long").alias("placed"))


def _plural_sql(n: str, one: str, few: str, many: str) -> str:
    return f"CASE WHEN {n} > 0 THEN concat({n}, ' ', CASE WHEN {n} = 1 THEN '{one}' WHEN {n} % 10 BETWEEN 2 AND 4 AND NOT {n} % 100 BETWEEN 12 AND 14 THEN '{few}' ELSE '{many}' END) END"


SUMMARIES = f"""
WITH n AS (SELECT design, count(*) FILTER (WHERE pk % 3 = 0) AS i, count(*) FILTER (WHERE pk % 3 <> 0) AS t, count(*) AS n, bool_or(sk % 25 = 0) AS bad FROM ({ELEMENTS_SQL}) e GROUP BY design)
SELECT design, concat_ws(', ', {_plural_sql('i', 'grafika', 'grafiki', 'grafik')}, {_plural_sql('t', 'napis', 'napisy', 'napisów')}) AS summary, CASE WHEN bad THEN 0 ELSE n END AS placed FROM n"""

#: Templates as the shop stores them, derived from suppliers.
SHELF_SQL = """
SELECT s_suppkey AS token, s_nationkey AS nk, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Vento ' WHEN 1 THEN 'Play Regular ' WHEN 2 THEN 'Gate ' ELSE 'ventos ' END, CASE s_suppkey % 5 WHEN 0 THEN 'XL' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' ELSE 'XLM' END) AS name,
    CASE WHEN s_suppkey % 7 = 0 THEN 'sheet' ELSE 'flat' END AS kind, CAST(500 + s_nationkey * 40 AS DOUBLE) AS page_w, CAST(150 + s_suppkey % 60 * 50 AS DOUBLE) AS page_h, CAST(s_suppkey % 4 AS VARCHAR(9)) AS scale, CAST(s_suppkey % 3 AS VARCHAR(9)) AS sides,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey % 6 * 30 AS DOUBLE) END AS sew_left, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 3 * 35 AS DOUBLE) END AS sew_top, CAST(s_suppkey % 9 * 5 AS DOUBLE) AS safe, CAST(s_suppkey % 4 * 6 AS DOUBLE) AS bleed,
    CAST(400 + s_nationkey * 30 AS DOUBLE) AS trim_w, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE CAST(100 + s_suppkey % 60 * 45 AS DOUBLE) END AS trim_h
FROM supplier
"""


def _sewn() -> Column:
    return F.map_filter(F.create_map(F.lit("left"), F.col("sew_left"), F.lit("top"), F.col("sew_top")), lambda k, v: v.isNotNull())


def template_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from each template's numbers: finished size, margins, mast, base, panel, areas, depths."""
    t = derived.from_sql(spark, sf_dir, SHELF_SQL)
    c, six = F.col, (lambda x: F.round(x, 6))
    scale = templates.scale_of(c("scale"))
    size = scenes.finished_size(c("name"), c("kind"), c("trim_w"), c("trim_h"), c("page_w"), c("page_h"), scale)
    flag, panel = templates.flag(c("name"), c("page_h"), _sewn()), templates.spec_panel(c("page_w"), c("page_h"), F.when(c("nk") % 3 == 0, 0.0).otherwise(c("trim_w")))
    area = templates.face_areas(F.array(F.lit(10.0), F.lit(20.0), c("trim_w"), c("page_h")), c("safe"), c("scale"), F.when(c("nk") % 4 == 0, F.array(F.lit(1.0), F.lit(2.0))), F.lit(None).cast("array<double>"))
    margin = templates.margin_box(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), c("page_w").alias("x1"), c("page_h").alias("y1")), _sewn(), c("safe"))
    depth = templates.ring_depths(_sewn(), c("bleed"), c("safe"), scale)
    return t.select(
        "token", size["w"].alias("finished_w"), size["h"].alias("finished_h"), scale.cast("long").alias("scale"), templates.sides_of(c("sides")).cast("long").alias("sides"), flag["mast"].alias("mast"), flag["letter"].alias("letter"), six(flag["base_side"]).alias("base_side"), flag["base_weight"].alias("base_weight"), flag["construction"].alias("construction"),
        six(panel["w"]).alias("panel_w"), six(panel["h"]).alias("panel_h"), F.get(area["graphic"], F.lit(0)).alias("graphic_w"), F.get(area["safe"], F.lit(1)).alias("safe_h"), *[margin[k].alias(f"margin_{k}") for k in ("x0", "y0", "x1", "y1")], six(F.element_at(depth, F.lit("left"))).alias("depth_left"), six(F.element_at(depth, F.lit("right"))).alias("depth_right"),
    )


TEMPLATE_FACTS = f"""
WITH s AS (SELECT *, greatest(1, scale::INTEGER) AS n, coalesce(sew_left, 0) AS l, coalesce(sew_top, 0) AS u, contains(lower(name), 'regular') AS rigid, greatest(page_h - 200, 0) AS fin,
    CASE WHEN regexp_matches(name, '\\bXL\\b') THEN 'XL' WHEN regexp_matches(name, '\\bS\\b') THEN 'S' WHEN regexp_matches(name, '\\bM\\b') THEN 'M' WHEN regexp_matches(name, '\\bL\\b') THEN 'L' ELSE 'S' END AS letter, CASE WHEN nk % 3 = 0 THEN 0 ELSE trim_w END AS sw FROM ({SHELF_SQL}) t),
p AS (SELECT *, least(least(900, greatest(120, greatest(page_w, page_h) * 0.23)), page_w * 0.7, CASE WHEN sw = 0 THEN 1e300 ELSE sw * 0.8 END)::DOUBLE AS pw FROM s)
SELECT token, CASE WHEN regexp_matches(lower(name), '\\b(vento|play)\\b') THEN page_w - 200 WHEN kind <> 'sheet' AND trim_h IS NOT NULL THEN trim_w * n END AS finished_w, CASE WHEN regexp_matches(lower(name), '\\b(vento|play)\\b') THEN page_h - 200 WHEN kind <> 'sheet' AND trim_h IS NOT NULL THEN trim_h * n END AS finished_h,
    n::BIGINT AS scale, CASE WHEN sides = '2' THEN 2 ELSE 1 END::BIGINT AS sides, (fin + CASE WHEN rigid THEN 500 ELSE 400 END)::DOUBLE AS mast, letter, round(CASE letter WHEN 'XL' THEN 670 WHEN 'L' THEN 515 WHEN 'M' THEN 485 ELSE 415 END / sqrt(2), 6) AS base_side, CASE letter WHEN 'XL' THEN 12 WHEN 'L' THEN 8 WHEN 'M' THEN 6 ELSE 4 END::DOUBLE AS base_weight,
    CASE WHEN rigid THEN 'rigid' WHEN u >= 60 AND l < 60 THEN 'top' ELSE 'winder' END AS construction, round(pw, 6) AS panel_w, round(least(pw * 0.28, page_h * 0.32), 6)::DOUBLE AS panel_h, CASE WHEN nk % 4 = 0 THEN 1 ELSE (trim_w - 10) * n END::DOUBLE AS graphic_w, greatest(0, page_h - 20 - 2 * safe) * n::DOUBLE AS safe_h,
    l + safe AS margin_x0, safe AS margin_y0, page_w - safe AS margin_x1, page_h - u - safe AS margin_y1, round((bleed + CASE WHEN sew_left IS NULL THEN safe ELSE sew_left END) / n, 6) AS depth_left, round((bleed + safe) / n, 6) AS depth_right FROM p"""


def typed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing wrong with each template's marked outlines and with its typed sewn sides."""
    rows = derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL).withColumn("kind", F.when(F.col("ord") == 5, F.concat(F.lit(" "), F.upper("type"))).when((F.col("token") % 41 == 0) & (F.col("ord") == 2), "seam").otherwise(F.col("type")))
    per = rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("kind").alias("type"), F.when((F.col("token") % 37 == 0) & (F.col("ord") == 3), 0).otherwise(4).alias("segments"), "x", "y", "w", "h"))).alias("outlines"))
    typed = F.create_map(F.lit("left"), F.when(F.col("token") % 11 == 0, "-1").when(F.col("token") % 13 == 0, "x").otherwise((F.col("token") % 3).cast("string")), F.lit("top"), F.when(F.col("token") % 17 == 0, "1,5").otherwise(F.lit(" 0 ")))
    own = templates.sewn_sides(F.when(F.col("token") % 19 != 0, typed))
    return per.select("token", templates.checked_outlines(F.col("outlines")).alias("problem"), own["problem"].alias("sewn_problem"), F.element_at(own["sides"], F.lit("left")).alias("sewn_left"))


TYPED_CHECKS = f"""
WITH o AS (SELECT *, CASE WHEN ord = 5 THEN lower(type) WHEN token % 41 = 0 AND ord = 2 THEN 'seam' ELSE lower(type) END AS kind, token % 37 = 0 AND ord = 3 AS flat FROM ({derived.OUTLINES_SQL}) o),
b AS (SELECT *, flat OR kind NOT IN ('cut', 'cutcontour', 'kisscut', 'crease', 'reverse_crease', 'perforation', 'sew', 'safe', 'bleed') AS bad, kind IN ('cut', 'cutcontour') AS trims FROM o),
t AS (SELECT token, min(ord) FILTER (WHERE bad) AS first_bad, count(*) FILTER (WHERE trims) AS cuts, min(x) FILTER (WHERE trims AND w IS NOT NULL) AS x0, min(y) FILTER (WHERE trims AND w IS NOT NULL) AS y0, max(x + w) FILTER (WHERE trims AND w IS NOT NULL) AS x1, max(y + h) FILTER (WHERE trims AND w IS NOT NULL) AS y1 FROM b GROUP BY token),
p AS (SELECT t.*, any_value(CASE WHEN b.flat THEN 'no_geometry' ELSE concat('unknown_type:', b.kind) END) FILTER (WHERE b.ord = first_bad AND b.bad) AS wrong, bool_or(coalesce(b.kind = 'safe' AND (b.x < x0 - 0.5 OR b.y < y0 - 0.5 OR b.x + b.w > x1 + 0.5 OR b.y + b.h > y1 + 0.5), false)) AS outside FROM t JOIN b USING (token) GROUP BY ALL),
s AS (SELECT *, CASE WHEN token % 11 = 0 THEN '-1' WHEN token % 13 = 0 THEN 'x' ELSE (token % 3)::VARCHAR END AS l, CASE WHEN token % 17 = 0 THEN '1,5' ELSE '0' END AS u FROM p),
q AS (SELECT *, CASE WHEN token % 19 = 0 THEN NULL WHEN l = 'x' THEN 'not_a_number:left' WHEN l = '-1' THEN 'negative' WHEN u = '1,5' THEN 'not_a_number:top' END AS sewn_problem FROM s)
SELECT token, CASE WHEN wrong IS NOT NULL THEN wrong WHEN cuts < 1 THEN 'nothing_trims' WHEN outside THEN 'safe_outside_trim' END AS problem, sewn_problem, CASE WHEN token % 19 <> 0 AND sewn_problem IS NULL AND l <> '0' THEN l::DOUBLE END AS sewn_left FROM q"""


def page_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed regions of each order's page, as fractions, each once."""
    per = derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL).groupBy("token").agg(F.collect_list(F.struct("type", F.when(F.col("w").isNotNull(), F.col("x")).alias("x"), "y", "w", "h")).alias("outlines"))
    faces = F.when(F.col("token") % 6 == 0, F.array(F.struct(F.lit("A").alias("label"), F.array(*map(F.lit, (0.0, 0.0, 600.0, 450.0))).alias("box")), F.struct(F.lit("B").alias("label"), F.array(F.lit(1.0)).alias("box")))).otherwise(F.array().cast("array<struct<label:string,box:array<double>>>"))
    boxes = templates.page_boxes(F.col("outlines"), faces, F.lit(1200.0), F.lit(900.0))
    return per.select("token", F.explode(boxes).alias("b")).select("token", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


PAGE_FRACTIONS = f"""
WITH o AS (SELECT token, x, y, x + w AS r, y + h AS t FROM ({derived.OUTLINES_SQL}) o WHERE lower(type) IN ('cut', 'cutcontour') AND w IS NOT NULL
    UNION ALL SELECT DISTINCT token, 0, 0, 600, 450 FROM ({derived.OUTLINES_SQL}) o WHERE token % 6 = 0),
b AS (SELECT DISTINCT token, round(x / 1200, 5) AS x0, round(1 - t / 900, 5) AS y0, round(r / 1200, 5) AS x1, round(1 - y / 900, 5) AS y1 FROM o)
SELECT * FROM b UNION ALL SELECT DISTINCT token, 0.0, 0.0, 1.0, 1.0 FROM ({derived.OUTLINES_SQL}) o WHERE token NOT IN (SELECT token FROM b)"""


def material_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's material is shown as."""
    p = derived.from_sql(spark, sf_dir, f"SELECT p_partkey, {_MATERIAL} AS material FROM part")
    scene = templates.scene(F.col("material"))
    return p.select("p_partkey", scene["kind"].alias("kind"), scene["thickness"].alias("thickness"), scene["sides"].cast("long").alias("sides"))


_MATERIAL = """CASE p_partkey % 9 WHEN 0 THEN concat('Baner Frontlit ', CAST(p_size AS VARCHAR(9))) WHEN 1 THEN 'SIATKA 270' WHEN 2 THEN concat('PCV Spienione ', CAST(p_size AS VARCHAR(9)), 'mm') WHEN 3 THEN concat('Folia ', CAST(p_size AS VARCHAR(9)), ' mm')
    WHEN 4 THEN concat('Dibond ', CAST(p_size AS VARCHAR(9)), ',5 MM Dwustronny') WHEN 5 THEN 'Flaga mesh' WHEN 6 THEN concat('PrintFloor ', CAST(p_size AS VARCHAR(9)), ' mm') WHEN 7 THEN 'Sklejka' ELSE 'Blockout dwustronny 3mm' END"""
SCENES = """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'baner' WHEN 1 THEN 'siatka' WHEN 2 THEN 'plyta' WHEN 4 THEN 'plyta' WHEN 8 THEN 'baner' END AS kind,
    CASE p_partkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN p_size WHEN 4 THEN p_size + 0.5 WHEN 8 THEN 0 END::DOUBLE AS thickness, CASE p_partkey % 9 WHEN 4 THEN 2 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 1 END::BIGINT AS sides FROM part"""

#: Stamps of returned files, some of them missing, damaged or of another version.
STAMPS_SQL = """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS pages, o_custkey % 2 AS page,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat(chr(123), '"v": 1, ') ELSE concat(chr(123), '"v": ', CAST(1 + CAST(o_orderkey % 13 = 0 AS INTEGER) AS VARCHAR(9)), ', "material": "m', CAST(o_custkey % 5 AS VARCHAR(9)), '", "netto_mm": [', CAST(100 + o_custkey % 900 AS VARCHAR(9)), ', ', CAST(200 + o_custkey % 700 AS VARCHAR(9)), '], "bleed_mm": ', CAST(o_custkey % 20 AS VARCHAR(9)), ', "safe_mm": ', CAST(o_custkey % 30 AS VARCHAR(9)),
        CASE WHEN o_custkey % 3 = 0 THEN concat(', "page_mm": [', CAST(150 + o_custkey % 90 AS VARCHAR(9)), ', 99], "scale": 10') ELSE '' END, ', "label": "x"', chr(125)) END AS raw,
    concat('back job-open:', CASE WHEN o_orderkey % 5 = 0 THEN 'a b' ELSE concat('T_', CAST(o_orderkey AS VARCHAR(19))) END, ' edge') AS printed
FROM orders
"""


def stamp_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each returned file is recognised, why not, the geometry its stamp stands for, and the token printed on it."""
    t = derived.from_sql(spark, sf_dir, STAMPS_SQL).withColumn("i", stamps.identified(F.col("raw"), F.col("pages"), F.col("page")))
    g = stamps.geometry(F.col("i.stamp"))
    at = lambda c, k: F.get(g[c], F.lit(k))
    seen = F.col("i.recognised")
    return t.select("file_id", seen.alias("recognised"), F.col("i.reason").alias("reason"), *[F.when(seen, x).alias(n) for n, x in (("brutto_w", at("brutto_mm", 0)), ("brutto_h", at("brutto_mm", 1)), ("safe_w", at("safe_mm_box", 0)), ("scale", g["scale"].cast("long")), ("strip_mm", g["strip_mm"]))], stamps.printed_token(F.col("printed"), "job-open").alias("token"))


STAMP_READS = f"""
WITH t AS (SELECT s.*, o_custkey AS ck FROM ({STAMPS_SQL}) s JOIN orders ON o_orderkey = file_id),
r AS (SELECT *, CASE WHEN pages IS NULL THEN 'unreadable' WHEN page >= pages THEN 'no such page' WHEN file_id % 7 = 0 THEN 'no stamp' WHEN file_id % 11 = 0 THEN 'damaged' WHEN file_id % 13 = 0 THEN 'other version' ELSE '' END AS reason FROM t)
SELECT file_id, reason = '' AS recognised, reason, CASE WHEN reason = '' THEN CASE WHEN ck % 3 = 0 THEN (150 + ck % 90) * 10 ELSE 100 + ck % 900 + 2 * (ck % 20) END END::DOUBLE AS brutto_w, CASE WHEN reason = '' THEN CASE WHEN ck % 3 = 0 THEN 990 ELSE 200 + ck % 700 + 2 * (ck % 20) END END::DOUBLE AS brutto_h,
    CASE WHEN reason = '' THEN 100 + ck % 900 - 2 * (ck % 30) END::DOUBLE AS safe_w, CASE WHEN reason = '' THEN CASE WHEN ck % 3 = 0 THEN 10 ELSE 1 END END::BIGINT AS scale, CASE WHEN reason = '' THEN 0.0 END::DOUBLE AS strip_mm, CASE WHEN file_id % 5 <> 0 AND file_id > 9 THEN concat('T_', file_id) END AS token FROM r"""


def declared_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the boxes each part's page declares, and of the page as it is declared and shown."""
    p = derived.from_sql(spark, sf_dir, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 700 AS DOUBLE) AS k FROM part")
    box = lambda *v: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v])
    raw = F.map_filter(F.create_map(F.lit("mediabox"), box(0, 0, F.col("k") + 72, 720), F.lit("cropbox"), F.when(F.col("p_partkey") % 3 == 0, box(10, F.col("s"), 154, 360)), F.lit("trimbox"), F.when(F.col("p_partkey") % 4 == 0, box(1, 2)), F.lit("other"), box(0, 0, 1, 1)), lambda k, v: v.isNotNull())
    return p.select("p_partkey", stamps.declared_boxes(raw).alias("boxes"), stamps.page_sizes(raw).alias("page")).select("p_partkey", F.size("boxes").cast("long").alias("boxes"), *[F.round(F.get(F.col(f"page.{c}"), F.lit(i)), 6).alias(f"{c}_{'wh'[i]}") for c in ("declared", "shown") for i in (0, 1)])


DECLARED = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS boxes, round((p_partkey % 700 + 72) * 25.4 / 72, 6) AS declared_w, 254.0::DOUBLE AS declared_h,
    round(CASE WHEN p_partkey % 3 = 0 THEN 144 ELSE p_partkey % 700 + 72 END * 25.4 / 72, 6) AS shown_w, round(CASE WHEN p_partkey % 3 = 0 THEN 360 - p_size ELSE 720 END * 25.4 / 72, 6) AS shown_h FROM part"""


def stamp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamp of each printed side of each template, read back."""
    t = derived.from_sql(spark, sf_dir, SHELF_SQL).select("token", "name", F.lit(None).cast("string").alias("material"), F.array("page_w", "page_h").alias("page_mm"), F.when(F.col("trim_h").isNotNull(), F.array("trim_w", "trim_h")).alias("netto_mm"), F.col("bleed").alias("bleed_mm"), F.col("safe").alias("safe_mm"), _sewn().alias("sewn_sides_mm"), "scale", "sides", F.when(F.col("nk") % 5 == 0, False).alias("back_mirrored"))
    own = stamps.template_payloads(t).withColumn("s", F.from_json("stamp", stamps.STAMP))
    return own.select("token", "side", "mirrored", F.get("s.netto_mm", F.lit(0)).alias("netto_w"), F.get("s.page_mm", F.lit(1)).alias("page_h"), F.col("s.bleed_mm").alias("bleed_mm"), F.element_at("s.safe_total_sides_mm", F.lit("left")).alias("left_mm"), F.col("s.label").alias("label"))


PAYLOADS = f"""
SELECT token, side::INTEGER AS side, side = 2 AND nk % 5 <> 0 AS mirrored, CASE WHEN trim_h IS NULL THEN page_w ELSE trim_w END * greatest(1, scale::INTEGER) AS netto_w, page_h, bleed * greatest(1, scale::INTEGER) AS bleed_mm, (coalesce(sew_left, 0) + safe) * greatest(1, scale::INTEGER) AS left_mm, name AS label
FROM ({SHELF_SQL}) t, (VALUES (1), (2)) v(side) WHERE side = 1 OR sides = '2'"""


def published_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers see of each order's template: sides and kinds of lines, no geometry."""
    per = derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL).groupBy("token").agg(F.collect_list(F.struct("type", "w", "h")).alias("outlines"), F.max("ord").alias("sides"))
    return templates.published(per).select("token", F.col("sides").cast("long").alias("sides"), F.array_join("lines", ",").alias("lines"))


PUBLISHED = f"SELECT token, CASE WHEN max(ord) = 2 THEN 2 ELSE 1 END::BIGINT AS sides, string_agg(DISTINCT type, ',' ORDER BY type) AS lines FROM ({derived.OUTLINES_SQL}) o GROUP BY token"


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each kind a template has, their area, and whether the kind trims."""
    per = templates.outlines_by_type(derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL))
    return per.join(F.broadcast(templates.for_browser(spark, {"cut": (1.0, 0.0, 0.5)})), per["type"] == F.col("id")).select("token", "type", "outlines", "area", "defines_trim", "stroke")


LINE_KINDS = f"SELECT token, lower(type) AS type, count(*) AS outlines, sum(w * h) AS area, lower(type) IN ('cut', 'cutcontour') AS defines_trim, CASE WHEN lower(type) = 'cut' THEN '#ff0080' ELSE '#000000' END AS stroke FROM ({derived.OUTLINES_SQL}) o GROUP BY token, lower(type)"


def outside_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as elements that leave their safe box, and by how much."""
    e = derived.from_sql(spark, sf_dir, "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_partkey % 120 AS DOUBLE) AS x0, CAST(l_suppkey % 90 AS DOUBLE) AS y0, CAST(l_partkey % 120 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 90 + l_quantity / 2 AS DOUBLE) AS y1 FROM lineitem")
    safe = {"safe_x0": 10.0, "safe_y0": 12.0, "safe_x1": 130.0, "safe_y1": 100.0}
    return templates.outside_safe(e.withColumns({k: F.lit(v) for k, v in safe.items()})).select("l_orderkey", "l_partkey", "l_suppkey", "over")


OUTSIDE = """
WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey, greatest(10.0 - l_partkey % 120, 12.0 - l_suppkey % 90, l_partkey % 120 + l_quantity - 130, l_suppkey % 90 + l_quantity / 2 - 100)::DOUBLE AS over FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, round(over, 2) AS over FROM e WHERE over > 0.01"""


def wording_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of codes: the shop's own, the default, or the code; rendered, as a label, and their level."""
    p = derived.from_sql(spark, sf_dir, "SELECT p_partkey, p_size FROM part")
    own = spark.createDataFrame([("check.overprint.on", "Own {size} of {ink} {none}"), ("check.filename.dots", ""), ("panelled", "In {size}")], "code string, template string")
    code = F.element_at(F.array(*map(F.lit, ("check.overprint.on", "check.filename.dots", "panelled", "unheard.of"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    t = p.withColumn("code", code).withColumn("values", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("ink"), F.lit("{size}")))
    return wording.rendered(t, own).select("p_partkey", "text", "label", "level", "optional")


WORDING_TEXTS = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Own ', p_size, ' of {size} {none}') WHEN 1 THEN 'The name has more than one dot' WHEN 2 THEN concat('In ', p_size) ELSE 'unheard.of' END AS text,
    CASE p_partkey % 4 WHEN 0 THEN 'Own … of … …' WHEN 1 THEN 'The name has more than one dot' WHEN 2 THEN 'In …' ELSE 'unheard.of' END AS label, CASE WHEN p_partkey % 4 = 2 THEN 'info' ELSE 'error' END AS level,
    CASE p_partkey % 4 WHEN 0 THEN concat('Own ', p_size, ' of {size} {none}') WHEN 1 THEN 'The name has more than one dot' WHEN 2 THEN concat('In ', p_size) END AS optional FROM part"""


def checked_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each material of a price list fails."""
    t = derived.from_sql(spark, sf_dir, MATERIALS_SQL)
    typed = t.select("ord", *[(F.col(c) if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in shop.MATERIAL.items()])
    return shop.checked(typed).select("ord", "problem")


MATERIALS_SQL = """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 17 = 0 THEN 'Bad Id' WHEN p_partkey % 19 = 0 THEN 'twin' ELSE concat('m-', CAST(p_partkey AS VARCHAR(19))) END AS id, CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE p_name END AS name,
    CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_size * 11 AS DOUBLE) END AS bleed_mm, CAST(p_size - 2 AS DOUBLE) AS safe_mm, CASE WHEN p_partkey % 31 = 0 THEN CAST(-1 AS DOUBLE) END AS min_dpi, CASE p_partkey % 37 WHEN 0 THEN 'rgb' WHEN 1 THEN 'cmyk' END AS colour, CASE p_partkey % 41 WHEN 0 THEN 'left' WHEN 1 THEN 'below' END AS spec_position
FROM part
"""
CHECKED_MATERIALS = f"""
WITH m AS ({MATERIALS_SQL})
SELECT ord, CASE WHEN id = 'Bad Id' THEN 'id' WHEN trim(coalesce(name, '')) = '' THEN 'name' WHEN bleed_mm IS NULL OR bleed_mm < 0 OR bleed_mm > 500 THEN 'bleed_mm' WHEN safe_mm IS NULL OR safe_mm < 0 OR safe_mm > 500 THEN 'safe_mm' WHEN min_dpi < 0 THEN 'min_dpi' WHEN colour = 'rgb' THEN 'colour' WHEN spec_position = 'left' THEN 'spec_position' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END AS problem FROM m"""


def usable_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders' templates can be used: a token, a page, and outlines that all have segments."""
    rows = derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL)
    segments = F.when((F.col("token") % 9 == 0) & (F.col("ord") == 2), F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("l"))))
    per = rows.groupBy("token").agg(F.collect_list(F.struct(segments.alias("segments"))).alias("outlines"))
    t = F.struct(F.when(F.col("token") % 8 == 0, " ").otherwise(F.col("token").cast("string")).alias("token"), F.when(F.col("token") % 7 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("page_mm"), F.col("outlines"))
    return per.select("token", F.explode(shop.usable(F.array(t))).alias("t")).select("token", F.size("t.outlines").cast("long").alias("outlines"))


USABLE = f"SELECT token, count(*) AS outlines FROM ({derived.OUTLINES_SQL}) o WHERE token % 8 <> 0 AND token % 7 <> 0 GROUP BY token HAVING NOT (token % 9 = 0 AND bool_or(ord = 2))"


def candidate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that fit each file's outlines, and behind them those whose trim its name says."""
    from .measuring import ranking

    tables = ranking(spark, sf_dir)
    shelf = derived.from_sql(spark, sf_dir, SHELF_SQL).select("token", "name", "trim_w", "trim_h")
    named = derived.from_sql(spark, sf_dir, "SELECT c_custkey AS file_id, CAST(400 + c_nationkey * 30 AS DOUBLE) AS w, CAST(101 + c_custkey % 60 * 45 AS DOUBLE) AS h FROM customer")
    more = lambda pairs: outlines.unranked(pairs, tables[0], tables[3])
    return templates.named_candidates(outlines.ranked(*tables), shelf, named, more).select("file_id", "token", "matched", "outlines")


def _candidates() -> str:
    from .measuring import RANKS

    near = lambda a, b: f"abs({a} - {b}) <= greatest(0.5, {b} * 0.02)"
    return f"""
WITH k AS ({RANKS}), t AS ({SHELF_SQL}), n AS (SELECT c_custkey AS file_id, (400 + c_nationkey * 30)::DOUBLE AS w, (101 + c_custkey % 60 * 45)::DOUBLE AS h FROM customer),
m AS (SELECT file_id, token FROM n JOIN t ON ({near("w", "trim_w")} AND {near("h", "trim_h")}) OR ({near("h", "trim_w")} AND {near("w", "trim_h")}))
SELECT file_id, token, matched, outlines FROM k UNION ALL SELECT file_id, token, 0, 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file_id = m.file_id AND k.token = m.token)"""


def kept_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that still hold an outline of their template."""
    own = derived.from_sql(spark, sf_dir, derived.CUTS_SQL).select("token", "w", "h")
    up = derived.from_sql(spark, sf_dir, derived.UPLOADS_SQL).select("file_id", (F.col("file_id") % 100 + 1).alias("token"), "w", "h")
    return outlines.guides_present(up, own)


KEPT_GUIDES = f"WITH c AS ({derived.CUTS_SQL}), u AS ({derived.UPLOADS_SQL}) SELECT DISTINCT file_id FROM u JOIN c ON c.token = u.file_id % 100 + 1 AND abs(u.w - c.w) <= 1 AND abs(u.h - c.h) <= 1"


def large_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's outlines from the least area on, by area, and whether they are as large as the page."""
    rows = derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL).withColumn("file_id", F.col("token"))
    out = outlines.candidates(rows.select("file_id", "ord", "w", "h"), 90_000.0)
    return out.select("file_id", "ord", F.col("place").cast("long").alias("place"), scenes.page_sized(F.col("w"), F.col("h"), F.lit(300.0), F.lit(400.5)).alias("page_sized"))


LARGE = f"SELECT token AS file_id, ord, row_number() OVER (PARTITION BY token ORDER BY w * h DESC, ord) AS place, abs(w - 300) <= 1 AND abs(h - 400.5) <= 1 AS page_sized FROM ({derived.OUTLINES_SQL}) o WHERE w * h >= 90000"


def bare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose verdict is ok once a bare template and a back have been taken into account."""
    t = derived.cases(spark, sf_dir).withColumn("n", F.crc32("file_id"))
    bare = templates.bare(F.col("facts.guides_present"), F.transform(F.col("facts.blank_edges_mm"), lambda x: x * 40), F.col("expected.brutto_mm"), F.col("n") % 3 == 0, F.when(F.col("n") % 2 == 0, 1), F.col("facts.fonts"))
    return rules.summarise(t, bare=bare, back=F.col("n") % 5 == 0).filter("verdict = 'ok'").select("file_id")


QUERIES = {
    "editor_frames": (editor_frames, FRAMES), "topmost_elements": (topmost_elements, TOPMOST), "design_summaries": (design_summaries, SUMMARIES), "template_facts": (template_facts, TEMPLATE_FACTS), "typed_checks": (typed_checks, TYPED_CHECKS),
    "page_fractions": (page_fractions, PAGE_FRACTIONS), "material_scenes": (material_scenes, SCENES), "stamp_reads": (stamp_reads, STAMP_READS), "declared_sizes": (declared_sizes, DECLARED), "stamp_payloads": (stamp_payloads, PAYLOADS),
    "published_templates": (published_templates, PUBLISHED), "line_kinds": (line_kinds, LINE_KINDS), "outside_safe": (outside_safe, OUTSIDE), "wording_texts": (wording_texts, WORDING_TEXTS), "checked_materials": (checked_materials, CHECKED_MATERIALS),
    "usable_templates": (usable_templates, USABLE), "candidate_templates": (candidate_templates, _candidates()), "kept_guides": (kept_guides, KEPT_GUIDES), "large_outlines": (large_outlines, LARGE), "bare_files": (bare_files, None),
}
