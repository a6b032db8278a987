"""Queries of items, outlines, geometry, meshes and rasters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import items, mesh, outlines, scenes
from ..schemas import MATERIAL, as_struct
from . import derived
from .drawing import points_of
from .tracking import read


def _materials(spark: SparkSession) -> DataFrame:
    t = spark.sql(derived.MATERIALS_SQL)
    own = {"id": "mat_id", "bleed_mm": "mat_bleed", "safe_mm": "mat_safe", "min_dpi": "mat_dpi", "max_width_mm": "mat_roll", "finishing_mm": "mat_finishing", "min_text_mm": "mat_text", "colour": "mat_colour", "spec_position": "mat_spec", "cut_path": "mat_cut"}
    t = t.select("mat", *[F.col(v).alias(k) for k, v in own.items()])
    return t.select("mat", as_struct(t, MATERIAL).alias("material"))


def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as orders of a material and a size: what is wrong with them, or their geometry."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity"), (F.col("l_partkey") % 6).cast("int").alias("mat"))
    sized = lines.withColumns({"width_mm": (F.col("l_partkey") % 97 - 1) * 60.0 + F.when(F.col("l_suppkey") % 50 == 0, 99_000.0).otherwise(0.0), "height_mm": F.col("l_quantity") * 400.0})
    out = items.resolved(sized.join(F.broadcast(_materials(spark)), "mat", "left"))
    item = lambda n: F.col(f"item.{n}")
    page = items.page_size(F.col("item"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", item("problem").alias("problem"), item("scale").cast("double").alias("scale"), item("panels").cast("double").alias("panels"), item("spec_position").alias("spec_position"), F.array_join(item("notices"), ",").alias("notices"), F.get(page, F.lit(0)).alias("page_w"), F.get(page, F.lit(1)).alias("page_h"))


RESOLVED = f"""
WITH m AS ({derived.MATERIALS_SQL}),
l AS (SELECT l_orderkey, l_partkey, l_suppkey, m.*, (l_partkey % 97 - 1) * 60.0::DOUBLE + CASE WHEN l_suppkey % 50 = 0 THEN 99000.0::DOUBLE ELSE 0 END AS w, l_quantity * 400.0::DOUBLE AS h FROM lineitem LEFT JOIN m ON l_partkey % 6 = m.mat),
p AS (SELECT *, CASE WHEN mat_roll IS NULL THEN 1 ELSE greatest(1, ceil((least(w, h) + 2 * mat_bleed) / mat_roll))::INTEGER END AS pan,
    CASE WHEN greatest(w, h) + 2 * mat_bleed <= 4800 THEN 1 WHEN (greatest(w, h) + 2 * mat_bleed) / 2 <= 4800 THEN 2 WHEN (greatest(w, h) + 2 * mat_bleed) / 4 <= 4800 THEN 4 WHEN (greatest(w, h) + 2 * mat_bleed) / 5 <= 4800 THEN 5
        WHEN (greatest(w, h) + 2 * mat_bleed) / 10 <= 4800 THEN 10 WHEN (greatest(w, h) + 2 * mat_bleed) / 20 <= 4800 THEN 20 END AS sc FROM l),
q AS (SELECT *, CASE WHEN mat_id IS NULL THEN 'unknown_material' WHEN NOT (w > 0 AND h > 0) THEN 'must_be_positive' WHEN mat_safe * 2 >= least(w, h) THEN 'safe_area_eats_job'
    WHEN pan > 1 AND (greatest(w, h) + 2 * mat_bleed > 25000 OR least(w, h) + 2 * mat_bleed > 15000) THEN 'too_big_to_panel' WHEN sc IS NULL THEN 'too_big_for_pdf' END AS problem FROM p),
r AS (SELECT *, CASE WHEN mat_spec = 'margin' AND mat_bleed < 12 THEN 'below' ELSE mat_spec END AS spec FROM q)
SELECT l_orderkey, l_partkey, l_suppkey, problem, CASE WHEN problem IS NULL THEN sc END::DOUBLE AS scale, CASE WHEN problem IS NULL THEN pan END::DOUBLE AS panels, CASE WHEN problem IS NULL THEN spec END AS spec_position,
    CASE WHEN problem IS NULL THEN concat_ws(',', CASE WHEN pan > 1 THEN 'panelled' END, CASE WHEN sc <> 1 THEN 'scaled' END) END AS notices,
    CASE WHEN problem IS NULL THEN (w + 2 * mat_bleed) / sc END AS page_w, CASE WHEN problem IS NULL THEN (h + 2 * mat_bleed) / sc + CASE WHEN spec = 'below' THEN 22.0 ELSE 0.0 END END AS page_h FROM r"""


def typed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions as customers type them, from prices: with commas, blanks and units, some of them wrong."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"))
    value = F.when(F.col("k") % 11 == 0, "").when(F.col("k") % 13 == 0, "abc").when(F.col("k") % 17 == 0, "-5").otherwise(F.concat(F.lit(" "), (F.col("k") % 300).cast("string"), F.when(F.col("k") % 2 == 0, ",5").otherwise(".25"), F.lit(" ")))
    unit = F.element_at(F.array(*map(F.lit, ("mm", "CM", " m ", "furlong"))), (F.col("k") % 4 + 1).cast("int"))
    return p.select("p_partkey", items.parsed_dimension(value, unit).alias("d")).select("p_partkey", "d.mm", "d.problem")


TYPED = """
WITH t AS (SELECT p_partkey, p_partkey AS k, (p_partkey % 300 + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.25 END)::DOUBLE AS n, (['mm', 'cm', 'm', 'furlong'])[p_partkey % 4 + 1] AS u FROM part),
f AS (SELECT *, n * CASE u WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 WHEN 'm' THEN 1000.0 END::DOUBLE AS x FROM t),
p AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'dimensions_required' WHEN k % 13 = 0 THEN 'not_a_number' WHEN k % 17 = 0 THEN 'must_be_positive' WHEN u = 'furlong' THEN 'unknown_unit' WHEN x > 100000 THEN 'absurd_dimension' END AS problem FROM f)
SELECT p_partkey, CASE WHEN problem IS NULL THEN x END AS mm, problem FROM p"""


def role_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each order's outlines by their roles."""
    out = outlines.role_boxes(derived.from_sql(spark, sf_dir, derived.OUTLINES_SQL))
    side = lambda c, k: F.get(c, F.lit(k)).alias(f"{c}_{'wh'[k]}")
    return out.select("token", *[side(c, k) for c in ("brutto", "netto", "safe") for k in (0, 1)], "safe_from")


def _ends(role: str, test: str) -> str:
    return f"max(x + w) FILTER (WHERE {test}) - min(x) FILTER (WHERE {test}) AS {role}_w, max(y + h) FILTER (WHERE {test}) - min(y) FILTER (WHERE {test}) AS {role}_h"


ROLES = f"""
WITH o AS (SELECT *, lower(type) AS kind FROM ({derived.OUTLINES_SQL}) o),
v AS (SELECT token, {_ends("cut", "kind IN ('cut', 'cutcontour') AND w IS NOT NULL")}, {_ends("bleed", "kind = 'bleed' AND w IS NOT NULL")}, {_ends("drawn", "kind = 'safe' AND w IS NOT NULL")}, {_ends("base", "safe_base AND w IS NOT NULL")} FROM o GROUP BY token),
b AS (SELECT *, base_w - 50 > 0 AND base_h - 50 > 0 AS base_ok, cut_w - 50 > 0 AND cut_h - 50 > 0 AS cut_ok FROM v)
SELECT token, coalesce(bleed_w, cut_w + 20, 1200.0) AS brutto_w, coalesce(bleed_h, cut_h + 20, 900.0) AS brutto_h, cut_w AS netto_w, cut_h AS netto_h,
    coalesce(drawn_w, CASE WHEN base_ok THEN base_w - 50 END, CASE WHEN cut_ok THEN cut_w - 50 END) AS safe_w, coalesce(drawn_h, CASE WHEN base_ok THEN base_h - 50 END, CASE WHEN cut_ok THEN cut_h - 50 END) AS safe_h,
    CASE WHEN drawn_w IS NOT NULL THEN 'drawn' WHEN base_w IS NOT NULL THEN 'base' WHEN cut_w IS NOT NULL THEN 'cut' END AS safe_from FROM b"""


def ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Templates, their cuts, files' outlines and files' pages."""
    uploads = derived.from_sql(spark, sf_dir, derived.UPLOADS_SQL)
    return derived.from_sql(spark, sf_dir, derived.TEMPLATES_SQL), derived.from_sql(spark, sf_dir, derived.CUTS_SQL), uploads, uploads.select("file_id", "page_w", "page_h").distinct()


def template_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which templates fit each file's page, and how many of their cuts it has."""
    return outlines.ranked(*ranking(spark, sf_dir))


_RANKED = f"""
WITH t AS ({derived.TEMPLATES_SQL}), c AS ({derived.CUTS_SQL}), u AS ({derived.UPLOADS_SQL}),
f AS (SELECT DISTINCT file_id, page_w AS fw, page_h AS fh FROM u),
p AS (SELECT file_id, token, name, t.ord FROM f JOIN t ON abs(fw - page_w) <= 3 AND abs(fh - page_h) <= 3),
m AS (SELECT p.file_id, p.token, any_value(p.name) AS name, any_value(p.ord) AS ord, count(*) AS outlines, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM u WHERE u.file_id = p.file_id AND closed AND abs(u.w - c.w) <= 1 AND abs(u.h - c.h) <= 1)) AS matched FROM p JOIN c ON c.token = p.token AND c.type = 'cut' GROUP BY p.file_id, p.token),
r AS (SELECT file_id, token, name, matched, outlines, row_number() OVER (PARTITION BY file_id ORDER BY matched DESC, name, ord)::INTEGER AS place FROM m)"""
RANKS = f"{_RANKED} SELECT * FROM r"


def decisive_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template each file belongs to beyond doubt."""
    files, places = outlines.ranked_kinds(*ranking(spark, sf_dir))
    return outlines.decisive(places, "alike").join(files, "alike").select("file_id", "token", "matched")


DECISIVE = f"{_RANKED} SELECT file_id, token, matched FROM r a WHERE place = 1 AND matched >= 2 AND matched > coalesce((SELECT matched FROM r b WHERE b.file_id = a.file_id AND b.place = 2), -1)"


def near_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose price and size some line comes near: a tolerance join on two measures."""
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price_p"), F.col("p_size").cast("double").alias("size_p"))
    return outlines.within(parts, lines, {"price_p": "price", "size_p": "qty"}, 0.05).select("p_partkey")


NEAR = "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE abs(p_retailprice - l_extendedprice / l_quantity) <= 0.05 AND abs(p_size - l_quantity) <= 0.05)"


def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs that a page's size may be."""
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (300.0 + F.col("p_partkey") % 60 * 5).alias("w"), (500.0 + F.col("p_size") * 2).alias("h"))
    jobs = read(spark, sf_dir, "supplier").select((300.0 + F.col("s_suppkey") % 50 * 5).alias("netto_w"), (480.0 + F.col("s_nationkey") * 5).alias("netto_h")).distinct()
    shop = _materials(spark).select("material.id", "material.bleed_mm")
    return items.answers_for_page(pages, shop, jobs)


ANSWERS = f"""
WITH m AS ({derived.MATERIALS_SQL}), p AS (SELECT p_partkey AS page_id, (300.0 + p_partkey % 60 * 5)::DOUBLE AS w, (500.0 + p_size * 2)::DOUBLE AS h FROM part),
n AS (SELECT DISTINCT (300.0 + s_suppkey % 50 * 5)::DOUBLE AS netto_w, (480.0 + s_nationkey * 5)::DOUBLE AS netto_h FROM supplier)
SELECT page_id, mat_id AS id, netto_w, netto_h FROM p, n, m WHERE abs(w - netto_w - 2 * mat_bleed) <= 0.5 AND abs(h - netto_h - 2 * mat_bleed) <= 0.5"""


def making(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part as a banner: eyelets along a side, seams across it."""
    p = read(spark, sf_dir, "part")
    length, roll = F.col("p_size") * 130.0, F.lit(1600.0)
    join = lambda a: F.array_join(F.transform(a, lambda x: F.bround(x, 1).cast("string")), " ")
    return p.select("p_partkey", F.size(items.eyelets(length, F.lit(500.0))).cast("long").alias("eyelets"), join(items.seams(length, roll)).alias("seams"))


MAKING = """
SELECT p_partkey, 1 + greatest(1, ceil(p_size * 130.0 / 500.0))::BIGINT AS eyelets,
    coalesce(array_to_string(list_transform(range(1, greatest(ceil((p_size * 130.0 - 1) / 1600.0)::BIGINT, 1)), lambda i: printf('%.1f', i * 1600.0)), ' '), '') AS seams FROM part"""


def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter, box of rings, whether the origin lies inside, and how far it is."""
    ring = F.col("ring")
    return points_of(spark, sf_dir).select("vec_id", F.round(geometry.signed_area(ring), 6).alias("area"), F.round(geometry.perimeter(ring), 6).alias("perimeter"), (geometry.box(ring)["x1"] - geometry.box(ring)["x0"]).alias("width"), geometry.inside(ring, F.lit(0.0), F.lit(0.0)).alias("holds_origin"), F.round(geometry.distance_to_ring(ring, F.lit(0.0), F.lit(0.0)), 6).alias("distance"), F.size(geometry.thinned(ring, 9)).cast("long").alias("thinned"), geometry.in_polygons(F.array(ring, F.slice(ring, 1, 16)), F.lit(0.0), F.lit(0.0)).alias("in_both"))


def _ring_sql(n: int) -> str:
    return f"""SELECT vec_id, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y, embedding[2 * ((i + 1) % {n}) + 1]::DOUBLE AS u, embedding[2 * ((i + 1) % {n}) + 2]::DOUBLE AS v FROM (SELECT vec_id, unnest(range({n})) AS i, embedding FROM embeddings) e"""


_CROSSES = "(y > 0) <> (v > 0) AND 0 < (u - x) * (0 - y) / (v - y) + x"
RINGS = f"""
WITH p AS ({_ring_sql(32)}),
t AS (SELECT *, CASE WHEN (u - x) ** 2 + (v - y) ** 2 = 0 THEN 0 ELSE least(1, greatest(0, -(x * (u - x) + y * (v - y)) / ((u - x) ** 2 + (v - y) ** 2))) END AS s FROM p),
h AS (SELECT vec_id, count(*) FILTER (WHERE {_CROSSES}) AS hits FROM ({_ring_sql(16)}) q GROUP BY vec_id)
SELECT vec_id, round(sum(x * v - u * y) / 2, 6) AS area, round(sum(sqrt((u - x) * (u - x) + (v - y) * (v - y))), 6) AS perimeter, max(x) - min(x) AS width, count(*) FILTER (WHERE {_CROSSES}) % 2 = 1 AS holds_origin,
    round(min(sqrt((x + s * (u - x)) ** 2 + (y + s * (v - y)) ** 2)), 6) AS distance, 9::BIGINT AS thinned, (count(*) FILTER (WHERE {_CROSSES}) % 2 + any_value(hits) % 2) % 2 = 1 AS in_both FROM t JOIN h USING (vec_id) GROUP BY vec_id"""


def curve_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the cubic curves through each embedding's points, four at a time."""
    at = lambda k: F.get("ring", F.lit(k))
    curves = [x for j in range(0, 32, 4) for x in (F.slice("ring", j + 1, 1), geometry.curve(at(j), at(j + 1), at(j + 2), at(j + 3)))]
    b = points_of(spark, sf_dir).select("vec_id", geometry.let(F.concat(*curves), geometry.box).alias("b"))
    return b.select("vec_id", *[F.round(f"b.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


CURVES = """
WITH e AS (SELECT vec_id, unnest(range(65)) / 64.0::DOUBLE AS t, list_transform(embedding, lambda v: v::DOUBLE) AS d FROM embeddings),
k AS (SELECT vec_id, t, d, unnest(range(8)) * 8 AS j FROM e),
p AS (SELECT vec_id, (1-t)*(1-t)*(1-t)*d[j+1] + 3*(1-t)*(1-t)*t*d[j+3] + 3*(1-t)*t*t*d[j+5] + t*t*t*d[j+7] AS x, (1-t)*(1-t)*(1-t)*d[j+2] + 3*(1-t)*(1-t)*t*d[j+4] + 3*(1-t)*t*t*d[j+6] + t*t*t*d[j+8] AS y FROM k)
SELECT vec_id, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM p GROUP BY vec_id"""


def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, from lines' numbers, clipped to a page of 100 by 100."""
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *[(c.cast("double") - 50).alias(n) for n, c in (("ax", F.col("l_partkey") % 190), ("ay", F.col("l_suppkey") % 170), ("bx", F.col("l_orderkey") % 210), ("by", F.col("l_quantity") * 4))])
    c = geometry.clipped(*[F.col(n) for n in ("ax", "ay", "bx", "by")], F.lit(100.0), F.lit(100.0))
    return s.select("l_orderkey", "l_partkey", "l_suppkey", F.round(F.hypot(c["x1"] - c["x0"], c["y1"] - c["y0"]), 6).alias("inside"))


CLIPPED = """
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_partkey % 190 - 50)::DOUBLE AS ax, (l_suppkey % 170 - 50)::DOUBLE AS ay, (l_orderkey % 210 - 50)::DOUBLE AS bx, l_quantity * 4 - 50 AS by_ FROM lineitem),
t AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM s),
r AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN -ax / dx WHEN dx < 0 THEN (100 - ax) / dx ELSE 0 END, CASE WHEN dy > 0 THEN -ay / dy WHEN dy < 0 THEN (100 - ay) / dy ELSE 0 END) AS lo,
    least(1, CASE WHEN dx > 0 THEN (100 - ax) / dx WHEN dx < 0 THEN -ax / dx ELSE 1 END, CASE WHEN dy > 0 THEN (100 - ay) / dy WHEN dy < 0 THEN -ay / dy ELSE 1 END) AS hi,
    (dx = 0 AND NOT ax BETWEEN 0 AND 100) OR (dy = 0 AND NOT ay BETWEEN 0 AND 100) AS beside FROM t)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN lo <= hi AND NOT beside THEN round(sqrt(dx * dx + dy * dy) * (hi - lo), 6) END AS inside FROM r"""


def die_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as contours: distinct ones by place and length, their sum, the exact median, closed and filled."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.bround(F.col("l_discount") * 100, 1).alias("x"), (F.col("l_partkey") % 40).cast("double").alias("length"), "l_linestatus", "l_returnflag")
    per = l.groupBy("l_orderkey", "x", "length").agg(F.bool_and(F.col("l_linestatus") == "O").alias("closed"), F.bool_or(F.col("l_returnflag") == "R").alias("filled"), F.collect_set("l_returnflag").alias("colours"))
    return per.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("contours"), F.sum("length").alias("length"), F.median("length").alias("median_length"), F.bool_and("closed").alias("closed"), F.bool_or("filled").alias("filled"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("colours")))), ",").alias("colorants"))


DIE = """
WITH c AS (SELECT l_orderkey, round(l_discount * 100, 1) AS x, (l_partkey % 40)::DOUBLE AS length, bool_and(l_linestatus = 'O') AS closed, bool_or(l_returnflag = 'R') AS filled FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS colorants FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, count(*) AS contours, sum(length) AS length, median(length) AS median_length, bool_and(closed) AS closed, bool_or(filled) AS filled, any_value(colorants) AS colorants FROM c JOIN n USING (l_orderkey) GROUP BY l_orderkey"""


def affine_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares maps from quantity and discount to price, by return flag and line status."""
    out = mesh.affine_fit(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount", "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 3).alias(c) for c in ("a", "b", "residual")])


AFFINE = """
WITH m AS (SELECT *, avg(l_quantity) OVER w AS mx, avg(l_discount) OVER w AS my, avg(l_extendedprice) OVER w AS mu FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)),
s AS (SELECT l_returnflag, l_linestatus, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, sum((l_quantity - mx) ** 2) AS xx, sum((l_quantity - mx) * (l_discount - my)) AS xy, sum((l_discount - my) ** 2) AS yy, sum((l_quantity - mx) * (l_extendedprice - mu)) AS xu, sum((l_discount - my) * (l_extendedprice - mu)) AS yu FROM m GROUP BY ALL),
f AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b FROM s),
c AS (SELECT *, mu - a * mx - b * my AS c FROM f)
SELECT l_returnflag, l_linestatus, round(any_value(a), 3) AS a, round(any_value(b), 3) AS b, round(max(abs(a * l_quantity + b * l_discount + c - l_extendedprice)), 3) AS residual FROM lineitem JOIN c USING (l_returnflag, l_linestatus) GROUP BY ALL"""


def mesh_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as triangles of meshes: the islands they make, numbered by their first triangle."""
    l = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("mesh").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = l.withColumn("mesh", F.floor(F.col("l_orderkey") / 4)).withColumn("t", (F.row_number().over(order) - 1).cast("long"))
    return mesh.islands(t.select("mesh", "t", (F.col("l_partkey") % 20).alias("v0"), (20 + F.col("l_suppkey") % 20).alias("v1"), (40 + F.col("l_linenumber") + F.col("l_orderkey") % 4 * 7).alias("v2")))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What carries each line's print, and how many panels of it."""
    w, h = (F.col("l_partkey") % 150) * 100.0, F.col("l_quantity") * 100
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", scenes.carrier(w, h).alias("carrier"), scenes.carriers_needed(w, F.lit(2500.0)).alias("panels"))


CARRIERS = """
WITH s AS (SELECT *, (l_partkey % 150) * 100.0::DOUBLE AS w, l_quantity * 100 AS h FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN h <= 1000 THEN 'barrier' WHEN h <= 2000 THEN 'fence' WHEN w <= 12000 AND h <= 4000 THEN 'billboard' ELSE 'frame' END AS carrier, greatest(1, ceil(w / 2500.0))::INTEGER AS panels FROM s"""

MESH = """
WITH RECURSIVE t AS (SELECT l_orderkey // 4 AS mesh, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS t, [l_partkey % 20, 20 + l_suppkey % 20, 40 + l_linenumber + l_orderkey % 4 * 7] AS vs FROM lineitem),
near AS (SELECT DISTINCT a.mesh, a.t AS x, b.t AS y FROM t a JOIN t b ON a.mesh = b.mesh AND list_has_any(a.vs, b.vs)),
reach AS (SELECT mesh, x, y FROM near UNION SELECT r.mesh, r.x, n.y FROM reach r JOIN near n ON n.mesh = r.mesh AND n.x = r.y),
firsts AS (SELECT mesh, x AS t, min(y) AS first FROM reach GROUP BY mesh, x)
SELECT mesh, t, (dense_rank() OVER (PARTITION BY mesh ORDER BY first) - 1)::INTEGER AS island FROM firsts"""

def space_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from lines' numbers, as points in space, by line number; those of odd numbers lie in a plane."""
    l = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100
    t = l.select("l_linenumber", x.alias("x"), y.alias("y"), F.when(F.col("l_linenumber") % 2 == 1, x + 2 * y).otherwise(F.col("l_tax").cast("double") * 100).alias("z"), (F.col("l_extendedprice").cast("double") / 1000).alias("u"), (F.col("l_partkey") % 100).cast("double").alias("v"))
    out = mesh.space_fit(t, ["l_linenumber"], "x", "y", "z", "u", "v")
    return out.select("l_linenumber", "flat", *[F.when(~F.col("flat"), F.round(c, 5)).alias(c) for c in ("au", "cu", "bv", "dv")], F.round("residual_u", 2).alias("residual_u"), F.round("residual_v", 2).alias("residual_v"))


def _cofactors(r: str) -> str:
    """Cramer's rule for three unknowns about the middle, as SQL: the numerators of a, b, c for the right side r."""
    m = [["xx", "xy", "xz"], ["xy", "yy", "yz"], ["xz", "yz", "zz"]]
    det = lambda n: " ".join(f"{s} {n[0][i]} * ({n[1][j]} * {n[2][k]} - {n[1][k]} * {n[2][j]})" for s, i, j, k in (("", 0, 1, 2), ("-", 1, 0, 2), ("+", 2, 0, 1)))
    swap = lambda col: [[f"{'xyz'[i]}{r}" if j == col else m[i][j] for j in range(3)] for i in range(3)]
    return ", ".join(f"({det(swap(k))}) / ({det(m)}) AS {'abc'[k]}{r}" for k in range(3))


#: In a plane the third number tells nothing, so the map of the first two has the same errors.
SPACE = f"""
WITH p AS (SELECT l_linenumber AS k, l_quantity::DOUBLE AS x, l_discount::DOUBLE * 100 AS y, l_tax::DOUBLE * 100 AS z, l_extendedprice::DOUBLE / 1000 AS u, (l_partkey % 100)::DOUBLE AS v FROM lineitem),
m AS (SELECT *, k % 2 = 1 AS flat, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz, u - avg(u) OVER w AS du, v - avg(v) OVER w AS dv FROM p WINDOW w AS (PARTITION BY k)),
s AS (SELECT k, any_value(flat) AS flat, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv, sum(dx * dx) AS xx, sum(dx * dy) AS xy, CASE WHEN any_value(flat) THEN 0 ELSE sum(dx * dz) END AS xz, sum(dy * dy) AS yy, CASE WHEN any_value(flat) THEN 0 ELSE sum(dy * dz) END AS yz, CASE WHEN any_value(flat) THEN 1 ELSE sum(dz * dz) END AS zz,
    sum(dx * du) AS xu, sum(dy * du) AS yu, CASE WHEN any_value(flat) THEN 0 ELSE sum(dz * du) END AS zu, sum(dx * dv) AS xv, sum(dy * dv) AS yv, CASE WHEN any_value(flat) THEN 0 ELSE sum(dz * dv) END AS zv FROM m GROUP BY k),
f AS (SELECT *, {_cofactors("u")}, {_cofactors("v")} FROM s),
e AS (SELECT m.k, max(abs(au * dx + bu * dy + cu * dz - du)) AS ru, max(abs(av * dx + bv * dy + cv * dz - dv)) AS rv FROM m JOIN f ON f.k = m.k GROUP BY m.k)
SELECT f.k AS l_linenumber, flat, CASE WHEN NOT flat THEN round(au, 5) END AS au, CASE WHEN NOT flat THEN round(cu, 5) END AS cu, CASE WHEN NOT flat THEN round(bv, 5) END AS bv, CASE WHEN NOT flat THEN round(mv - av * mx - bv * my - cv * mz, 5) END AS dv, round(ru, 2) AS residual_u, round(rv, 2) AS residual_v FROM f JOIN e ON e.k = f.k"""

QUERIES = {
    "carriers": (carriers, CARRIERS),
    "resolved_items": (resolved_items, RESOLVED), "typed_dimensions": (typed_dimensions, TYPED), "role_boxes": (role_boxes, ROLES), "template_ranks": (template_ranks, RANKS), "decisive_templates": (decisive_templates, DECISIVE),
    "near_prices": (near_prices, NEAR), "page_answers": (page_answers, ANSWERS), "making": (making, MAKING), "ring_measures": (ring_measures, RINGS), "curve_boxes": (curve_boxes, CURVES), "clipped_segments": (clipped_segments, CLIPPED),
    "die_rollup": (die_rollup, DIE), "affine_fits": (affine_fits, AFFINE), "mesh_islands": (mesh_islands, MESH), "space_fits": (space_fits, SPACE),
}
