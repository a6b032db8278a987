"""Queries of pictures, dies, polygons, meshes and declared resources on derived rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import die, mesh, placements, polygons, raster
from ..staging import staged
from . import derived
from .tracking import read

#: Pictures: a vector's numbers as eight rows of eight grey pixels.
SIDE = 8


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest((x.cast("double") * 600 + 250).cast("int"), F.lit(0)), F.lit(255))), 2, "0"))
    data = F.unhex(F.array_join(F.flatten(F.transform(byte, lambda b: F.array(b, b, b))), ""))
    return raster.pixels(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(SIDE).alias("width"), data.alias("pixels")))


_PX = "px AS (SELECT id, i % 8 AS x, i // 8 AS y, greatest(0, least(255, trunc(v[i + 1]::DOUBLE * 600 + 250)))::INTEGER AS g FROM (SELECT vec_id AS id, embedding AS v, unnest(range(64)) AS i FROM embeddings) e)"


def raster_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each picture: its share of ink, how far in lasting ink begins, whether a guide is left, and how many tiles have detail."""
    px = _pixels(spark, sf_dir)
    share = px.groupBy("id").agg(F.round(F.avg(raster.ink().cast("int")), 6).alias("ink_share"))
    found = raster.tiles(raster.detail(px), 0.5).groupBy(F.col("page").alias("id")).agg(F.count(F.lit(1)).alias("detail_tiles"))
    out = share.join(raster.blank_edges(px, 0.5), "id").join(raster.guides(px, 0.5, 6.0), "id").join(found, "id", "left")
    return out.withColumn("detail_tiles", F.coalesce("detail_tiles", F.lit(0).cast("long")))


RASTER = f"""
WITH {_PX},
l AS (SELECT id, 'x' AS axis, x AS at_, avg((g < 250)::INTEGER) >= 0.55 AS inked FROM px GROUP BY id, x UNION ALL SELECT id, 'y', y, avg((g < 250)::INTEGER) >= 0.55 FROM px GROUP BY id, y),
r AS (SELECT *, inked AND coalesce(lag(inked) OVER (PARTITION BY id, axis ORDER BY at_), false) AS run FROM l),
a AS (SELECT id, axis, coalesce(min(at_ - 1) FILTER (WHERE run), 4) * 2.0 AS near, coalesce(7 - max(at_) FILTER (WHERE run), 4) * 2.0 AS far, bool_or(inked AND at_ BETWEEN 2 AND 4) AND NOT bool_or(inked AND at_ = 1) AND NOT bool_or(inked AND at_ = 5) AS guide FROM r GROUP BY id, axis),
d AS (SELECT *, greatest(abs(g - coalesce(lag(g) OVER (PARTITION BY id, y ORDER BY x), g)), abs(g - coalesce(lag(g) OVER (PARTITION BY id, x ORDER BY y), g))) >= 34 AS detail FROM px),
t AS (SELECT id, count(*) FILTER (WHERE share >= 0.06) AS detail_tiles FROM (SELECT id, avg(detail::INTEGER) AS share FROM d GROUP BY id, x // 5, y // 5) s GROUP BY id),
s AS (SELECT id, round(avg((g < 250)::INTEGER), 6) AS ink_share, bool_or(g < 250) AS inked FROM px GROUP BY id)
SELECT s.id, ink_share, CASE WHEN s.inked THEN x.near ELSE 8.0 END::DOUBLE AS left, CASE WHEN s.inked THEN y.near ELSE 8.0 END::DOUBLE AS top, CASE WHEN s.inked THEN x.far ELSE 8.0 END::DOUBLE AS right, CASE WHEN s.inked THEN y.far ELSE 8.0 END::DOUBLE AS bottom, x.guide OR y.guide AS guides_present, detail_tiles
FROM s JOIN a x ON x.id = s.id AND x.axis = 'x' JOIN a y ON y.id = s.id AND y.axis = 'y' JOIN t ON t.id = s.id"""


def intrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep detail reaches into each picture's margins. Its regions fuse in an order that SQL can't follow."""
    return raster.intrusions(_pixels(spark, sf_dir), dict.fromkeys(raster.SIDES, 4.0), 0.5)[1]


def free_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rectangle without ink in each picture."""
    return raster.free_rectangles(_pixels(spark, sf_dir).select("id", "x", "y", (~raster.ink()).alias("free"))).select("id", (F.col("w") * F.col("h")).alias("area"))


FREE = f"""
WITH {_PX}, k AS (SELECT unnest(range(8)) AS n), r AS (SELECT a.n AS x0, b.n AS x1, c.n AS y0, d.n AS y1, (b.n - a.n + 1) * (d.n - c.n + 1) AS area FROM k a, k b, k c, k d WHERE a.n <= b.n AND c.n <= d.n),
taken AS (SELECT DISTINCT id, x0, x1, y0, y1 FROM px JOIN r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE g < 250)
SELECT i.id, max(area)::BIGINT AS area FROM (SELECT DISTINCT id FROM px) i, r WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.id = i.id AND t.x0 = r.x0 AND t.x1 = r.x1 AND t.y0 = r.y0 AND t.y1 = r.y1) GROUP BY i.id"""


def cleared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each picture have no dark pixel within one cell."""
    px = _pixels(spark, sf_dir)
    free = raster.cleared(px.select("id", "x", "y"), px.filter("r < 150").select("id", "x", "y"), 1)
    return free.groupBy("id").agg(F.count_if("free").alias("free"))


CLEARED = f"WITH {_PX} SELECT id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.id = p.id AND q.g < 150 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1)) AS free FROM px p GROUP BY id"


#: Contours of dies: lines as rectangles.
CONTOURS_SQL = """
SELECT l_orderkey AS file_id, CAST(l_linenumber % 3 * 10 AS DOUBLE) AS x, CAST(l_partkey % 4 * 5 AS DOUBLE) AS y, CAST(l_suppkey % 5 * 10 + 10 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h, l_linestatus = 'O' AS closed, l_returnflag = 'R' AS filled, concat('Cut', l_returnflag) AS colorant FROM lineitem
"""


def die_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's die, rolled up from its contours."""
    t = derived.from_sql(spark, sf_dir, CONTOURS_SQL)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return die.rolled_up(t.withColumn("ring", F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))))


CONTOURS = f"""
WITH c AS (SELECT file_id, x, y, w, h, bool_or(closed) AS closed, max(2 * w + h + CASE WHEN closed THEN h ELSE 0 END) AS long, bool_or(filled) AS filled FROM ({CONTOURS_SQL}) c GROUP BY file_id, x, y, w, h),
n AS (SELECT file_id, string_agg(DISTINCT colorant, ', ' ORDER BY colorant) AS colorant FROM ({CONTOURS_SQL}) c GROUP BY file_id)
SELECT file_id, any_value(colorant) AS colorant, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, sum(long)::DOUBLE AS length_mm, count(*) AS contours, bool_and(closed) AS closed, bool_or(filled) AS filled FROM c JOIN n USING (file_id) GROUP BY file_id"""


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rectangles a picture, one within the other."""
    left = 1 + F.col("vec_id") % 3 * 0.5
    rings = [[(left + k, 1.0 + k), (6.5 - k, 1.0 + k), (6.5 - k, 6.0 - k), (left + k, 6.0 - k)] for k in range(2)]
    both = F.array(*[F.array(*[geometry.point(x if not isinstance(x, float) else F.lit(x), F.lit(y)) for x, y in corners]) for corners in rings])
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(both).alias("ring"))


_SAMPLES = f"""
WITH {_PX}, c AS (SELECT id, r, 1 + id % 3 * 0.5::DOUBLE + r AS l, 6.5 - r AS m, 1.0 + r AS t, 6.0 - r AS b FROM (SELECT DISTINCT id FROM px) i, (VALUES (0), (1)) v(r)),
e AS (SELECT id, r, i, CASE WHEN i IN (0, 3) THEN l ELSE m END AS ax, CASE WHEN i < 2 THEN t ELSE b END AS ay, CASE WHEN i IN (3, 2) THEN l ELSE m END AS bx, CASE WHEN i IN (0, 3) THEN t ELSE b END AS by_, CASE WHEN i IN (0, 1) THEN l ELSE m END AS cx, CASE WHEN i IN (1, 2) THEN t ELSE b END AS cy FROM c, (VALUES (0), (1), (2), (3)) v(i)),
s AS (SELECT id, r, i * 10 AS nth, ax AS x, ay AS y, bx - cx AS dx, by_ - cy AS dy FROM e UNION ALL SELECT id, r, i * 10 + 1, ax + (bx - ax) * 4 / (abs(bx - ax) + abs(by_ - ay)), ay + (by_ - ay) * 4 / (abs(bx - ax) + abs(by_ - ay)), bx - ax, by_ - ay FROM e WHERE abs(bx - ax) + abs(by_ - ay) > 4),
n AS (SELECT id, r, nth, x, y, dy / sqrt(dx * dx + dy * dy) AS nx, -dx / sqrt(dx * dx + dy * dy) AS ny FROM s)"""


def bare_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a contour on each picture has paper a bleed's width outside it."""
    return die.bare_perimeter(_rings(spark, sf_dir), _pixels(spark, sf_dir), 1.0, 1.0)


BARE = f"""{_SAMPLES},
p AS (SELECT id, round_even(x + nx * 2, 0)::INTEGER AS px_, round_even(y + ny * 2, 0)::INTEGER AS py_ FROM n),
q AS (SELECT id, CASE WHEN px_ = 8 THEN 7 ELSE px_ END AS x, CASE WHEN py_ = 8 THEN 7 ELSE py_ END AS y FROM p)
SELECT c.id, round(avg((g >= 250)::INTEGER), 3) AS bare FROM c LEFT JOIN q ON q.id = c.id LEFT JOIN px ON px.id = q.id AND px.x = q.x AND px.y = q.y GROUP BY c.id"""


def bleed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a line on each picture has artwork that stops short of it, and by how much."""
    return die.bleed_shortfall(_rings(spark, sf_dir), _pixels(spark, sf_dir), 1.0, 4.0)


GAPS = f"""{_SAMPLES},
w AS (SELECT n.id, r, nth, k, round_even(x - nx * (2 + k), 0)::INTEGER AS x, round_even(y - ny * (2 + k), 0)::INTEGER AS y FROM n, (VALUES (0), (1), (2)) v(k)),
h AS (SELECT w.id, w.r, nth, min(k) AS nearest, min(k) FILTER (WHERE g < 250) AS inked FROM w JOIN px ON px.id = w.id AND px.x = w.x AND px.y = w.y GROUP BY w.id, w.r, nth)
SELECT id, round(avg(coalesce(inked > 0, false)::INTEGER), 3) AS share, coalesce(round(median(inked + 2) FILTER (WHERE inked > 0), 2), 0)::DOUBLE AS missing_mm FROM h WHERE nearest = 0 GROUP BY id"""


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's numbers, two by two, as a ring of points."""
    e = read(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    last = F.greatest(F.floor(F.size("embedding") / 2).cast("int") - 1, F.lit(0))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(v, i * 2).alias("x"), F.get(v, i * 2 + 1).alias("y"))).alias("ring"))


def _around(ring):
    at = lambda p: F.atan2(p["y"], p["x"])
    return F.transform(F.array_sort(F.transform(ring, lambda p: F.struct(at(p).alias("a"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def ring_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings by angle around the origin: offsets, clips, resampling. SQL can't follow them."""
    # vectors come in few files; rings are dealt out to all tasks, and what is made of one is made once
    t = points_of(spark, sf_dir).repartition("vec_id").select("vec_id", F.explode(F.array(_around("ring"))).alias("ring"))
    made = F.struct(polygons.offset(F.col("ring"), -0.01).alias("moved"), polygons.resampled(F.col("ring"), 32).alias("even"))
    t = t.select("vec_id", "ring", F.explode(F.array(made)).alias("made"))
    moved, even = F.col("made.moved"), F.col("made.even")
    first, second = F.get(even, F.lit(0)), F.get(even, F.lit(1))
    return t.select(
        F.col("vec_id").alias("id"), F.round(geometry.let(moved, lambda m: geometry.signed_area(m["ring"])), 9).alias("offset_area"), moved["problem"].alias("problem"),
        F.round(F.abs(geometry.signed_area(polygons.clip(F.col("ring"), -0.1, -0.1, 0.1, 0.1))), 9).alias("clipped_area"), F.round(F.hypot(second["x"] - first["x"], second["y"] - first["y"]), 9).alias("spacing"),
    )


def inscribed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the largest box within each ring. SQL can't follow it."""
    t = points_of(spark, sf_dir).select(F.col("vec_id").alias("id"), _around("ring").alias("ring"))
    return polygons.inscribed_boxes(t, 16).select("id", *[F.round(c, 9).alias(c) for c in ("x", "y", "w", "h")])


def clipped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, from lines' numbers, clipped to a page, and seen from behind."""
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_partkey") % 90 - 20).cast("double").alias("x"), (F.col("l_suppkey") % 80 - 10).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = F.array(*[geometry.point(a, b) for a, b in ((x, y), (x + w, y), (x + w, y + w * 2), (x, y + w * 2))])
    cut = geometry.mirrored(polygons.clip(ring, 0.0, 0.0, 50.0, 60.0), F.lit(50.0), F.lit(60.0), F.col("l_partkey") % 2 == 0)
    # an explode of one: what is cut is cut once, however often it is named
    own = t.select("l_orderkey", "l_partkey", "l_suppkey", F.explode(F.array(cut)).alias("cut"))
    own = own.select("l_orderkey", "l_partkey", "l_suppkey", "cut", F.explode(F.array(F.abs(geometry.signed_area(F.col("cut"))))).alias("size"))
    return own.select("l_orderkey", "l_partkey", "l_suppkey", F.round("size", 6).alias("area"), F.when(F.col("size") > 1e-9, F.round(F.array_min(F.transform("cut", lambda p: p["x"])), 6) + 0.0).alias("x0"))


CLIPPED_RINGS = """
WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, greatest(0, l_partkey % 90 - 20)::DOUBLE AS x0, greatest(0, l_suppkey % 80 - 10)::DOUBLE AS y0, least(50, l_partkey % 90 - 20 + l_quantity)::DOUBLE AS x1, least(60, l_suppkey % 80 - 10 + 2 * l_quantity)::DOUBLE AS y1, FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN x1 > x0 AND y1 > y0 THEN round((x1 - x0) * (y1 - y0), 6) ELSE 0.0 END AS area, CASE WHEN x1 > x0 AND y1 > y0 THEN CASE WHEN l_partkey % 2 = 0 THEN 50 - x1 ELSE x0 END END AS x0 FROM b"""


def flat_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into how many points the curves through each embedding's points are flattened."""
    t = points_of(spark, sf_dir).select("vec_id", F.transform("ring", lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y"))).alias("ring"))
    each = t.select("vec_id", "ring", F.explode(F.sequence(F.lit(0), F.floor(F.size("ring") / 4).cast("int") - 1)).alias("k"))
    at = lambda i: F.get("ring", F.col("k") * 4 + i)
    flat = geometry.flattened(at(0), at(1), at(2), at(3))
    return each.select("vec_id", F.col("k").cast("long").alias("k"), F.size(flat).cast("long").alias("points"), F.size(geometry.die_points(at(0), at(1), at(2), at(3))).cast("long").alias("die_points"))


FLAT = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 100) AS v, unnest(range(8)) AS k FROM embeddings),
s AS (SELECT vec_id, k, sqrt((v[8*k+3]-v[8*k+1])**2+(v[8*k+4]-v[8*k+2])**2) + sqrt((v[8*k+5]-v[8*k+3])**2+(v[8*k+6]-v[8*k+4])**2) + sqrt((v[8*k+7]-v[8*k+5])**2+(v[8*k+8]-v[8*k+6])**2) AS long FROM d)
SELECT vec_id, k, greatest(2, least(512, floor(sqrt(long / 0.05) + 1)))::BIGINT AS points, 12::BIGINT AS die_points FROM s"""


def island_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each island's vertices; triangles are lines, an island is a line number of an order."""
    rows = read(spark, sf_dir, "lineitem")
    n = rows.count()
    l = mesh.dealt(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), n, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("pk"), F.max("l_suppkey").alias("sk"))
    triangles = staged(l.select(F.col("l_orderkey").alias("mesh"), F.col("l_linenumber").cast("long").alias("t"), (F.col("pk") % 40).alias("v0"), (40 + F.col("sk") % 40).alias("v1"), (80 + F.col("l_linenumber")).cast("long").alias("v2")), "island-triangles")
    numbered = triangles.select("mesh", "t", (F.col("t") % 2).cast("int").alias("island"))
    vertices = mesh.dealt(triangles.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("v")), 3 * n, "mesh", "v").distinct().select("mesh", "v", (F.col("v") * 7 % 100).cast("double").alias("u_mm"), (F.col("v") * 3 % 50).cast("double").alias("v_mm"))
    vertices = staged(vertices, "island-vertices")
    return mesh.island_boxes(numbered, triangles, vertices)


ISLANDS = """
WITH l AS (SELECT l_orderkey AS mesh, l_linenumber AS t, max(l_partkey) % 40 AS v0, 40 + max(l_suppkey) % 40 AS v1, 80 + l_linenumber AS v2 FROM lineitem GROUP BY l_orderkey, l_linenumber),
v AS (SELECT mesh, t % 2 AS island, unnest([v0, v1, v2]) AS v FROM l)
SELECT mesh, island::INTEGER AS island, min(v * 7 % 100)::DOUBLE AS u0, min(v * 3 % 50)::DOUBLE AS v0, max(v * 7 % 100)::DOUBLE AS u1, max(v * 3 % 50)::DOUBLE AS v1 FROM v GROUP BY mesh, island"""


def mapped_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices through their islands' maps; islands without a map have none."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5).alias("island"), (F.col("l_partkey") % 70).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    maps = spark.range(4).select(F.col("id").alias("island"), *[(F.col("id") * k + 1).cast("double").alias(n) for k, n in enumerate(("au", "bu", "cu", "av", "bv", "cv"))])
    return mesh.applied(l, maps, ["island"]).select("l_orderkey", "l_partkey", "l_suppkey", "u", "v")


MAPPED = "SELECT l_orderkey, l_partkey, l_suppkey, (l_partkey % 70 + (i + 1) * l_quantity + 2 * i + 1)::DOUBLE AS u, ((3 * i + 1) * (l_partkey % 70) + (4 * i + 1) * l_quantity + 5 * i + 1)::DOUBLE AS v FROM (SELECT *, l_partkey % 5 AS i FROM lineitem) l WHERE i < 4"


def regrouped_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as triangles, the mapped ones first."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mesh"), F.col("l_linenumber").cast("long").alias("t")).agg(F.max("l_partkey").alias("pk"))
    return mesh.regrouped(l, F.col("pk") % 3 == 0).select("mesh", "t", F.col("place").cast("long").alias("place"))


REGROUPED = "SELECT mesh, t, row_number() OVER (PARTITION BY mesh ORDER BY (pk % 3 = 0) DESC, t) AS place FROM (SELECT l_orderkey AS mesh, l_linenumber::BIGINT AS t, max(l_partkey) AS pk FROM lineitem GROUP BY ALL) l"


def flat_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines' points lie on a line."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("x"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") * 2.0 + 1).otherwise((F.col("l_partkey") % 97).cast("double")).alias("y"))
    return mesh.collinear(l, "l_orderkey")


PANELS = """
WITH p AS (SELECT l_orderkey, l_linenumber::DOUBLE AS x, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber * 2 + 1 ELSE l_partkey % 97 END::DOUBLE AS y FROM lineitem),
v AS (SELECT l_orderkey, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY l_orderkey)
SELECT l_orderkey, xx * yy - xy * xy <= 1e-9 * greatest(xx * yy, 1e-9) AS collinear FROM v"""


def page_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each line's box is laid on a page's: turned or not, how well it fits, and where its corner goes."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_partkey") % 30).cast("double").alias("w"), F.col("l_quantity").cast("double").alias("h"))
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    fit = geometry.fit_orientation(box(F.lit(2.0), F.lit(3.0), F.col("w") + 2, F.col("h") + 3), box(F.lit(0.1), F.lit(0.2), F.lit(0.7), F.lit(0.5)))
    at = lambda k, x, y: F.round(fit[f"a{k}"] * x + fit[f"b{k}"] * y + fit[f"c{k}"], 6)
    return l.select("l_orderkey", "l_partkey", "l_suppkey", fit["turn"].alias("turn"), F.round(fit["error"], 6).alias("error"), at("u", F.lit(2.0), F.lit(3.0)).alias("u"), at("v", F.lit(2.0), F.lit(3.0)).alias("v"))


FITS = """
WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_partkey % 30)::DOUBLE AS w, l_quantity::DOUBLE AS h FROM lineitem),
e AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN abs(ln((w / h) / 2)) END AS up, CASE WHEN w > 0 AND h > 0 THEN abs(ln((h / w) / 2)) END AS turned FROM b),
f AS (SELECT *, CASE WHEN up IS NOT NULL THEN (turned < up - 1e-9)::INTEGER END AS turn FROM e)
SELECT l_orderkey, l_partkey, l_suppkey, turn, round(least(up, turned), 6) AS error, CASE turn WHEN 1 THEN 0.7 WHEN 0 THEN 0.1 END::DOUBLE AS u, CASE WHEN turn IS NOT NULL THEN 0.2 END::DOUBLE AS v FROM f"""


def box_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of its boxes each order's lines are laid on. A greedy choice that SQL can't follow."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mesh"), F.col("l_linenumber").cast("int").alias("island")).agg(F.max("l_partkey").alias("pk"), F.max("l_quantity").alias("q"))
    islands = l.select("mesh", "island", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("pk") % 30).cast("double").alias("x1"), F.col("q").cast("double").alias("y1"))
    boxes = l.filter("island <= 3").select("mesh", F.col("island").alias("box"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("island") * 0.2).alias("x1"), F.lit(0.3).alias("y1"))
    return mesh.assigned(islands, boxes).withColumn("error", F.round("error", 9))


#: What pages declare: a line is a resource of its order's file.
RESOURCES_SQL = """
SELECT l_orderkey AS file_id, l_partkey AS pk, CASE l_partkey % 6 WHEN 0 THEN 'Separation' WHEN 1 THEN 'DeviceN' WHEN 2 THEN 'ICCBased' WHEN 3 THEN 'Indexed' WHEN 4 THEN 'DeviceCMYK' ELSE 'ICCBased' END AS family,
    CASE WHEN l_partkey % 12 = 11 THEN 2 ELSE 3 + l_suppkey % 2 END AS components, concat('PANTONE#20', CAST(l_suppkey % 9 AS VARCHAR(9)), '#20C') AS spot, l_returnflag AS font, l_tax > 0.07 AS overprint, l_linestatus = 'F' AS shows
FROM lineitem
"""


def declared_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all of a file's pages declare together."""
    t = derived.from_sql(spark, sf_dir, RESOURCES_SQL)
    kind = "struct<family:string,components:int,colorants:array<string>>"
    base = F.when(F.col("family") == "Indexed", F.struct(F.lit("ICCBased").alias("family"), F.col("components").cast("int").alias("components"), F.lit(None).cast("array<string>").alias("colorants"))).cast(kind)
    space = F.struct(F.col("family"), F.col("components").cast("int").alias("components"), F.when(F.col("family") == "Separation", F.array("spot")).when(F.col("family") == "DeviceN", F.array(F.lit("None"), F.col("spot"), F.lit("Cyan#"))).alias("colorants"), base.alias("base"))
    out = placements.declared(t.select("file_id", "font", space.alias("space"), "overprint", F.col("shows").alias("shows_text")))
    return out.select("file_id", *[F.array_join(c, "|").alias(c) for c in ("fonts", "colour_spaces", "spot_names")], "overprint", "shows_text")


RESOURCES = f"""
WITH r AS (SELECT *, replace(spot, '#20', ' ') AS name, CASE components WHEN 3 THEN 'ICCBased(RGB)' WHEN 4 THEN 'ICCBased(CMYK)' ELSE 'ICCBased' END AS icc FROM ({RESOURCES_SQL}) r),
s AS (SELECT file_id, font, overprint, shows, CASE WHEN family IN ('ICCBased', 'Indexed') THEN icc WHEN family = 'DeviceCMYK' THEN family END AS mode, unnest(CASE family WHEN 'Separation' THEN [name] WHEN 'DeviceN' THEN [name, 'Cyan#'] ELSE [NULL] END) AS spot FROM r)
SELECT file_id, string_agg(DISTINCT font, '|' ORDER BY font) AS fonts, coalesce(string_agg(DISTINCT mode, '|' ORDER BY mode), '') AS colour_spaces, coalesce(string_agg(DISTINCT spot, '|' ORDER BY spot), '') AS spot_names, bool_or(overprint) AS overprint, bool_or(shows) AS shows_text FROM s GROUP BY file_id"""


def placed_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least resolution of each file's pictures that count, on the page and in full size, and how many count."""
    c = F.col
    l = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("file_id"), (c("l_partkey") % 900).cast("double").alias("pw"), (c("l_suppkey") % 70 * 10).cast("double").alias("ph"), c("l_quantity").cast("double").alias("q"), "l_linenumber")
    turned = c("l_linenumber") % 2 == 0
    ctm = F.struct(*[x.cast("double").alias(n) for n, x in (("a", F.when(turned, 0.0).otherwise(c("q") * 3)), ("b", F.when(turned, c("q") * 2).otherwise(0.0)), ("c", F.when(turned, -c("q")).otherwise(0.0)), ("d", F.when(turned, 0.0).otherwise(c("q") * 4)), ("e", c("q")), ("f", F.lit(5.0)))])
    placed = l.select("file_id", placements.described(c("pw"), c("ph"), ctm, F.lit(200_000.0)).alias("p")).filter("p is not null").select("file_id", "p.*")
    some = placements.significant(placed).groupBy("file_id").agg(F.count(F.lit(1)).alias("counted"), F.max("placed_w").alias("widest"), F.min("x0").alias("leftmost"))
    return placements.least_dpi(placed).join(some, "file_id").withColumn("full_dpi", placements.full_size_dpi(c("min_dpi"), F.when(c("file_id") % 3 == 0, 10).otherwise(c("file_id") % 2)))


PICTURES = """
WITH p AS (SELECT l_orderkey AS file_id, (l_partkey % 900)::DOUBLE AS pw, (l_suppkey % 70 * 10)::DOUBLE AS ph, l_quantity::DOUBLE AS q, l_linenumber % 2 = 0 AS turned FROM lineitem),
d AS (SELECT *, CASE WHEN turned THEN 2 * q ELSE 3 * q END AS w, CASE WHEN turned THEN q ELSE 4 * q END AS h FROM p WHERE pw > 0 AND ph > 0 AND q > 0),
e AS (SELECT *, round_even(least(pw / (w / 72), ph / (h / 72)), 0) AS dpi, w * h / 200000 >= 0.01 AS large, bool_or(w * h / 200000 >= 0.01) OVER (PARTITION BY file_id) AS any_large FROM d),
m AS (SELECT file_id, min(dpi) AS min_dpi, count(*) AS counted, max(round_even(w * 25.4::DOUBLE / 72, 1)) AS widest, min(CASE WHEN turned THEN 0 ELSE q END)::DOUBLE AS leftmost FROM e WHERE large OR NOT any_large GROUP BY file_id)
SELECT *, CASE WHEN file_id % 3 = 0 THEN round_even(min_dpi / 10, 1) ELSE min_dpi END AS full_dpi FROM m"""

QUERIES = {
    "raster_measures": (raster_measures, RASTER), "intrusions": (intrusions, None), "free_rectangles": (free_rectangles, FREE), "cleared_cells": (cleared_cells, CLEARED), "die_contours": (die_contours, CONTOURS), "bare_edges": (bare_edges, BARE), "bleed_gaps": (bleed_gaps, GAPS),
    "ring_shapes": (ring_shapes, None), "inscribed_boxes": (inscribed_boxes, None), "clipped_rings": (clipped_rings, CLIPPED_RINGS), "flat_curves": (flat_curves, FLAT), "island_extents": (island_extents, ISLANDS), "mapped_vertices": (mapped_vertices, MAPPED), "regrouped_triangles": (regrouped_triangles, REGROUPED),
    "flat_panels": (flat_panels, PANELS), "page_fits": (page_fits, FITS), "box_assignments": (box_assignments, None), "declared_resources": (declared_resources, RESOURCES), "placed_pictures": (placed_pictures, PICTURES),
}
