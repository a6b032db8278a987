"""Queries of shapes laid over each other, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point
from ..operators import masks, overlay
from ..staging import staged
from . import derived
from .drawing import _PX, _pixels

#: An order is a sheet with a window (shape a) and a plate laid over it (shape b), in millimetres; some plates share the sheet's edges.
SHEETS_SQL = """
SELECT o_orderkey AS id, CAST(o_custkey % 40 AS DOUBLE) AS x, CAST(o_custkey % 25 AS DOUBLE) AS y, CAST(40 + o_orderkey % 30 AS DOUBLE) AS w, CAST(30 + o_orderkey % 20 AS DOUBLE) AS h,
    CAST(5 + o_custkey % 7 AS DOUBLE) AS rim, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 40 AS DOUBLE) ELSE CAST(o_orderkey % 70 AS DOUBLE) + 0.5 END AS bx, CAST(o_orderkey % 37 AS DOUBLE) AS by_, CAST(10 + o_custkey % 33 AS DOUBLE) AS bw, CAST(15 + o_custkey % 21 AS DOUBLE) AS bh
FROM orders
"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.from_sql(spark, sf_dir, SHEETS_SQL)
    x, y, w, h, r, bx, by, bw, bh = (F.col(c) for c in ("x", "y", "w", "h", "rim", "bx", "by_", "bw", "bh"))
    box = lambda side, x0, y0, x1, y1: F.struct(F.lit(side).alias("side"), F.array(*[point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]).alias("ring"))
    return t.select("id", F.explode(F.array(box("a", x, y, x + w, y + h), box("a", x + r, y + r, x + w - r, y + h - r), box("b", bx, by, bx + bw, by + bh))).alias("s")).select("id", "s.*")


def overlaid_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sheet and its plate cover together, both, and one without the other."""
    border = overlay.overlaid(_shapes(spark, sf_dir), 0.001)
    found = overlay.areas(border).select("id", "operation", F.round("area", 3).alias("area"))
    return found


OVERLAID = f"""
WITH s AS ({SHEETS_SQL}),
m AS (SELECT *, greatest(0, least(x + w, bx + bw) - greatest(x, bx)) * greatest(0, least(y + h, by_ + bh) - greatest(y, by_)) - greatest(0, least(x + w - rim, bx + bw) - greatest(x + rim, bx)) * greatest(0, least(y + h - rim, by_ + bh) - greatest(y + rim, by_)) AS c,
    w * h - (w - 2 * rim) * (h - 2 * rim) AS a, bw * bh AS b FROM s),
u AS (SELECT id, 'union' AS operation, a + b - c AS area FROM m UNION ALL SELECT id, 'intersection', c FROM m UNION ALL SELECT id, 'difference', a - c FROM m UNION ALL SELECT id, 'either', a + b - 2 * c FROM m)
SELECT id, operation, round(area, 3)::DOUBLE AS area FROM u WHERE area > 1e-9"""

#: Outlines of each picture in pixels, eight by eight of five millimetres: a bleed that narrows downwards, a safe one within it.
def _outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = staged(_pixels(spark, sf_dir).select("id").distinct(), "outline-pictures")
    left = F.col("id") % 2
    ring = lambda *ps: F.array(*[point(F.lit(x) * 5.0 if not hasattr(x, "cast") else x * 5.0, F.lit(y) * 5.0) for x, y in ps])
    bleed = ids.select("id", ring((left, 0.0), (7.0, 0.0), (6.0, 8.0), (left, 8.0)).alias("ring"))
    safe = ids.select("id", ring((3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0)).alias("ring"))
    return bleed, safe, ids.select("id", F.lit(8).alias("width"), F.lit(8).alias("height"))


def shaped_intrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each picture's dark pixels reach into the margin between two outlines."""
    bleed, safe, sizes = _outlines(spark, sf_dir)
    dark = _pixels(spark, sf_dir).filter("g < 180").select("id", "x", "y")
    return masks.shaped_intrusions(dark, sizes, bleed, safe, 0.2, 2.0, 15.0)[1]


SHAPED = f"""
WITH {_PX}, inside AS (SELECT id, x, y, x >= id % 2 AND x <= 7 - y / 8.0 AS bleed, x BETWEEN 3 AND 5 AND y BETWEEN 3 AND 4 AS safe, g < 180 AS dark FROM px),
kept AS (SELECT * FROM inside p WHERE dark AND NOT safe AND bleed AND NOT EXISTS (SELECT 1 FROM inside q WHERE q.id = p.id AND NOT q.bleed AND abs(q.x - p.x) + abs(q.y - p.y) <= 1)),
tiles AS (SELECT id, max(n) AS n FROM (SELECT id, count(*) AS n FROM kept GROUP BY id, x // 2, y // 2) t GROUP BY id),
far AS (SELECT k.id, k.x, k.y, least(4, min(abs(s.x - k.x) + abs(s.y - k.y))) AS steps FROM kept k JOIN inside s ON s.id = k.id AND s.safe GROUP BY k.id, k.x, k.y)
SELECT i.id, coalesce(round(max(steps) FILTER (WHERE n / 4.0 >= 0.06) / 0.2::DOUBLE, 2), 0) AS intrusion_mm FROM (SELECT DISTINCT id FROM px) i LEFT JOIN far ON far.id = i.id LEFT JOIN tiles ON tiles.id = i.id GROUP BY i.id"""

def located_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each picture's ink lies best under a rectangle."""
    px = _pixels(spark, sf_dir)
    ring = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((2.0, 2.0), (5.0, 2.0), (5.0, 6.0), (2.0, 6.0))])
    return masks.located_offset(px, px.select("id").distinct().withColumn("ring", ring), 1.0, 3.0)


LOCATED = f"""
WITH {_PX}, d AS (SELECT unnest(range(-3, 4)) AS k), m AS (SELECT a.k AS x, b.k AS y FROM (SELECT unnest(range(2, 6)) AS k) a, (SELECT unnest(range(2, 6)) AS k) b),
s AS (SELECT px.id, dx.k AS dx, dy.k AS dy, sum(CASE WHEN px.g < 250 THEN 1 ELSE -1 END) AS score FROM d dx, d dy, m JOIN px ON px.x = m.x + dx.k AND px.y = m.y + dy.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, (dy + 7) % 7, (dx + 7) % 7) AS n, max(score) FILTER (WHERE dx = 0 AND dy = 0) OVER (PARTITION BY id) AS here FROM s)
SELECT id, CASE WHEN score > here + 0.5 THEN dx ELSE 0 END::DOUBLE AS dx_mm, CASE WHEN score > here + 0.5 THEN dy ELSE 0 END::DOUBLE AS dy_mm FROM r WHERE n = 1"""

QUERIES = {"located_offsets": (located_offsets, LOCATED), "shaped_intrusions": (shaped_intrusions, SHAPED), "overlaid_sheets": (overlaid_sheets, OVERLAID)}
