"""Dies: their contours rolled up, and what lies a bleed's width outside or inside of them.

Samples along a contour are rows; they meet the pixels they fall on by a join, so shares and gaps are
aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import raster

#: Pixels between samples along a side, pixels of the least step off a line, millimetres that may be between a closed contour's ends.
SPACING_PX, STEP_PX, CLOSED_MM = 4, 2, 0.1


def rolled_up(contours: DataFrame, key: str = "file_id") -> DataFrame:
    """key, colorant, x0, y0, x1, y1, length_mm, contours, closed, filled: a file's die from its contours.

    contours: key, ring (points), closed, filled, colorant. A contour drawn twice, to a tenth, is one; one that
    ends where it begins is closed; length is along the points, and back to the first where it was closed.
    """
    ring = F.col("ring")
    ends = F.hypot(F.get(ring, F.lit(0))["x"] - F.element_at(ring, -1)["x"], F.get(ring, F.lit(0))["y"] - F.element_at(ring, -1)["y"])
    along = geometry.perimeter(ring) - F.when(F.col("closed"), 0.0).otherwise(ends)
    tenth = F.transform(ring, lambda p: F.struct(F.bround(p["x"], 1).alias("x"), F.bround(p["y"], 1).alias("y")))
    box = geometry.box(ring)
    each = contours.filter(F.size(ring) > 1).select(key, tenth.alias("shape"), (F.col("closed") | (ends <= CLOSED_MM)).alias("closed"), along.alias("along"), "filled", "colorant", box.alias("box"))
    once = each.groupBy(key, "shape").agg(F.bool_or("closed").alias("closed"), F.max("along").alias("along"), F.bool_or("filled").alias("filled"), F.collect_set("colorant").alias("colorants"), F.first("box").alias("box"))
    edge = lambda agg, k: F.bround(agg(f"box.{k}"), 2).alias(k)
    return once.groupBy(key).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("colorants")))), ", ").alias("colorant"), edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1"),
        F.bround(F.sum("along"), 1).alias("length_mm"), F.count(F.lit(1)).alias("contours"), F.bool_and("closed").alias("closed"), F.bool_or("filled").alias("filled"),
    )


def samples(rings: DataFrame, spacing_mm: float, outward: bool = True) -> DataFrame:
    """id, ring_no, nth, x, y, nx, ny: points along each closed ring (y downwards) and unit normals out of it, or into it.

    At every corner the normal is that of its two neighbours' chord; along a side there is a sample every
    spacing_mm, short of its end, that looks straight out. Rings of fewer than three points have none. An id's
    rings are numbered from 1, so that samples of different rings don't mix.
    """

    def of(ring: Column) -> Column:
        n = F.size(ring)
        at = lambda i: F.get(ring, (i + n) % n)
        sign = F.when((geometry.signed_area(ring) > 0) == F.lit(outward), -1.0).otherwise(1.0)

        def sample(x: Column, y: Column, dx: Column, dy: Column) -> Column:
            size = F.hypot(dx, dy)
            return F.when(size >= 1e-9, F.struct(x.alias("x"), y.alias("y"), (-dy / size * sign).alias("nx"), (dx / size * sign).alias("ny")))

        def side(i: Column) -> Column:
            a, b, before = at(i), at(i + 1), at(i - 1)
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            size = F.hypot(dx, dy)
            steps = F.greatest(F.ceil((size - 1e-9) / spacing_mm).cast("int") - 1, F.lit(0))
            between = F.transform(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), lambda k: sample(a["x"] + dx * (k * spacing_mm / size), a["y"] + dy * (k * spacing_mm / size), dx, dy))
            return F.concat(F.array(sample(a["x"], a["y"], b["x"] - before["x"], b["y"] - before["y"])), between)

        return F.when(n >= 3, F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), side)), lambda s: s.isNotNull()))

    ring = F.col("ring")
    opened = F.when((F.size(ring) > 2) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)
    order = Window.partitionBy("id").orderBy(F.col("ring").cast("string"))
    numbered = rings.select("id", "ring", F.row_number().over(order).alias("ring_no")).withColumn("ring", opened)
    return numbered.select("id", "ring_no", F.posexplode(of(F.col("ring"))).alias("nth", "s")).select("id", "ring_no", "nth", "s.*")


def _pixel(position: Column, extent: str) -> Column:
    """The pixel a position falls in; on the far edge that is the last one. Null off the sheet."""
    at = F.rint(position).cast("long")
    at = F.when(at == F.col(extent), at - 1).otherwise(at)
    return F.when((at >= 0) & (at < F.col(extent)), at)


def bare_perimeter(rings: DataFrame, px: DataFrame, per_mm: float, bleed_mm: float) -> DataFrame:
    """id, bare: the share of samples, a bleed's width outside the ring, with paper under them; null where all fall off the sheet."""
    step = max(bleed_mm, STEP_PX / per_mm)
    size = raster.sizes(px)
    points = samples(rings, SPACING_PX / per_mm).join(size, "id")
    points = points.select("id", _pixel((F.col("x") + F.col("nx") * step) * per_mm, "width").alias("x"), _pixel((F.col("y") + F.col("ny") * step) * per_mm, "height").alias("y")).filter("x is not null and y is not null")
    hit = points.join(px.select("id", "x", "y", raster.ink().alias("ink")), ["id", "x", "y"])
    share = hit.groupBy("id").agg(F.bround(F.avg((~F.col("ink")).cast("int")), 3).alias("bare"))
    return size.select("id").join(share, "id", "left")


def bleed_shortfall(rings: DataFrame, px: DataFrame, per_mm: float, reach_mm: float) -> DataFrame:
    """id, share, missing_mm: how much of the line has artwork that stops short of it, and the median gap there.

    From each sample the way goes inwards. Ink at its first step is a bleed, paper all the way a white
    background; ink that begins in between is artwork that stops short.
    """
    first = STEP_PX / per_mm
    steps = max(0, int((max(reach_mm, first) + 1e-9 - first) * per_mm))
    points = samples(rings, SPACING_PX / per_mm, outward=False).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    depth = F.lit(first) + F.col("k") / per_mm
    at = lambda a, n: F.rint((F.col(a) + F.col(n) * depth) * per_mm).cast("long")
    points = points.select("id", "ring_no", "nth", "k", depth.alias("depth"), at("x", "nx").alias("px"), at("y", "ny").alias("py"))
    hit = points.join(px.select("id", F.col("x").alias("px"), F.col("y").alias("py"), raster.ink().alias("ink")), ["id", "px", "py"])
    per = hit.groupBy("id", "ring_no", "nth").agg(F.min("k").alias("nearest"), F.min(F.when(F.col("ink"), F.col("k"))).alias("inked"), F.min(F.when(F.col("ink"), F.col("depth"))).alias("gap")).filter("nearest = 0")
    short = F.col("inked") > 0
    return per.groupBy("id").agg(F.bround(F.avg(F.coalesce(short, F.lit(False)).cast("int")), 3).alias("share"), F.coalesce(F.bround(F.median(F.when(short, F.col("gap"))), 2), F.lit(0.0)).alias("missing_mm"))
