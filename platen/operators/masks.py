"""Shapes on a page's pixels: filled, grown and shrunk as runs of a row, never as pixels.

A mask is rows (id, y, x0, x1): pixels x0 to x1 of a row, both included, runs of a row not touching. Growing by n steps to
the four sides reaches what is n away or less, counted along the sides; that is the same run, wider by what is left, on
each row near enough, so growth needs no steps, and shrinking is the growth of what is outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import raster

#: Fixed value: how deep the product's own edge may look like detail, in millimetres inside its bleed outline.
SILHOUETTE_MM = 3.0
#: Fixed value: millimetres of a cell in which drawn paths are looked for.
INK_CELL_MM = 4.0


def merged(runs: DataFrame) -> DataFrame:
    """id, y, x0, x1 of all runs together, those that overlap or touch as one."""
    row = Window.partitionBy("id", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("x0") > reach + 1).cast("int"), F.lit(1))
    return runs.withColumn("apart", apart).withColumn("run", F.sum("apart").over(row)).groupBy("id", "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select("id", "y", "x0", "x1")


def filled(rings: DataFrame, sizes: DataFrame, per_mm: float) -> DataFrame:
    """The mask of rings (id, ring: points in millimetres) on pages (id, width, height in pixels), each ring filled by itself.

    A pixel is where its whole numbers say. On a row, the edges that cross it (from their upper end on, short of
    their lower one) are paired from left to right, and what lies between a pair is inside, its ends included.
    """
    c = F.col
    scaled = F.transform("ring", lambda p: F.struct((p["x"] * per_mm).alias("x"), (p["y"] * per_mm).alias("y")))
    numbered = rings.select("id", F.monotonically_increasing_id().alias("ring_no"), scaled.alias("ps"))
    sides = F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.get("ps", F.pmod(i + 1, F.size("ps"))).alias("q")))
    edges = numbered.select("id", "ring_no", F.explode(sides).alias("e")).withColumns({"up": F.when(c("e.p.y") <= c("e.q.y"), c("e.p")).otherwise(c("e.q")), "down": F.when(c("e.p.y") <= c("e.q.y"), c("e.q")).otherwise(c("e.p"))})
    edges = edges.join(sizes.select("id", "width", "height"), "id")
    first, last = F.greatest(F.ceil(c("up.y")), F.lit(0)).cast("int"), F.least(F.ceil(c("down.y")) - 1, c("height") - 1).cast("int")
    crossed = edges.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("y", F.explode(F.sequence("first", "last")))
    at = c("up.x") + (c("y") - c("up.y")) / (c("down.y") - c("up.y")) * (c("down.x") - c("up.x"))
    row = Window.partitionBy("id", "ring_no", "y").orderBy("at")
    paired = crossed.withColumn("at", at).withColumns({"nth": F.row_number().over(row), "to": F.lead("at").over(row)}).filter("nth % 2 = 1 AND to IS NOT NULL")
    runs = paired.select("id", "y", F.greatest(F.ceil(c("at") - 1e-9), F.lit(0)).cast("int").alias("x0"), F.least(F.floor(c("to") + 1e-9), c("width") - 1).cast("int").alias("x1")).filter("x0 <= x1")
    return merged(runs)


def grown(mask: DataFrame, sizes: DataFrame, steps: int) -> DataFrame:
    """The mask with all pixels of the page that lie so many steps away or less."""
    c = F.col
    near = mask.withColumn("d", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).join(sizes.select("id", "width", "height"), "id")
    left = F.lit(steps) - F.abs("d")
    runs = near.select("id", (c("y") + c("d")).alias("y"), F.greatest(c("x0") - left, F.lit(0)).cast("int").alias("x0"), F.least(c("x1") + left, c("width") - 1).cast("int").alias("x1"), "height")
    return merged(runs.filter((c("y") >= 0) & (c("y") < c("height"))).drop("height"))


def outside(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """The mask of all pixels of the pages that the mask doesn't hold."""
    c = F.col
    rows = sizes.select("id", "width", F.explode(F.sequence(F.lit(0), (c("height") - 1).cast("int"))).alias("y"))
    ends = rows.select("id", "y", F.lit(-1).alias("x0"), F.lit(-1).alias("x1")).unionByName(rows.select("id", "y", c("width").cast("int").alias("x0"), c("width").cast("int").alias("x1")))
    row = Window.partitionBy("id", "y").orderBy("x0")
    gaps = mask.select("id", "y", "x0", "x1").unionByName(ends).withColumn("next", F.lead("x0").over(row))
    return gaps.filter("next > x1 + 1").select("id", "y", (c("x1") + 1).alias("x0"), (c("next") - 1).alias("x1"))


def shrunk(mask: DataFrame, sizes: DataFrame, steps: int) -> DataFrame:
    """The mask without what lies so many steps or less from a pixel of the page outside it; a page's edge takes nothing."""
    return outside(grown(outside(mask, sizes), sizes, steps), sizes)


def held(px: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels (id, x, y) that the mask holds."""
    runs = mask.select("id", "y", F.col("x0").alias("run_0"), F.col("x1").alias("run_1"))
    return px.join(runs, ["id", "y"]).filter("x BETWEEN run_0 AND run_1").drop("run_0", "run_1")


def shaped_intrusions(detail: DataFrame, sizes: DataFrame, bleed: DataFrame, safe: DataFrame, per_mm: float, bleed_mm: float, safe_mm: float) -> tuple[DataFrame, DataFrame]:
    """Where detail lies in the margin between a template's own outlines, and how deep: (id, x, y, w, h in millimetres), (id, intrusion_mm).

    detail: pixels (id, x, y) that have any; sizes: id, width, height in pixels; bleed, safe: rings (id, ring in
    millimetres). The margin is inside the bleed outline, but for a band as deep as the bleed and SILHOUETTE_MM, and
    outside the safe one. The depth is how many steps the deepest detail is from the safe outline's inside, as far
    as both margins reach at most; 0 where no tile holds detail enough to count.
    """
    c = F.col
    band, limit = round((bleed_mm + SILHOUETTE_MM) * per_mm), int(-(-(bleed_mm + safe_mm) * per_mm // 1))
    inner = filled(safe, sizes, per_mm)
    ring = shrunk(filled(bleed, sizes, per_mm), sizes, band)
    within = held(detail.select("id", "x", "y"), ring).distinct()
    kept = within.join(held(within, inner), ["id", "x", "y"], "left_anti")
    side = raster.tile_side(per_mm)
    tiles = kept.groupBy(c("id").alias("page"), F.floor(c("x") / side).alias("x"), F.floor(c("y") / side).alias("y")).agg(F.count(F.lit(1)).alias("n")).join(sizes.withColumnRenamed("id", "page"), "page")
    area = (F.least((c("x") + 1) * side, c("width")) - c("x") * side) * (F.least((c("y") + 1) * side, c("height")) - c("y") * side)
    marked = tiles.filter(c("n") / area >= raster.TILE_SHARE).select("page", "x", "y")
    found = raster.regions(marked, sizes, per_mm)
    boxes = found.select("id", *[F.bround(v / per_mm, 1).alias(k) for k, v in (("x", c("x0")), ("y", c("y0")), ("w", c("x1") - c("x0")), ("h", c("y1") - c("y0")))])
    near = kept.withColumn("row", F.explode(F.sequence(c("y").cast("int") - limit, c("y").cast("int") + limit))).join(inner.select("id", c("y").alias("row"), "x0", "x1"), ["id", "row"], "left")
    away = F.abs(c("row") - c("y")) + F.greatest(c("x0") - c("x"), c("x") - c("x1"), F.lit(0))
    per = near.groupBy("id", "x", "y").agg(F.least(F.coalesce(F.min(F.when(c("x0").isNotNull(), away)), F.lit(limit)), F.lit(limit)).alias("steps")).groupBy("id").agg(F.max("steps").alias("steps"))
    some = marked.select(c("page").alias("id")).distinct()  # where a tile counts there is a region; which ones fuse doesn't matter
    deep = sizes.select("id").join(some.join(per, "id"), "id", "left")
    return boxes, deep.select("id", F.bround(F.coalesce("steps", F.lit(0)) / per_mm, 2).alias("intrusion_mm"))


def ink_cells(pieces: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """page, column, row of the page's cells of about INK_CELL_MM that straight pieces of drawn paths (page, ax, ay, bx, by in
    millimetres, y upwards) run through, rows from below; a shape's inside is free. Pieces off the page have none.
    """
    c = F.col
    columns, rows = max(1, int(page_w / INK_CELL_MM)), max(1, int(page_h / INK_CELL_MM))
    cell_w, cell_h = page_w / columns, page_h / rows
    on = pieces.select("page", geometry.clipped(c("ax"), c("ay"), c("bx"), c("by"), F.lit(page_w), F.lit(page_h)).alias("s")).filter("s IS NOT NULL")
    on = on.select("page", *[c(f"s.{k}").alias(n) for k, n in (("x0", "ax"), ("y0", "ay"), ("x1", "bx"), ("y1", "by"))])
    steps = F.greatest(F.floor(F.greatest(F.abs(c("bx") - c("ax")) / cell_w, F.abs(c("by") - c("ay")) / cell_h) * 2), F.lit(1)).cast("int")
    every = on.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), c("steps"))))
    at = lambda a, b, size: F.floor((c(a) + (c(b) - c(a)) * c("k") / c("steps")) / size).cast("int")
    cells = every.select("page", at("ax", "bx", cell_w).alias("column"), at("ay", "by", cell_h).alias("row")).distinct()
    return cells.filter((c("column") < columns) & (c("row") < rows) & (c("column") >= 0) & (c("row") >= 0))



def located_offset(px: DataFrame, rings: DataFrame, per_mm: float, max_shift_mm: float) -> DataFrame:
    """id, dx_mm, dy_mm: the shift, that far to each side at most, that puts the most ink and the least paper inside the rings.

    px: a picture's pixels (id, x, y, r, g, b); rings: id, ring in millimetres. Ink counts one for, paper one against, what
    is off the page nothing. A shift that is no more than half a pixel better than none is none; of equal ones
    the first, from none to the right and down, then from the far left and top. Pictures without a ring stay.

    A run of the mask over a line of the picture is the difference of two running sums, so each meets a line once
    for all shifts along it.
    """
    c = F.col
    reach = int(-(-max_shift_mm * per_mm // 1))
    line = Window.partitionBy("id", "y").orderBy("x")
    sums = px.select("id", "x", "y", F.sum(F.when(raster.ink(), 1).otherwise(-1)).over(line).alias("sum"))
    lines = sums.groupBy("id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "sum"))), lambda p: p["sum"]).alias("sums"))
    sizes = raster.sizes(px)
    wide = sizes.select("id", (c("width") + 2 * reach).alias("width"), (c("height") + 2 * reach).alias("height"))
    beside = rings.select("id", F.transform("ring", lambda p: F.struct((p["x"] + reach / per_mm).alias("x"), (p["y"] + reach / per_mm).alias("y"))).alias("ring"))
    mask = filled(beside, wide, per_mm).select("id", (c("y") - reach).alias("row"), (c("x0") - reach).alias("x0"), (c("x1") - reach).alias("x1"))
    met = mask.withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("y", c("row") + c("dy")).join(lines, ["id", "y"])
    before = lambda x: F.when(x <= 0, F.lit(0)).otherwise(F.get("sums", F.least(x, F.size("sums")).cast("int") - 1))
    each = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.struct(d.alias("dx"), (before(c("x1") + d + 1) - before(c("x0") + d)).alias("score")))
    scores = met.select("id", "dy", F.inline(each)).groupBy("id", "dy", "dx").agg(F.sum("score").alias("score"))
    turn = lambda d: F.when(c(d) < 0, c(d) + 2 * reach + 1).otherwise(c(d))
    best = scores.groupBy("id").agg(F.max(F.struct("score", (-turn("dy")).alias("down"), (-turn("dx")).alias("right"), "dx", "dy")).alias("best"), F.max(F.when((c("dx") == 0) & (c("dy") == 0), c("score"))).alias("here"))
    good = c("best.score") > F.coalesce("here", F.lit(0)) + 0.5
    shift = lambda k: F.coalesce(F.when(good, c(f"best.{k}") / F.lit(float(per_mm))), F.lit(0.0)).alias(f"{k}_mm")
    return sizes.select("id").join(best, "id", "left").select("id", shift("dx"), shift("dy"))
