"""Measurements on rasters as Spark jobs: a picture is its pixels, a row each (id, x, y, r, g, b).

Lines, tiles and regions are groups and windows of pixels, so a picture's pixels meet where its group does and
pictures are worked on in parallel. Only the two measures that follow a path through a picture, the fusing of
boxes and the largest free rectangle, hand a picture's few boxes, or its cells, to a small function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state

#: A channel below INK is ink; DETAIL is the least step between neighbours, TILE_SHARE the least share of a tile with detail, SOLID the share of a line that counts as inked, FILL the least share of their union that fused boxes fill.
INK, DETAIL, TILE_SHARE, SOLID, FILL = 250, 34.0, 0.06, 0.55, 0.55
#: Fixed values in millimetres: a tile's side, how deep ink must last to count as an edge's, and the paper on both sides of a guide.
TILE_MM, RUN_MM, CLEAR_MM = 10.0, 2.0, 1.5
SIDES = ["left", "top", "right", "bottom"]


def pixels(pictures: DataFrame) -> DataFrame:
    """id, x, y, r, g, b of pictures (id, width, pixels: bytes, three a pixel, row by row). Bytes that fill no row don't count."""
    n = F.floor(F.octet_length("pixels") / 3).cast("int")
    whole = F.when(F.col("width") > 0, n - n % F.col("width").cast("int"))
    each = pictures.select("id", F.col("width").cast("int").alias("width"), "pixels", F.explode(F.when(whole > 0, F.sequence(F.lit(0), whole - 1))).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("pixels", F.col("i") * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    return each.select("id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))


def ink() -> Column:
    return (F.col("r") < INK) | (F.col("g") < INK) | (F.col("b") < INK)


def lines(px: DataFrame) -> DataFrame:
    """id, axis (x: columns, y: rows), at, inked, any_ink: whether ink covers enough of each line, and whether there is any."""
    per = lambda axis: px.groupBy("id", F.lit(axis).alias("axis"), F.col(axis).alias("at")).agg((F.avg(ink().cast("int")) >= SOLID).alias("inked"), F.bool_or(ink()).alias("any_ink"))
    return per("x").unionByName(per("y"))


def blank_edges(px: DataFrame, per_mm: float, scale: float = 1.0) -> DataFrame:
    """id, left, top, right, bottom: millimetres before lasting ink, in full size; half the extent where none lasts; half the width all round without any ink."""
    n = max(2, round(RUN_MM * per_mm))
    run = Window.partitionBy("id", "axis").orderBy("at").rowsBetween(-(n - 1), 0)
    full = (F.sum(F.col("inked").cast("int")).over(run) == n) & (F.count(F.lit(1)).over(run) == n)
    per = lines(px).withColumn("ends", F.when(full, F.col("at"))).groupBy("id", "axis").agg(F.min("ends").alias("first"), F.max("ends").alias("last"), F.count(F.lit(1)).alias("extent"), F.bool_or("any_ink").alias("any_ink"))
    mm = lambda c: c / per_mm * scale
    near, far = mm(F.coalesce(F.col("first") - (n - 1), F.col("extent") / 2)), mm(F.coalesce(F.col("extent") - 1 - F.col("last"), F.col("extent") / 2))
    by = lambda axis, c: F.max(F.when(F.col("axis") == axis, c))
    blank = F.when(~F.bool_or("any_ink"), by("x", mm(F.col("extent") / 2)))
    return per.groupBy("id").agg(*[F.coalesce(blank, by(axis, c)).alias(s) for s, axis, c in (("left", "x", near), ("top", "y", near), ("right", "x", far), ("bottom", "y", far))])


def guides(px: DataFrame, per_mm: float, inset_mm: float) -> DataFrame:
    """id, guides_present: a thin inked line at the inset, across or down, with clean paper on both sides.

    Paper outside it is looked for from the second pixel on: the first is where a page's own edge is drawn.
    """
    inset, clear = round(inset_mm * per_mm), max(1, round(CLEAR_MM * per_mm))
    at, inked = F.col("at"), F.col("inked")
    hit = lambda low, high: F.bool_or(inked & (at >= low) & (at < high))
    per = lines(px).groupBy("id", "axis").agg(hit(max(0, inset - 1), inset + 2).alias("near"), hit(max(1, inset - 1 - clear), max(1, inset - 1)).alias("before"), hit(inset + 2, inset + 2 + clear).alias("after"), F.count(F.lit(1)).alias("extent"))
    one = F.col("near") & ~F.col("before") & ~F.col("after") & F.lit(inset > 0) & (F.lit(inset) < F.col("extent"))
    return per.groupBy("id").agg(F.bool_or(one).alias("guides_present"))


def detail(px: DataFrame) -> DataFrame:
    """px and detail: the pixel's mean brightness differs from the one's before it, or above it, by DETAIL or more."""
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3
    step = lambda along, over: F.coalesce(F.abs(F.col("grey") - F.lag("grey").over(Window.partitionBy("id", over).orderBy(along))), F.lit(0.0))
    return px.withColumn("grey", grey).withColumn("detail", F.greatest(step("x", "y"), step("y", "x")) >= DETAIL).drop("grey")


def tile_side(per_mm: float) -> int:
    return max(2, round(TILE_MM * per_mm))


def tiles(flagged: DataFrame, per_mm: float, flag: Column | None = None) -> DataFrame:
    """page, x, y of the tiles of which a share of at least TILE_SHARE has the flag (detail, unless told otherwise)."""
    side = tile_side(per_mm)
    on = F.avg((F.col("detail") if flag is None else flag).cast("int"))
    per = flagged.groupBy(F.col("id").alias("page"), F.floor(F.col("x") / side).alias("x"), F.floor(F.col("y") / side).alias("y")).agg(on.alias("share"))
    return per.filter(F.col("share") >= TILE_SHARE).drop("share")


def _fused(gap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [tuple(map(int, r)) for r in pdf.sort_values(["y0", "x0", "y1", "x1"])[["x0", "y0", "x1", "y1"]].to_numpy()]
        again = True
        while again:  # a picture's regions are few
            again = False
            for i, j in ((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes))):
                a, b = boxes[i], boxes[j]
                near = a[0] - gap < b[2] and b[0] - gap < a[2] and a[1] - gap < b[3] and b[1] - gap < a[3]
                union = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                size = lambda c: (c[2] - c[0]) * (c[3] - c[1])
                if near and size(a) + size(b) >= FILL * size(union):
                    boxes[i] = union
                    del boxes[j]
                    again = True
                    break
        return pd.DataFrame([(pdf["id"].iloc[0], *b) for b in boxes], columns=["id", "x0", "y0", "x1", "y1"])

    return run


def regions(marked: DataFrame, sizes: DataFrame, per_mm: float) -> DataFrame:
    """id, x0, y0, x1, y1 in pixels of marked tiles (page, x, y) merged into blocks: runs, equal runs below each other, and what is nearer than a tile and fills its union.

    sizes: id, width, height.
    """
    side = tile_side(per_mm)
    blocks = state.merged_tiles(marked).join(sizes.withColumnRenamed("id", "page"), "page")
    cut = lambda c, most: F.least(c * side, F.col(most)).cast("long")
    boxes = blocks.select(F.col("page").alias("id"), (F.col("x0") * side).cast("long").alias("x0"), (F.col("y0") * side).cast("long").alias("y0"), cut(F.col("x1") + 1, "width").alias("x1"), cut(F.col("y1") + 1, "height").alias("y1"))
    return boxes.groupBy("id").applyInPandas(_fused(side), "id long, x0 long, y0 long, x1 long, y1 long")


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def intrusions(px: DataFrame, depths_mm: dict[str, float], per_mm: float) -> tuple[DataFrame, DataFrame]:
    """Where detail lies in the margins to be kept free, and how deep: (id, x, y, w, h in millimetres), (id, intrusion_mm).

    Detail inside the margins' inner edge doesn't count. Margins that meet, or none at all, have no intrusion.
    The depth is the regions' furthest reach past the inner edge, a side's own margin at most.
    """
    ring = {s: round(depths_mm[s] * per_mm) for s in SIDES}
    size = sizes(px)
    inner = (F.col("x") >= ring["left"]) & (F.col("x") < F.col("width") - ring["right"]) & (F.col("y") >= ring["top"]) & (F.col("y") < F.col("height") - ring["bottom"])
    apart = (F.lit(ring["left"] + ring["right"]) < F.col("width")) & (F.lit(ring["top"] + ring["bottom"]) < F.col("height")) & F.lit(max(ring.values()) > 0)
    held = detail(px).join(size, "id").filter(apart)
    boxes = regions(tiles(held, per_mm, F.col("detail") & ~inner), size, per_mm)
    tenth = lambda c: F.bround(c / per_mm, 1)
    found = boxes.select("id", tenth(F.col("x0")).alias("x"), tenth(F.col("y0")).alias("y"), tenth(F.col("x1") - F.col("x0")).alias("w"), tenth(F.col("y1") - F.col("y0")).alias("h"))
    measured = found.join(size, "id")
    into = {"left": F.lit(depths_mm["left"]) - F.col("x"), "top": F.lit(depths_mm["top"]) - F.col("y"), "right": F.col("x") + F.col("w") - (F.col("width") / per_mm - depths_mm["right"]), "bottom": F.col("y") + F.col("h") - (F.col("height") / per_mm - depths_mm["bottom"])}
    deep = F.greatest(F.lit(0.0), *[F.least(into[s], F.lit(depths_mm[s])) for s in SIDES if depths_mm[s] > 0]) if any(v > 0 for v in depths_mm.values()) else F.lit(0.0)
    worst = measured.groupBy("id").agg(F.bround(F.max(deep), 2).alias("worst"))
    return found, size.select("id").join(worst, "id", "left").select("id", F.coalesce("worst", F.lit(0.0)).alias("intrusion_mm"))


def largest_rectangle(free: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the largest rectangle of true cells; the first found of equal ones."""
    height, best, found = np.zeros(free.shape[1], int), 0, None
    for y, row in enumerate(free):
        height = np.where(row, height + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, h in enumerate([*height, 0]):
            start = x
            while stack and stack[-1][1] >= h:
                start, tall = stack.pop()
                if tall * (x - start) > best:
                    best, found = tall * (x - start), (int(start), int(y - tall + 1), int(x - start), int(tall))
            stack.append((start, h))
    return found


def free_rectangles(cells: DataFrame) -> DataFrame:
    """id, x, y, w, h of the largest rectangle of free cells (id, x, y, free) of each grid; no row without a free cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        grid[pdf["y"], pdf["x"]] = pdf["free"]
        found = largest_rectangle(grid)
        return pd.DataFrame([(pdf["id"].iloc[0], *found)] if found else [], columns=["id", "x", "y", "w", "h"])

    return cells.select("id", "x", "y", "free").groupBy("id").applyInPandas(run, "id long, x long, y long, w long, h long")


def cleared(cells: DataFrame, marks: DataFrame, by: int) -> DataFrame:
    """cells (id, x, y) with free: no mark (id, x, y) lies within so many cells, across or down."""
    step = F.sequence(F.lit(-by), F.lit(by))
    near = marks.select("id", "x", "y").distinct().select("id", F.explode(F.transform(step, lambda d: F.col("x") + d)).alias("x"), "y")
    near = near.select("id", "x", F.explode(F.transform(step, lambda d: F.col("y") + d)).alias("y")).distinct().withColumn("taken", F.lit(True))
    return cells.join(near, ["id", "x", "y"], "left").select("id", "x", "y", F.col("taken").isNull().alias("free"))
