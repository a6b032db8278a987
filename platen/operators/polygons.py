"""Polygons in expressions: offsets, clips, resampling, flattened curves; and the largest box within one.

A ring is an array of points (structs x, y). Everything but the inscribed box, which needs a grid of cells,
is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.geometry import let, point
from .raster import free_rectangles

#: How long a corner may get in offsets, how near an offset may come in them, the least area that remains, a box's grid.
MITER, NEAR_SHARE, LEAST_AREA, GRID = 4.0, 0.98, 0.02, 160


def opened(ring: Column) -> Column:
    """The ring without a last point that repeats the first."""
    n = F.size(ring)
    first, last = F.get(ring, F.lit(0)), F.get(ring, n - 1)
    return F.when((n > 1) & (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) < 1e-6), F.slice(ring, 1, F.greatest(n - 1, F.lit(1)))).otherwise(ring)


def _moved(ring: Column, by: float) -> Column:
    """Corners of a counter-clockwise ring moved along the bisector of their edges' right-hand normals; corners without an edge are left out."""
    n = F.size(ring)
    at = lambda i: F.get(ring, (i + n) % n)

    def unit(p: Column, q: Column) -> Column:
        size = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        return F.when(size > 1e-9, point((q["x"] - p["x"]) / size, (q["y"] - p["y"]) / size))

    def corner(p: Column, i: Column) -> Column:
        def place(u: Column) -> Column:
            into, out = u["into"], u["out"]
            bx, by_ = into["y"] + out["y"], -into["x"] - out["x"]
            size = F.hypot(bx, by_)
            half = (bx * into["y"] - by_ * into["x"]) / size
            reach = F.when(F.abs(half) > 1e-9, by / half).otherwise(by * MITER)
            most = F.lit(abs(by) * MITER)
            reach = F.greatest(-most, F.least(most, reach))
            straight = point(p["x"] + into["y"] * by, p["y"] - into["x"] * by)
            return F.when(into.isNotNull() & out.isNotNull(), F.when(size < 1e-9, straight).otherwise(point(p["x"] + bx / size * reach, p["y"] + by_ / size * reach)))

        return let(F.struct(unit(at(i - 1), p).alias("into"), unit(p, at(i + 1)).alias("out")), place)

    return F.filter(F.transform(ring, corner), lambda p: p.isNotNull())


def offset(ring: Column, by: float) -> Column:
    """struct(ring, problem): the ring moved outwards (or, for a negative number, inwards), or why it can't be; it keeps its direction.

    Corners that end up nearer the old ring than they were moved, or on its wrong side, belong to parts that
    fold over and are left out.
    """

    def of(own: Column) -> Column:
        box, area = geometry.box(own), geometry.signed_area(own)
        turned = F.when(area < 0, F.reverse(own)).otherwise(own)

        def kept(base: Column) -> Column:
            good = lambda p: (geometry.distance_to_ring(base, p["x"], p["y"]) >= NEAR_SHARE * abs(by)) & (geometry.inside(base, p["x"], p["y"]) == F.lit(by < 0))
            return F.filter(_moved(base, by), good)

        def judged(new: Column) -> Column:
            problem = F.when(F.size(new) < 3, "too few points").when(F.abs(geometry.signed_area(new)) < LEAST_AREA * F.abs(area), "too small")
            return F.struct(F.when(problem.isNull(), F.when(area < 0, F.reverse(new)).otherwise(new)).alias("ring"), problem.alias("problem"))

        none = F.lit(None).cast("array<struct<x:double,y:double>>")
        refused = F.when(F.size(own) < 3, "too few points").when(F.lit(by < 0) & (F.least(box["x1"] - box["x0"], box["y1"] - box["y0"]) <= 2 * abs(by)), "nothing left").when(F.abs(area) < 1e-6, "no area")
        return F.when(refused.isNotNull(), F.struct(none.alias("ring"), refused.alias("problem"))).otherwise(let(let(turned, kept), judged))

    if abs(by) < 1e-9:
        return F.struct(ring.alias("ring"), F.lit(None).cast("string").alias("problem"))
    return let(opened(ring), of)


def _cut(axis: str, bound: float, sign: int):
    """The part of a ring on one side of a line."""

    def of(own: Column) -> Column:
        n = F.size(own)

        away = lambda p: (p[axis] - bound) * sign

        def edge(p: Column, i: Column) -> Column:
            def cut(q: Column) -> Column:
                a, b = away(p), away(q)
                t = a / F.nullif(a - b, F.lit(0.0))
                mixed = lambda k: (p[k] + (q[k] - p[k]) * t).alias(k)
                return F.array(F.when(a >= 0, point(p["x"], p["y"])), F.when(a * b < 0, F.struct(mixed("x"), mixed("y"))))

            return let(F.get(own, (i + 1) % n), cut)

        # most rings lie on one side of most lines: nothing is worked out for them
        all_in = F.forall(own, lambda p: F.coalesce(away(p) >= 0, F.lit(False)))
        return F.when(all_in, own).otherwise(F.filter(F.flatten(F.transform(own, edge)), lambda p: p.isNotNull()))

    return of


def clip(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of the ring within a box: cut by one side after the other."""
    for axis, bound, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        ring = let(ring, _cut(axis, bound, sign))
    return ring


def resampled(ring: Column, n: int) -> Column:
    """n points evenly spaced along the closed ring, from its first."""

    def of(own: Column) -> Column:
        size = F.size(own)
        after = lambda i: F.get(own, (i + 1) % size)
        steps = F.transform(own, lambda p, i: F.hypot(after(i)["x"] - p["x"], after(i)["y"] - p["y"]))

        def along(ends: Column) -> Column:
            def place(k: Column) -> Column:
                def on(t: Column) -> Column:
                    i = F.least(F.size(F.filter(ends, lambda e: e <= t)), size - 1)
                    a, b = F.get(own, i), after(i)
                    before = F.coalesce(F.get(ends, i - 1), F.lit(0.0))
                    long = F.get(ends, i) - before
                    s = F.when(long > 0, (t - before) / long).otherwise(0.0)
                    return point(a["x"] + (b["x"] - a["x"]) * s, a["y"] + (b["y"] - a["y"]) * s)

                return let(F.element_at(ends, -1) * k / n, on)

            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place)

        running = F.aggregate(steps, F.array().cast("array<double>"), lambda out, d: F.array_append(out, F.coalesce(F.get(out, F.size(out) - 1), F.lit(0.0)) + d))
        return F.when(size > 0, let(running, along))

    return let(ring, of)


def inscribed_boxes(rings: DataFrame, n: int = GRID) -> DataFrame:
    """id, x, y, w, h of about the largest box within each ring: its box's cells, n a side, are rows; those whose middle lies inside are free."""
    box = geometry.box(F.col("ring"))
    sized = rings.filter(F.size("ring") > 2).select("id", "ring", box.alias("b")).filter("b.x1 > b.x0 and b.y1 > b.y0")
    cell = lambda k: (F.col(f"b.{k}1") - F.col(f"b.{k}0")) / n
    grid = sized.select("id", "ring", F.col("b.x0").alias("x0"), F.col("b.y0").alias("y0"), cell("x").alias("dx"), cell("y").alias("dy"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("x"))
    free = geometry.inside(F.col("ring"), F.col("x0") + (F.col("x") + 0.5) * F.col("dx"), F.col("y0") + (F.col("y") + 0.5) * F.col("dy"))
    found = free_rectangles(grid.select("id", "x", "y", free.alias("free")))
    frame = sized.select("id", F.col("b.x0").alias("x0"), F.col("b.y0").alias("y0"), cell("x").alias("dx"), cell("y").alias("dy"))
    return found.join(frame, "id").select("id", (F.col("x0") + F.col("x") * F.col("dx")).alias("x"), (F.col("y0") + F.col("y") * F.col("dy")).alias("y"), (F.col("w") * F.col("dx")).alias("w"), (F.col("h") * F.col("dy")).alias("h"))
