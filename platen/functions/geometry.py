"""Geometry on arrays of points (structs x, y), in expressions: areas, boxes, curves, distances, parity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points a curve is sampled at for its box, and for the length of a die; how near, in millimetres, a flattened curve follows it.
BOX_SAMPLES, DIE_SAMPLES, FLAT_MM = 64, 12, 0.05


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column | float, y: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def _pairs(ring: Column) -> Column:
    """Each point with its follower, the last with the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, p: total + of(p))


def signed_area(ring: Column) -> Column:
    """Half the sum of cross products: positive counter-clockwise in a y-up frame."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(_sum(_pairs(ring), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2)


def perimeter(ring: Column) -> Column:
    return _sum(_pairs(ring), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def box(points: Column) -> Column:
    """struct(x0, y0, x1, y1); null for no point."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def curve(p0: Column, p1: Column, p2: Column, p3: Column, n: int = BOX_SAMPLES) -> Column:
    """Points of a cubic curve at 1/n, 2/n, ... 1."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(n))
        u = 1 - t
        mixed = lambda k: p0[k] * u * u * u + p1[k] * u * u * t * 3 + p2[k] * u * t * t * 3 + p3[k] * t * t * t
        return F.struct(mixed("x").alias("x"), mixed("y").alias("y"))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), at)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd parity of the edges that a ray to the right crosses."""
    crosses = lambda p: (((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"])).cast("int")
    return F.aggregate(_pairs(ring), F.lit(0), lambda n, p: n + F.coalesce(F.when(p["a"]["y"] != p["b"]["y"], crosses(p)), F.lit(0))) % 2 == 1


def distance_to_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long2 = dx * dx + dy * dy
    t = F.when(long2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(long2 == 0, 1.0).otherwise(long2))))
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(_pairs(ring), lambda p: distance_to_segment(x, y, p["a"], p["b"])))


def thinned(points: Column, most: int = 400) -> Column:
    """Every k-th point so that about ``most`` remain, and the last."""
    stride = F.greatest(F.lit(1), F.ceil(F.size(points) / most)).cast("int")
    return F.filter(points, lambda p, i: (i % stride == 0) | (i == F.size(points) - 1))


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """struct(x0, y0, x1, y1) of a segment within a page, or null: each side narrows the stretch of its parameter."""
    dx, dy = x1 - x0, y1 - y0
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for slope, room in ((-dx, x0), (dx, w - x0), (-dy, y0), (dy, h - y0)):
        t = room / F.when(slope == 0, None).otherwise(slope)
        out = out | ((slope == 0) & (room < 0))
        low = F.greatest(low, F.when(slope < 0, t).otherwise(0.0))
        high = F.least(high, F.when(slope > 0, t).otherwise(1.0))
    finite = ~(F.isnan(dx) | F.isnan(dy) | (F.abs(dx) == float("inf")) | (F.abs(dy) == float("inf")))
    return F.when(finite & ~out & (low <= high), F.struct((x0 + low * dx).alias("x0"), (y0 + low * dy).alias("y0"), (x0 + high * dx).alias("x1"), (y0 + high * dy).alias("y1")))


def flattened(p0: Column, p1: Column, p2: Column, p3: Column, tolerance: float = FLAT_MM) -> Column:
    """Points of a cubic curve behind its first, as many as its control polygon's length asks for at a tolerance, 2 to 512; doubles left out."""
    far = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    long = far(p0, p1) + far(p1, p2) + far(p2, p3)
    long = F.when(long == 0, 1.0).otherwise(long)
    steps = F.greatest(F.lit(2), F.least(F.lit(512), F.floor(F.sqrt(long / max(tolerance, 0.001)) + 1).cast("int")))

    def at(i: Column, n: Column) -> Column:
        t = i / n
        u = 1 - t
        mixed = lambda k: p0[k] * u * u * u + p1[k] * u * u * t * 3 + p2[k] * u * t * t * 3 + p3[k] * t * t * t
        return F.struct(mixed("x").alias("x"), mixed("y").alias("y"))

    points = let(steps, lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: at(i, n)))
    return let(points, lambda all_: F.filter(all_, lambda p, i: far(F.coalesce(F.get(all_, i - 1), p0), p) > 1e-7))


def die_points(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Points of a cubic curve behind its first, as the length of a die takes them."""
    return curve(p0, p1, p2, p3, DIE_SAMPLES)


def mirrored(points: Column, page_w: Column, page_h: Column, reflect: Column) -> Column:
    """A page's points with y downwards instead of upwards, and seen from behind where reflect holds."""
    return F.transform(points, lambda p: point(F.when(reflect, page_w - p["x"]).otherwise(p["x"]), page_h - p["y"]))


def in_polygons(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd parity over all rings together: a hole in a hole is inside."""
    hits = F.aggregate(rings, F.lit(0), lambda n, r: n + inside(r, x, y).cast("int"))
    return hits % 2 == 1


#: Fixed value: a box narrower than this has collapsed.
LEAST_EXTENT = 1e-9


def fit_orientation(u: Column, page: Column) -> Column:
    """struct(turn, error, au, bu, cu, av, bv, cv): the turn that lays a box (struct x0, y0, x1, y1) on a page box, and the map that does it.

    error is the logarithm of the aspects' ratio after the turn. Of the eight ways four turns and a mirror
    allow, those of one parity have the same error, and upright, unmirrored ones come first: so it is no
    turn, or a quarter one if that is nearer. Null for a box of no width or height, or where a corner is missing;
    a page box of no width or height counts as LEAST_EXTENT wide or high for its aspect.
    """
    w, h, pw, ph = u["x1"] - u["x0"], u["y1"] - u["y0"], page["x1"] - page["x0"], page["y1"] - page["y0"]
    w, h = (F.when(x >= LEAST_EXTENT, x) for x in (w, h))
    some = lambda x: F.when(x == 0, LEAST_EXTENT).otherwise(x)
    aspect = some(F.try_divide(pw, some(ph)))
    error = lambda a, b: F.abs(F.log(F.try_divide(F.try_divide(a, b), aspect)))
    turn = error(h, w) < error(w, h) - 1e-9
    number = lambda c: c.cast("double")
    au, bu, cu = F.when(turn, 0.0).otherwise(pw / w), F.when(turn, -pw / h).otherwise(0.0), F.when(turn, page["x1"] + u["y0"] * pw / h).otherwise(page["x0"] - u["x0"] * pw / w)
    av, bv, cv = F.when(turn, ph / w).otherwise(0.0), F.when(turn, 0.0).otherwise(ph / h), F.when(turn, page["y0"] - u["x0"] * ph / w).otherwise(page["y0"] - u["y0"] * ph / h)
    fit = F.struct(turn.cast("int").alias("turn"), F.least(error(w, h), error(h, w)).alias("error"), *[number(c).alias(n) for c, n in ((au, "au"), (bu, "bu"), (cu, "cu"), (av, "av"), (bv, "bv"), (cv, "cv"))])
    return F.when(w.isNotNull() & h.isNotNull() & aspect.isNotNull(), fit)
