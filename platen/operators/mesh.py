"""Meshes: islands of triangles, affine maps fitted and applied, assignment of islands to boxes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..staging import staged
from . import components

SINGULAR = 1e-12
#: Up to so many groups' means and fits (some 60 bytes each) are broadcast, after they were counted.
BROADCAST_FITS = 100_000
#: A task sorts about so many corners or vertices; there are as many tasks as that takes.
TASK_ROWS = 500_000


def islands(triangles: DataFrame) -> DataFrame:
    """mesh, t, island of triangles (mesh long, t long, v0, v1, v2): those that share a vertex share an island.

    A mesh's islands are numbered from 0 by their first triangle. A triangle that lacks a corner is on no island (null).
    Components are found by joins, so a mesh of any size is many tasks' work.
    """
    own = staged(triangles.select("mesh", "t", "v0", "v1", "v2"), "mesh-triangles")
    whole = own.dropna(subset=["v0", "v1", "v2"])
    sides = whole.select("mesh", F.col("v0").alias("a"), F.explode(F.array("v0", "v1", "v2")).alias("b"))
    found = components.components(sides).select("mesh", F.col("node").alias("v0"), "root")
    corners = whole.groupBy("mesh", "v0").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    rooted = staged(corners.join(found, ["mesh", "v0"]), "mesh-corners")
    firsts = rooted.groupBy("mesh", "root").agg(F.min("first").alias("first"))
    numbers = firsts.withColumn("island", (F.row_number().over(Window.partitionBy("mesh").orderBy("first", "root")) - 1).cast("int")).drop("first")
    named = staged(rooted.join(numbers, ["mesh", "root"]).select("mesh", "v0", "n", "island"), "mesh-islands")
    laid = components.joined(whole, named, ["mesh", "v0"], own.count()).select("mesh", "t", "island")
    return laid.unionByName(own.filter("v0 IS NULL OR v1 IS NULL OR v2 IS NULL").select("mesh", "t", F.lit(None).cast("int").alias("island")))


def dealt(t: DataFrame, rows: int, *keys: str) -> DataFrame:
    """t by its keys, in parts of at most about TASK_ROWS of so many rows, so that what a task holds doesn't grow with them."""
    parts = -(-rows // TASK_ROWS)
    if parts <= 1:
        return t
    return t.repartition(max(parts, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)  # fewer than usual would be shuffled again


def island_boxes(numbered: DataFrame, triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, island, u0, v0, u1, v1: the extent of each island's vertices (mesh, v, u_mm, v_mm).

    Triangles and vertices are counted, and dealt to as many tasks as they need.
    """
    n = max(3 * triangles.count(), vertices.count())
    corners = dealt(numbered, n, "mesh", "t").join(dealt(triangles, n, "mesh", "t"), ["mesh", "t"]).select("mesh", "island", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    placed = dealt(corners, n, "mesh", "v").join(dealt(vertices, n, "mesh", "v"), ["mesh", "v"])
    return placed.groupBy("mesh", "island").agg(F.min("u_mm").alias("u0"), F.min("v_mm").alias("v0"), F.max("u_mm").alias("u1"), F.max("v_mm").alias("v1"))


def affine_fit(df: DataFrame, keys: list[str], x: str, y: str, u: str) -> DataFrame:
    """keys, a, b, c, residual: u = a x + b y + c by least squares, sums in Spark, the three by three system in expressions.

    Null where the points lie on a line. residual is the largest error.
    """
    mean = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"))
    mean = F.broadcast(mean) if mean.count() <= BROADCAST_FITS else mean
    off = df.join(mean, keys).select(*keys, (F.col(x) - F.col("mx")).alias("dx"), (F.col(y) - F.col("my")).alias("dy"), (F.col(u) - F.col("mu")).alias("du"), "mx", "my", "mu")
    sums = off.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dx") * F.col("du")).alias("xu"), F.sum(F.col("dy") * F.col("du")).alias("yu"), *[F.first(c).alias(c) for c in ("mx", "my", "mu")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    good = F.abs(det) > SINGULAR * F.greatest(F.col("xx") * F.col("yy"), F.lit(SINGULAR))
    sums = sums.withColumn("a", F.when(good, (F.col("xu") * F.col("yy") - F.col("yu") * F.col("xy")) / det)).withColumn("b", F.when(good, (F.col("yu") * F.col("xx") - F.col("xu") * F.col("xy")) / det))
    fit = sums.withColumn("c", F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select(*keys, "a", "b", "c")
    error = F.max(F.abs(F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c") - F.col(u)))
    few = mean.count() <= BROADCAST_FITS  # then rows stay where they are, however many a group has
    fits = F.broadcast(fit) if few else fit
    return df.join(fits, keys).groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"), error.alias("residual"))


#: A pivot below which a system is singular, and the share of the trace that is added to it then; how far off a line points are, by the square of their extent.
PIVOT, RIDGE, OFF_LINE = 1e-12, 1e-9, 1e-9


def _cleared(k: int, least: Column) -> Callable[[Column], Column]:
    """A step of elimination: the largest of column k's rest comes to row k, and what others have in that column goes."""
    col = F.lit(k)

    def step(m: Column) -> Column:
        best = F.array_max(F.array(*[F.struct(F.abs(F.get(F.get(m, F.lit(r)), col)).alias("size"), F.lit(-r).alias("row")) for r in range(k, 4)]))

        def eliminated(found: Column) -> Column:
            row = -found["row"]
            pivot = F.get(m, row)
            swapped = F.transform(m, lambda own, r: F.when(r == col, pivot).when(r == row, F.get(m, col)).otherwise(own))
            clear = lambda own, r: F.when(r == col, own).otherwise(F.zip_with(own, pivot, lambda a, b: a - F.get(own, col) / F.get(pivot, col) * b))
            return F.when(found["size"] >= least, geometry.let(swapped, lambda w: F.transform(w, clear)))

        return geometry.let(best, eliminated)

    return step


def solved(rows: Column, least: Column) -> Column:
    """The rows of a system (an array of arrays of four coefficients and what they come to, any number of right sides) solved by
    elimination with the largest pivot: an array of four arrays, or null where a pivot is below the least.
    """
    for k in range(4):
        rows = geometry.let(rows, _cleared(k, least))
    rest = lambda own, i: F.transform(F.slice(own, 5, F.size(own)), lambda v: v / F.get(own, i))
    return geometry.let(rows, lambda m: F.when(m.isNotNull(), F.transform(m, rest)))


def space_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str, u: str, v: str) -> DataFrame:
    """keys, au, bu, cu, du, av, bv, cv, dv, flat, residual_u, residual_v: u = au x + bu y + cu z + du by least squares, and v alike.

    Where the points lie in a plane the system is singular (flat): a whisper of its trace on its diagonal then picks the
    smallest map, which is the same on the plane. Null for fewer than four points, and for points on a line. Rows
    that lack a number don't count; residuals are the largest errors.
    """
    c = F.col
    own = df.select(*keys, *[c(k).cast("double").alias(n) for k, n in zip((x, y, z, u, v), ("x", "y", "z", "u", "v"), strict=True)]).dropna(subset=["x", "y", "z", "u", "v"])
    from_ = [c("x"), c("y"), c("z"), F.lit(1.0)]
    sums = {f"s{i}{j}": F.sum(from_[i] * from_[j]) for i in range(4) for j in range(i, 4)} | {f"{n}{i}": F.sum(from_[i] * c(n)) for n in "uv" for i in range(4)}
    per = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z")).alias("p"), *[e.alias(k) for k, e in sums.items()])
    few = per.count() <= BROADCAST_FITS
    spread = lambda t: F.broadcast(t) if few else t
    edge = F.struct(*[(c(k) - c(f"p.{k}")).alias(k) for k in "xyz"])
    long = F.sqrt(c("e.x") * c("e.x") + c("e.y") * c("e.y") + c("e.z") * c("e.z"))
    edges = own.join(spread(per.select(*keys, "p")), keys).select(*keys, edge.alias("e")).withColumn("long", long)
    far = edges.groupBy(*keys).agg(F.max(F.struct("long", "e")).alias("far"))
    f = lambda k: c(f"far.e.{k}")
    cross = [c(f"e.{a}") * f(b) - c(f"e.{b}") * f(a) for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]
    off = F.sqrt(sum((k * k for k in cross[1:]), cross[0] * cross[0]))
    lines = edges.join(spread(far), keys).groupBy(*keys).agg((F.max(off) <= OFF_LINE * F.max(c("far.long") * c("far.long"))).alias("line"))
    cell = lambda i, j, extra: c(f"s{min(i, j)}{max(i, j)}") + (extra if i == j else F.lit(0.0))
    system = lambda extra: F.array(*[F.array(*[cell(i, j, extra) for j in range(4)], c(f"u{i}"), c(f"v{i}")) for i in range(4)])
    trace = c("s00") + c("s11") + c("s22") + c("s33")
    least = F.greatest(trace, F.lit(1.0)) * PIVOT  # of many or large points rounding leaves more than PIVOT
    found = per.join(spread(lines), keys).withColumn("exact", F.when(c("n") >= 4, solved(system(F.lit(0.0)), least)))
    found = found.withColumn("fit", F.coalesce("exact", F.when((c("n") >= 4) & ~c("line"), solved(system(trace * (RIDGE / 4)), least))))
    fits = found.select(*keys, *[F.get(F.get("fit", F.lit(i)), F.lit(k)).alias(f"{a}{n}") for k, n in enumerate("uv") for i, a in enumerate("abcd")], (c("exact").isNull() & c("fit").isNotNull()).alias("flat"))
    error = lambda n: F.max(F.abs(c(f"a{n}") * c("x") + c(f"b{n}") * c("y") + c(f"c{n}") * c("z") + c(f"d{n}") - c(n))).alias(f"residual_{n}")
    return spread(fits).join(own.join(spread(fits), keys).groupBy(*keys).agg(error("u"), error("v")), keys)


def applied(vertices: DataFrame, maps: DataFrame, on: list[str]) -> DataFrame:
    """vertices with u, v through their island's affine map (on, au, bu, cu, av, bv, cv)."""
    mapped = vertices.join(maps, on)
    at = lambda k: F.col(f"a{k}") * F.col("x") + F.col(f"b{k}") * F.col("y") + F.col(f"c{k}")
    return mapped.withColumn("u", at("u")).withColumn("v", at("v")).drop("au", "bu", "cu", "av", "bv", "cv")


def regrouped(triangles: DataFrame, mapped: Column) -> DataFrame:
    """triangles with place: the mapped ones first, each part in its order."""
    return triangles.withColumn("place", F.row_number().over(Window.partitionBy("mesh").orderBy(F.desc(mapped.cast("int")), "t")))


#: Fixed value: aspect errors (logarithms) nearer than this are a tie, which size settles.
ASPECT_TIE = 0.05


def _choose(pages: Column, w: Column, h: Column, used: Column) -> Column:
    """struct(box, at, error) of the box that an island of this size lies on, among the free ones of ``pages`` (by falling area) or, where none is, among all."""

    def better(best: Column, p: Column) -> Column:
        error = F.least(F.abs(F.log(w / h / p["aspect"])), F.abs(F.log(h / w / p["aspect"])))
        found = F.struct(p["box"].alias("box"), error.alias("error"))
        return F.when(p["able"] & (best["box"].isNull() | (error < best["error"] - ASPECT_TIE)), found).otherwise(best)

    none = F.struct(F.lit(None).cast("int").alias("box"), F.lit(None).cast("double").alias("error"))
    free = F.filter(pages, lambda p: ~F.array_contains(used, p["box"]))
    return geometry.let(free, lambda some: F.aggregate(F.when(F.size(some) > 0, some).otherwise(pages), none, better))


#: Fixed value: a box narrower than this has collapsed.
SINGULAR_BOX = 1e-9


def assigned(islands_: DataFrame, boxes: DataFrame) -> DataFrame:
    """mesh, island, box, error: which page box each island lies on.

    islands_: mesh, island, x0, y0, x1, y1; boxes: mesh, box, x0, y0, x1, y1. A box is used once while there
    are some to spare, and shared when there are not. Islands that have collapsed, and meshes without a box, have no
    row; a page box of no width or height is as narrow as SINGULAR_BOX; boxes that lack a corner, or whose corners
    are the wrong way round, are nowhere.
    """
    c, columns = F.col, ["x0", "y0", "x1", "y1"]
    whole = " AND ".join(f"{k} IS NOT NULL AND NOT isnan({k})" for k in columns) + " AND x1 >= x0 AND y1 >= y0"
    some = lambda x: F.when(x == 0, F.lit(SINGULAR_BOX)).otherwise(x)
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    aspect = some(w / some(h))

    def by_size(t: DataFrame, key: str, *more: Column) -> DataFrame:
        own = t.select("mesh", c(key).cast("int").alias(key), *[c(k).cast("double").alias(k) for k in columns]).filter(whole)
        return own.select("mesh", F.struct((-w * h).alias("size"), key, *more).alias("row")).groupBy("mesh").agg(F.sort_array(F.collect_list("row")).alias(f"{key}s"))

    pages = by_size(boxes, "box", aspect.alias("aspect"), ((aspect > 0) & (aspect < math.inf)).alias("able"))
    laid = by_size(islands_, "island", w.alias("w"), h.alias("h")).join(pages, "mesh")
    kind = "struct<used:array<int>,out:array<struct<island:int,box:int,error:double>>>"
    begin = F.struct(F.array().alias("used"), F.array().alias("out")).cast(kind)

    def step(state: Column, i: Column) -> Column:
        def taken(got: Column) -> Column:
            row = F.struct(i["island"].alias("island"), got["box"].alias("box"), got["error"].alias("error"))
            return F.when(got["box"].isNotNull(), F.struct(F.array_union(state["used"], F.array(got["box"])).alias("used"), F.array_append(state["out"], row).alias("out"))).otherwise(state)

        return geometry.let(_choose(c("boxs"), i["w"], i["h"], state["used"]), taken)

    wide = F.filter("islands", lambda i: (i["w"] >= SINGULAR_BOX) & (i["h"] >= SINGULAR_BOX))
    return laid.select(c("mesh").cast("long").alias("mesh"), F.inline(F.aggregate(wide, begin, step, lambda state: state["out"])))


def collinear(points: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """key and whether all of its points (x, y) lie on a line: their covariance has no second direction."""
    per = points.groupBy(key).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return per.select(key, (det <= least * F.greatest(F.col("xx") * F.col("yy"), F.lit(least))).alias("collinear"))
