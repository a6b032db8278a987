"""Union, intersection and difference of polygons: small ones within tasks, large ones as joins over their edges.

Points lie on a grid of whole numbers, so that which side of an edge a point is on is exact. Edges meet others (where there
are many, on cells), are split where they cross, touch or overlap, and equal pieces become one. A piece lies on the border of
the result if what is just above it and what is just below differ in the result; what is above is told by the pieces
that a ray upwards meets. The pieces, with the result on their left, hang together as rings, which are named and put
in order by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..staging import staged

#: Coordinates stay below so many steps of the grid: products of differences then fit a long.
MOST = 1 << 30
#: An id of at most so many edges is small: it is done within a task, together with others up to about as many edges as the second says.
SMALL, TOGETHER = 32, 10_000

#: What each operation holds of what is inside of a and of b.
OPERATIONS = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "either": lambda a, b: a != b}

_ENDS = ["x0", "y0", "x1", "y1"]


def _sides(shapes: DataFrame, step: float) -> DataFrame:
    """id, side, sides: an array of the ring's edges on the grid (p, q: x, y), smaller end first."""
    at = lambda v: F.round(v / step).cast("long")
    points = F.transform(F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])), lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))
    edge = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    sides = let(points, lambda ps: F.transform(ps, lambda p, i: edge(p, F.get(ps, F.pmod(i + 1, F.size(ps))))))
    return shapes.filter("id IS NOT NULL AND side IN ('a', 'b')").select("id", "side", sides.alias("sides"))


def _each(rings: DataFrame) -> DataFrame:
    """id, side, x0, y0, x1, y1: the rings' edges; those from a point to itself are none."""
    c = F.col
    each = rings.select("id", "side", F.explode("sides").alias("e")).filter("e.p <> e.q")
    each = each.select("id", "side", c("e.p.x").alias("x0"), c("e.p.y").alias("y0"), c("e.q.x").alias("x1"), c("e.q.y").alias("y1"))
    inside = F.greatest(*[F.abs(x) for x in _ENDS]) < F.lit(MOST)
    return each.withColumn("x0", F.when(inside, c("x0")).otherwise(F.raise_error(F.lit("a point lies further out than the grid reaches: take a larger step"))))


def _edges(each: DataFrame) -> DataFrame:
    """id, a, b, x0, y0, x1, y1: each edge once, and whether it bounds a and b (an edge twice there is none)."""
    return each.groupBy("id", *_ENDS).agg(*[(F.count_if(F.col("side") == s) % 2 == 1).alias(s) for s in "ab"]).filter("a OR b")


def _turn(px, py, qx, qy, x, y):
    """Positive where (x, y) lies to the left of the way from p to q, 0 on its line; exact. Of columns or arrays."""
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def _split(edges: DataFrame) -> DataFrame:
    """The edges in pieces that meet nothing but at their ends (crossings are put on the grid, so nearly so: see ``overlaid``)."""
    c = F.col
    own = staged(edges.withColumn("e", F.monotonically_increasing_id()), "overlay-edges")
    size = own.groupBy("id").agg(F.greatest(F.ceil((F.greatest(F.max("x1") - F.min("x0"), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))) + 1) / F.greatest(F.sqrt(F.count(F.lit(1))), F.lit(1.0))), F.lit(1)).cast("long").alias("cell"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / c("cell")), F.floor(hi / c("cell"))))
    dealt = own.join(size, "id").withColumn("cx", cells(c("x0"), c("x1"))).withColumn("cy", cells(F.least("y0", "y1"), F.greatest("y0", "y1"))).select("id", "cx", "cy", "e", *_ENDS)
    other = dealt.select("id", "cx", "cy", c("e").alias("f"), *[c(k).alias(f"f{k}") for k in _ENDS])
    boxes = (c("x0") <= c("fx1")) & (c("fx0") <= c("x1")) & (F.least("y0", "y1") <= F.greatest("fy0", "fy1")) & (F.least("fy0", "fy1") <= F.greatest("y0", "y1"))
    met = dealt.join(other, ["id", "cx", "cy"]).filter((c("e") < c("f")) & boxes)
    met = met.select("id", "e", "f", *_ENDS, *[f"f{k}" for k in _ENDS]).distinct()
    e, f = (c("x0"), c("y0"), c("x1"), c("y1")), (c("fx0"), c("fy0"), c("fx1"), c("fy1"))
    met = met.withColumns({"d1": _turn(*f, *e[:2]), "d2": _turn(*f, *e[2:]), "d3": _turn(*e, *f[:2]), "d4": _turn(*e, *f[2:])})
    crossing = (F.signum("d1") * F.signum("d2") < 0) & (F.signum("d3") * F.signum("d4") < 0)
    t = c("d1").cast("double") / (c("d1").cast("double") - c("d2").cast("double"))
    at = [F.round(p + t * (q - p)).cast("long") for p, q in ((e[0], e[2]), (e[1], e[3]))]
    cut = lambda when, of, x, y: F.when(when, F.struct(of.alias("e"), x.alias("x"), y.alias("y")))
    within = lambda x, y, o: (x >= F.least(o[0], o[2])) & (x <= F.greatest(o[0], o[2])) & (y >= F.least(o[1], o[3])) & (y <= F.greatest(o[1], o[3]))
    cuts = [cut(crossing, c("e"), *at), cut(crossing, c("f"), *at)]
    cuts += [cut((c(d) == 0) & within(*p, o), c(n), *p) for d, p, o, n in (("d1", e[:2], f, "f"), ("d2", e[2:], f, "f"), ("d3", f[:2], e, "e"), ("d4", f[2:], e, "e"))]
    places = met.select("id", F.explode(F.array_compact(F.array(*cuts))).alias("cut")).select("id", "cut.*").groupBy("id", "e").agg(F.collect_set(F.struct("x", "y")).alias("places"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    along = lambda p: (p["x"] - c("x0")).cast("double") * (c("x1") - c("x0")) + (p["y"] - c("y0")).cast("double") * (c("y1") - c("y0"))
    all_ = F.array_distinct(F.concat(F.array(point("x0", "y0"), point("x1", "y1")), F.coalesce("places", F.array().cast("array<struct<x:bigint,y:bigint>>"))))
    order = F.array_sort(F.transform(all_, lambda p: F.struct(along(p).alias("at"), p["x"].alias("x"), p["y"].alias("y"))))
    pieces = let(order, lambda ps: F.transform(F.slice(ps, 2, F.size(ps)), lambda q, i: F.struct(F.get(ps, i).alias("p"), q.alias("q"))))
    row = own.join(places, ["id", "e"], "left").select("id", "a", "b", F.explode(pieces).alias("s"))
    xy = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    row = row.select("id", "a", "b", F.least(xy(c("s.p")), xy(c("s.q"))).alias("p"), F.greatest(xy(c("s.p")), xy(c("s.q"))).alias("q"))
    row = row.select("id", "a", "b", c("p.x").alias("x0"), c("p.y").alias("y0"), c("q.x").alias("x1"), c("q.y").alias("y1"))
    return row.groupBy("id", *_ENDS).agg(*[(F.count_if(s) % 2 == 1).alias(s) for s in "ab"]).filter("a OR b")


def _sided(pieces: DataFrame) -> DataFrame:
    """pieces with above_a and above_b: whether a and b hold what is just above a piece's middle (right of it, if it is upright)."""
    c = F.col
    own = staged(pieces.withColumn("e", F.monotonically_increasing_id()), "overlay-pieces")
    slab = own.groupBy("id").agg(F.greatest(F.ceil((F.max("x1") - F.min("x0") + 1) / F.count(F.lit(1))), F.lit(1)).cast("long").alias("slab"))
    sized = own.join(slab, "id")
    # halves count, so middles are on a grid of half steps; [x0, x1) holds a middle, so that ends count once
    rays = sized.select("id", "e", (c("x0") + c("x1")).alias("mx"), (c("y0") + c("y1")).alias("my"), F.floor((c("x0") + c("x1")) / (2 * c("slab"))).alias("s"))
    walls = sized.filter("x0 < x1").select("id", c("e").alias("f"), *[c(k).alias(f"f{k}") for k in _ENDS], c("a").alias("fa"), c("b").alias("fb"), F.explode(F.sequence(F.floor(c("x0") / c("slab")), F.floor(c("x1") / c("slab")))).alias("s"))
    over = (2 * c("fx0") <= c("mx")) & (c("mx") < 2 * c("fx1")) & (c("e") != c("f"))
    # the middle lies below the wall: its turn about the wall's way (to the right) is negative
    turn = (c("fx1") - c("fx0")).cast("double") * (c("my") - 2 * c("fy0")) - (c("fy1") - c("fy0")).cast("double") * (c("mx") - 2 * c("fx0"))
    hit = rays.join(walls, ["id", "s"]).filter(over & (turn < 0)).groupBy("id", "e").agg(F.count_if("fa").alias("na"), F.count_if("fb").alias("nb"))
    return own.join(hit, ["id", "e"], "left").withColumns({f"above_{s}": F.coalesce(c(f"n{s}"), F.lit(0)) % 2 == 1 for s in "ab"}).drop("na", "nb")


def _odd(rows: np.ndarray) -> np.ndarray:
    """Edges (part, x0, y0, x1, y1, a, b), in order and each once, with what it bounds an odd number of times; what bounds nothing goes."""
    rows = rows[:, np.lexsort(rows[4::-1])]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:5], axis=1) != 0).any(0)])[: rows.shape[1]])
    bounds = np.add.reduceat(rows[5:], new, axis=1) % 2 if len(new) else rows[5:]
    return np.concatenate([rows[:5, new], bounds])[:, bounds.any(0)]


def _beside(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges, in order, share an x with a later one of their part."""
    part, x0, _, x1 = rows[:4]
    at = np.arange(len(part))
    n = np.searchsorted((part << 32) + x0, (part << 32) + x1, side="right") - at - 1
    i = np.repeat(at, n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1


def _cut(rows: np.ndarray) -> np.ndarray:
    """``_split`` of many small parts at once."""
    i, j = _beside(rows)
    low, high = np.minimum(rows[2], rows[4]), np.maximum(rows[2], rows[4])
    meet = (low[i] <= high[j]) & (low[j] <= high[i])
    i, j = i[meet], j[meet]
    e, f = rows[1:5, i], rows[1:5, j]
    d1, d2, d3, d4 = _turn(*f, *e[:2]), _turn(*f, *e[2:]), _turn(*e, *f[:2]), _turn(*e, *f[2:])
    crossing = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
    one, other = d1[crossing].astype(float), d2[crossing].astype(float)
    at = e[:2, crossing] + one / (one - other) * (e[2:, crossing] - e[:2, crossing])
    at = (np.sign(at) * np.floor(np.abs(at) + 0.5)).astype(np.int64)
    cuts = [(i[crossing], *at), (j[crossing], *at)]
    for d, p, o, n in ((d1, e[:2], f, j), (d2, e[2:], f, j), (d3, f[:2], e, i), (d4, f[2:], e, i)):
        on = (d == 0) & (p[0] >= o[0]) & (p[0] <= o[2]) & (p[1] >= np.minimum(o[1], o[3])) & (p[1] <= np.maximum(o[1], o[3]))
        cuts.append((n[on], *p[:, on]))
    of, x, y = (np.concatenate(v) for v in zip(*cuts, strict=True))
    inner = ((x != rows[1, of]) | (y != rows[2, of])) & ((x != rows[3, of]) | (y != rows[4, of]))
    whole = np.ones(rows.shape[1], bool)
    whole[of[inner]] = False
    own = np.flatnonzero(~whole)
    if not len(own):
        return rows
    of, x, y = (np.concatenate(v) for v in ((own, own, of[inner]), (rows[1, own], rows[3, own], x[inner]), (rows[2, own], rows[4, own], y[inner])))
    along = (x - rows[1, of]).astype(float) * (rows[3, of] - rows[1, of]) + (y - rows[2, of]).astype(float) * (rows[4, of] - rows[2, of])
    places = np.stack([of, x, y])[:, np.lexsort((y, x, along, of))]
    go = (np.diff(places, axis=1) != 0).any(0) & (np.diff(places[0]) == 0)
    of, p, q = places[0, 1:][go], places[1:, :-1][:, go], places[1:, 1:][:, go]
    back = (p[0] > q[0]) | ((p[0] == q[0]) & (p[1] > q[1]))
    pieces = np.concatenate([rows[:1, of], np.where(back, q, p), np.where(back, p, q), rows[5:, of]])
    return _odd(np.concatenate([rows[:, whole], pieces], axis=1))


def _above(rows: np.ndarray) -> list[np.ndarray]:
    """above_a and above_b of ``_sided`` of many small parts at once."""
    e, f = (np.concatenate(v) for v in zip(_beside(rows), _beside(rows)[::-1], strict=True))
    mx, my = rows[1] + rows[3], rows[2] + rows[4]
    over = (2 * rows[1, f] <= mx[e]) & (mx[e] < 2 * rows[3, f])
    e, f = e[over], f[over]
    turn = (rows[3, f] - rows[1, f]).astype(float) * (my[e] - 2 * rows[2, f]) - (rows[4, f] - rows[2, f]).astype(float) * (mx[e] - 2 * rows[1, f])
    e, f = e[turn < 0], f[turn < 0]
    return [np.bincount(e[rows[k, f] == 1], minlength=rows.shape[1]) % 2 == 1 for k in (5, 6)]


def _within_tasks(passes: int):
    """Edges (id, side, x0, y0, x1, y1), those of an id one after the other, in; pieces as of ``_sided`` out, some ids at a time."""

    def found(held: pa.Table) -> pa.RecordBatch:
        ids = held.column(0).combine_chunks()
        ends = pc.run_end_encode(ids).run_ends.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        side = [pc.equal(held.column(1), s).to_numpy().astype(np.int64) for s in "ab"]
        rows = _odd(np.stack([np.repeat(np.arange(len(ends)), ends - starts), *[held.column(k).to_numpy() for k in range(2, 6)], *side]))
        for _ in range(passes):
            rows = _cut(rows)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(starts[rows[0]])), *map(pa.array, rows[1:5]), *[pa.array(v == 1) for v in rows[5:]], *map(pa.array, _above(rows))], ["id", *_ENDS, "a", "b", "above_a", "above_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = pa.Table.from_batches([batch.slice(k, TOGETHER)])
                held = some if held is None else pa.concat_tables([held, some])
                ends = pc.run_end_encode(held.column(0).combine_chunks()).run_ends
                if len(ends) > 1:  # the last id may go on
                    yield found(held.slice(0, ends[-2].as_py()))
                    held = held.slice(ends[-2].as_py())
        if held is not None:
            yield found(held)

    return run


def overlaid(shapes: DataFrame, step: float, passes: int = 2) -> DataFrame:
    """id, operation, x0, y0, x1, y1: the border of the union, intersection, difference and either-or of each id's shapes a and b,
    in edges with the result on their left.

    shapes: id, side (a or b), ring (array of points x, y); a shape is all points that an odd number of its rings
    encloses, so rings in rings are holes; rings close by themselves, points that lack a coordinate are none,
    a side without rings is empty, and rings without an id are none. ``step`` is the grid's: points and crossings move by half of it at
    most. As they do, a piece may touch another anew, so pieces are split once more (``passes``).

    The rings of an id of at most SMALL edges meet in a task, and nothing else of it is shuffled or written; of the others each edge is
    a row of joins.
    """
    rings_ = _sides(shapes, step)
    large = staged(shapes.groupBy("id").agg(F.sum(F.size("ring")).alias("n")).filter(F.col("n") > SMALL).select("id"), "overlay-large")
    some = bool(large.take(1))
    few = _each((rings_.join(large, "id", "left_anti") if some else rings_).repartition("id").sortWithinPartitions("id"))
    kind = shapes.schema["id"].dataType.simpleString()
    sided = few.mapInArrow(_within_tasks(passes), f"id {kind}, x0 long, y0 long, x1 long, y1 long, a boolean, b boolean, above_a boolean, above_b boolean")
    if some:
        edges = _edges(_each(rings_.join(large, "id", "left_semi")))
        for _ in range(passes):
            edges = _split(edges)
        sided = sided.unionByName(_sided(edges).select(*sided.columns))
    c, each = F.col, []
    for name, holds in OPERATIONS.items():
        above, below = holds(c("above_a"), c("above_b")), holds(c("above_a") != c("a"), c("above_b") != c("b"))
        each.append(F.struct(F.lit(name).alias("operation"), above.alias("above"), below.alias("below")))
    border = sided.select("id", *_ENDS, F.explode(F.array(*each)).alias("s")).select("id", *_ENDS, "s.*").filter("above <> below")
    # what is above lies to the left of the way to the right; of an upright piece, right was looked at
    keep = F.when(c("x0") == c("x1"), ~c("above")).otherwise(c("above"))
    ends = [F.when(keep, c(p)).otherwise(c(q)) * F.lit(step) for p, q in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    return border.select("id", "operation", *[v.alias(k) for v, k in zip(ends, _ENDS, strict=True)])


def areas(border: DataFrame) -> DataFrame:
    """id, operation, area, edges of what borders enclose (see ``overlaid``); holes don't count. Empty results have no row."""
    x0, y0, x1, y1 = (F.col(k) for k in _ENDS)
    # as borders are closed, the strips between edges and the axis add up to the area; they are as exact as the points themselves are
    return border.groupBy("id", "operation").agg((F.sum((x0 - x1) * (y0 + y1)) / 2).alias("area"), F.count(F.lit(1)).alias("edges"))


def rings(border: DataFrame) -> DataFrame:
    """id, operation, ring, nth, x, y, area: borders as closed rings, their points in order, and the area within (negative for holes).

    Where several edges begin, the one furthest to the left goes on, so rings that touch in a point are rings of
    their own. Both the ring an edge is on and its place there are found by doubling.
    """
    c, key = F.col, ["id", "operation"]
    edges = staged(border.withColumn("e", F.monotonically_increasing_id()), "ring-edges")
    begins = edges.select(*key, c("x0").alias("x1"), c("y0").alias("y1"), c("e").alias("next"), F.atan2(c("y1") - c("y0"), c("x1") - c("x0")).alias("to"))
    back = F.atan2(c("y0") - c("y1"), c("x0") - c("x1"))
    pi2 = F.lit(2.0) * F.pi()
    open_ = edges.withColumn("back", back).join(begins, [*key, "x1", "y1"])
    turn = F.pmod(c("back") - c("to"), pi2)  # how far from the way back, with the clock: the result lies between
    nexts = open_.groupBy(*key, "e").agg(F.min_by("next", F.when(turn < 1e-12, pi2).otherwise(turn)).alias("next"))
    state = staged(nexts.select("e", c("next").alias("to"), F.least("e", "next").alias("ring")), "ring-state")
    moved = True
    while moved:
        ahead = state.select(c("e").alias("to"), c("to").alias("then"), c("ring").alias("far"))
        after = staged(state.join(ahead, "to").select("e", c("then").alias("to"), F.least("ring", "far").alias("ring"), (c("far") < c("ring")).alias("less")), "ring-state")
        moved = bool(after.filter("less").take(1))
        state = after.drop("less")
    named = edges.join(nexts.select("e", "next"), "e").join(state.select("e", "ring"), "e")
    steps = staged(named.select("e", F.when(c("next") != c("ring"), c("next")).alias("to"), F.when(c("next") != c("ring"), 1).otherwise(0).cast("long").alias("left")), "ring-steps")
    while steps.filter("to IS NOT NULL").take(1):
        ahead = steps.select(c("e").alias("to"), c("to").alias("then"), c("left").alias("more"))
        steps = staged(steps.join(ahead, "to", "left").select("e", c("then").alias("to"), (c("left") + F.coalesce("more", F.lit(0))).alias("left")), "ring-steps")
    placed = named.join(steps.select("e", "left"), "e")
    per = Window.partitionBy(*key, "ring")
    area = F.sum(c("x0") * c("y1") - c("x1") * c("y0")).over(per) / 2
    out = placed.select(*key, "ring", "left", c("x0").alias("x"), c("y0").alias("y"), area.alias("area"), F.max("left").over(per).alias("most"))
    return out.select(*key, "ring", (c("most") - c("left")).alias("nth"), "x", "y", "area")
