"""Polygon overlays against a sweep over slabs."""

import math
import random
from collections import defaultdict

import pytest

from platen.operators import overlay


def swept(a, b, holds):
    """The area of holds(inside a, inside b): between neighbouring xs of ends and crossings, edges are straight and don't cross."""
    edges = [(p, q, s) for s, rings in ((0, a), (1, b)) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True) if p != q]
    xs = {p[0] for p, _, _ in edges}
    for i, (p, q, _) in enumerate(edges):
        for r, s, _ in edges[:i]:
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 <= t <= 1:
                    xs.add(p[0] + t * (q[0] - p[0]))
    xs, area = sorted(xs), 0.0
    for left, right in zip(xs, xs[1:], strict=False):
        m = (left + right) / 2
        cut = sorted((p[1] + (m - p[0]) / (q[0] - p[0]) * (q[1] - p[1]), s) for p, q, s in edges if min(p[0], q[0]) < m < max(p[0], q[0]))
        inside = [False, False]
        for (y, s), (up, _) in zip(cut, cut[1:], strict=False):
            inside[s] = not inside[s]
            area += (right - left) * (up - y) * bool(holds(*inside))
    return area


HOLDS = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "either": lambda a, b: a != b}


def star(rng, x, y, size, n):
    return [(round(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), 3), round(y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n), 3)) for i in range(n)]


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(6)
    out = [
        ([box(0, 0, 10, 10)], [box(5, 5, 15, 15)]),
        ([box(0, 0, 10, 10)], [box(10, 0, 20, 10)]),  # a shared edge
        ([box(0, 0, 10, 10)], [box(10, 10, 20, 20)]),  # a shared corner
        ([box(0, 0, 10, 10)], [box(0, 0, 10, 10)]),  # the same
        ([box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(2, 2, 8, 8)]),  # a filled hole
        ([box(0, 0, 10, 10), box(2, 2, 8, 8), box(4, 4, 6, 6)], [box(3, 0, 5, 20)]),  # an island in a hole
        ([box(0, 0, 10, 10)], [box(2, 0, 8, 10)]),  # part of two edges
        ([box(0, 0, 10, 10)], []),
        ([], [box(0, 0, 1, 1)]),
        ([[(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]], [box(4, -1, 6, 11)]),  # crosses itself
        ([box(0, 0, 5, 5) + [(0.0, 0.0)]], [box(1, 1, 2, 2), box(1, 1, 2, 2)]),  # closed; a ring twice
        ([[(0.0, 0.0), (1.0, 1.0)]], [[(3.0, 3.0)], []]),  # nothing inside
    ]
    out += [([star(rng, 0, 0, 50, rng.randrange(3, 30))], [star(rng, rng.uniform(-40, 40), rng.uniform(-40, 40), 40, rng.randrange(3, 30))]) for _ in range(25)]
    out += [([star(rng, 0, 0, 60, 40), star(rng, 0, 0, 15, 12)], [star(rng, 5, 5, 45, 50), box(-10, -10, 10, 10)]) for _ in range(8)]
    return out


def frame(spark, cases):
    rows = [(i, s, r) for i, case in enumerate(cases) for s, rings in zip("ab", case, strict=True) for r in rings]
    return spark.createDataFrame(rows, "id long, side string, ring array<struct<x: double, y: double>>")


def test_areas_by_sweep(spark, cases):
    border = overlay.overlaid(frame(spark, cases), 1e-6)
    got = defaultdict(float, {(r["id"], r["operation"]): r["area"] for r in overlay.areas(border).collect()})
    for i, (a, b) in enumerate(cases):
        for name, holds in HOLDS.items():
            assert got[i, name] == pytest.approx(swept(a, b, holds), abs=1e-3), (i, name)
        one, other = swept(a, [], HOLDS["union"]), swept([], b, HOLDS["union"])
        assert one + other == pytest.approx(got[i, "union"] + got[i, "intersection"], abs=1e-3)


def test_rings_are_closed_and_in_order(spark, cases):
    some = cases[:12] + cases[12:20:2] + cases[-2:]
    border = overlay.overlaid(frame(spark, some), 1e-6)
    edges = defaultdict(set)
    for r in border.collect():
        edges[r["id"], r["operation"]].add((r["x0"], r["y0"], r["x1"], r["y1"]))
    rings, area = defaultdict(list), {}
    for r in overlay.rings(border).orderBy("nth").collect():
        rings[r["id"], r["operation"], r["ring"]].append((r["x"], r["y"]))
        area[r["id"], r["operation"], r["ring"]] = r["area"]
    walked = defaultdict(set)
    for key, points in rings.items():
        walked[key[:2]] |= {(*p, *q) for p, q in zip(points, points[1:] + points[:1], strict=True)}
        assert area[key] == pytest.approx(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2)
    assert walked == edges
    count = lambda i, name: sorted(round(v, 6) for k, v in area.items() if k[:2] == (i, name))
    assert count(0, "intersection") == [25] and count(0, "difference") == [75] and count(1, "union") == [200] and count(3, "difference") == []
    assert count(4, "union") == [100] and count(4, "difference") == [-36, 100] and count(2, "union") == [100, 100] and count(5, "difference")[-1] > 0
    assert overlay.rings(border.limit(0)).count() == 0


def test_small_shapes_within_tasks_as_by_joins(spark, cases, monkeypatch):
    """Shapes of few edges aren't joined; what they come to is what joins make of them, also where an id goes on in the next batch."""
    shapes = frame(spark, cases)
    monkeypatch.setattr(overlay, "TOGETHER", 50)
    rows = lambda border: sorted((r["id"], r["operation"], *[round(r[k], 5) for k in ("x0", "y0", "x1", "y1")]) for r in border.collect())
    monkeypatch.setattr(overlay, "SMALL", 0)
    joined = rows(overlay.overlaid(shapes, 1e-3))
    monkeypatch.setattr(overlay, "SMALL", 1000)
    within = overlay.overlaid(shapes, 1e-3)
    assert rows(within) == joined and len(joined) > 1000
    plan = overlay.overlaid(shapes, 1e-3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    lacking = shapes.selectExpr("cast(null as long) AS id", "side", "ring").unionByName(shapes.filter("id = 0"))
    assert {r["id"] for r in overlay.overlaid(lacking, 1e-3).collect()} == {0}
    far = spark.createDataFrame([(1, "a", [(8e5 + x, 8e5 + y) for x, y in box(0, 0, 0.01, 0.01)])], "id long, side string, ring array<struct<x: double, y: double>>")
    assert overlay.areas(overlay.overlaid(far, 1e-3)).filter("operation = 'union'").first()["area"] == pytest.approx(1e-4, rel=1e-5)
