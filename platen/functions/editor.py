"""The design editor's frame: elements (structs x, y, scale, rotation, width, height) placed on a canvas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import point

#: Fixed values in canvas pixels: a handle's reach, and how far above the element its turning handle sits; the least and the largest scale.
HANDLE_RADIUS, HANDLE_ABOVE, SMALLEST, LARGEST = 18.0, 44.0, 0.05, 20.0
#: A new picture covers this share of the canvas; a text's width a letter and its height, as shares of its size.
NEW_SHARE, LETTER_WIDTH, LINE_HEIGHT = 3.0, 0.6, 1.2


def local_point(e: Column, p: Column) -> Column:
    """A canvas point in the element's own frame: from its centre, turned back, at scale 1."""
    dx, dy = p["x"] - e["x"], p["y"] - e["y"]
    cos, sin = F.cos(-e["rotation"]), F.sin(-e["rotation"])
    return point((dx * cos - dy * sin) / e["scale"], (dx * sin + dy * cos) / e["scale"])


def canvas_point(e: Column, x: Column, y: Column) -> Column:
    """A point of the element's own frame on the canvas."""
    cos, sin = F.cos(e["rotation"]), F.sin(e["rotation"])
    return point(e["x"] + (x * cos - y * sin) * e["scale"], e["y"] + (x * sin + y * cos) * e["scale"])


def corners(e: Column) -> Column:
    """The four corners on the canvas, clockwise from the top left."""
    w, h = e["width"] / 2, e["height"] / 2
    return F.array(*[canvas_point(e, x, y) for x, y in ((-w, -h), (w, -h), (w, h), (-w, h))])


def bounds(e: Column) -> Column:
    """The upright box around the turned element, struct x0, y0, x1, y1."""
    cos, sin = F.abs(F.cos(e["rotation"])), F.abs(F.sin(e["rotation"]))
    w, h = (e["width"] * cos + e["height"] * sin) / 2 * e["scale"], (e["width"] * sin + e["height"] * cos) / 2 * e["scale"]
    return F.struct((e["x"] - w).alias("x0"), (e["y"] - h).alias("y0"), (e["x"] + w).alias("x1"), (e["y"] + h).alias("y1"))


def contains(e: Column, p: Column) -> Column:
    """The point lies within the turned box."""
    local = local_point(e, p)
    return (F.abs(local["x"]) <= e["width"] / 2) & (F.abs(local["y"]) <= e["height"] / 2)


def topmost(elements: Column, p: Column) -> Column:
    """The last element in drawing order under the point, or null."""
    under = F.filter(elements, lambda e: contains(e, p))
    return F.get(under, F.size(under) - 1)


def handle_at(e: Column, p: Column, zoom: Column | float = 1.0) -> Column:
    """Which handle the point grabs: rotate above the top edge, scale at the bottom right, or null."""
    reach = F.lit(HANDLE_RADIUS) / zoom
    far = lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    turn = canvas_point(e, F.lit(0.0), -e["height"] / 2 - F.lit(HANDLE_ABOVE) / e["scale"])
    return F.when(far(turn) <= reach, "rotate").when(far(canvas_point(e, e["width"] / 2, e["height"] / 2)) <= reach, "scale")


def dragged(e: Column, mode: Column, start: Column, current: Column) -> Column:
    """The element after a drag: moved, scaled about its centre within bounds, or turned by the angle swept."""
    far = lambda p: F.hypot(p["x"] - e["x"], p["y"] - e["y"])
    angle = lambda p: F.atan2(p["y"] - e["y"], p["x"] - e["x"])
    begin = F.when(far(start) == 0, 1.0).otherwise(far(start))
    moved = lambda k: F.when(mode == "move", e[k] + current[k] - start[k]).otherwise(e[k])
    scale = F.when(mode == "scale", F.least(F.lit(LARGEST), F.greatest(F.lit(SMALLEST), e["scale"] * far(current) / begin))).otherwise(e["scale"])
    turned = F.when(mode == "rotate", e["rotation"] + angle(current) - angle(start)).otherwise(e["rotation"])
    return F.struct(moved("x").alias("x"), moved("y").alias("y"), scale.alias("scale"), turned.alias("rotation"), e["width"].alias("width"), e["height"].alias("height"))


def held(e: Column, w: Column, h: Column) -> Column:
    """The element with its centre kept on the canvas."""
    kept = lambda k, most: F.least(most, F.greatest(F.lit(0.0), e[k])).alias(k)
    return F.struct(kept("x", w), kept("y", h), *[e[k].alias(k) for k in ("scale", "rotation", "width", "height")])


def new_image(width: Column, height: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """A picture centred on the canvas, at most a third of it wide and high."""
    scale = F.least(F.lit(1.0), canvas_w / NEW_SHARE / width, canvas_h / NEW_SHARE / height)
    return F.struct((canvas_w / 2).alias("x"), (canvas_h / 2).alias("y"), scale.alias("scale"), F.lit(0.0).alias("rotation"), width.alias("width"), height.alias("height"))


def new_text(text: Column, size: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """A text centred on the canvas, its width estimated."""
    return F.struct((canvas_w / 2).alias("x"), (canvas_h / 2).alias("y"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), (size * F.length(text) * LETTER_WIDTH).alias("width"), (size * LINE_HEIGHT).alias("height"))


def _is(kind: str):
    return lambda t: t == kind


def summary(types: Column, forms: dict[str, tuple[str, str, str]]) -> Column:
    """What a design holds: a count and its plural form for each type of ``forms``, in their order."""
    from ..operators.orders import plural

    counts = [(F.size(F.filter(types, _is(k))), own) for k, own in forms.items()]
    return F.array_join(F.array_compact(F.array(*[F.when(n > 0, plural(n, *own)) for n, own in counts])), ", ")


def placed(elements: Column, most: int = 40) -> Column:
    """The elements if every one can be drawn and there are at most so many, else none."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    def good(e: Column) -> Column:
        out = (e["width"] > 0) & (e["height"] > 0)
        for k in ("x", "y", "scale", "rotation", "width", "height"):
            out = out & finite(e[k])
        return F.coalesce(out, F.lit(False))

    return F.when((F.size(elements) > 0) & (F.size(elements) <= most) & F.forall(elements, good), elements).otherwise(F.slice(elements, 1, 0))
