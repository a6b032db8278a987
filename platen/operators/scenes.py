"""Classifiers of products and places: what a material is shown as, what carries a print, what a template's name says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values in millimetres: the largest print on a barrier, on a fence, on a billboard (both sides); a tunnel's least sewn side; what a family of names adds to its page.
BARRIER_MM, FENCE_MM, BILLBOARD_MM, TUNNEL_MM, NAMED_EXTRA_MM = 1000.0, 2000.0, (12_000.0, 4000.0), 60.0, 200.0


def carrier(w: Column, h: Column) -> Column:
    """What carries a print of a size: by its height a barrier or a fence, by both sides a billboard, else a frame."""
    return F.when(h <= BARRIER_MM, "barrier").when(h <= FENCE_MM, "fence").when((w <= BILLBOARD_MM[0]) & (h <= BILLBOARD_MM[1]), "billboard").otherwise("frame")


def carriers_needed(w: Column, panel: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(w / panel).cast("int"))


def finished_size(name: Column, kind: Column, trim_w: Column, trim_h: Column, page_w: Column, page_h: Column, scale: Column) -> Column:
    """struct(w, h) shown to customers: two families of names are known by their page, sheets and templates without a trim have none."""
    known = name.rlike(r"(?i)\b(vento|play)\b")
    size = lambda a, b: F.struct(a.alias("w"), b.alias("h"))
    return F.when(known, size(page_w - NAMED_EXTRA_MM, page_h - NAMED_EXTRA_MM)).when((kind != "sheet") & trim_w.isNotNull() & trim_h.isNotNull(), size(trim_w * scale, trim_h * scale))


def page_sized(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Both sides of an outline are the page's to a millimetre: a label, never a filter."""
    return F.coalesce((F.abs(w - page_w) <= 1.0) & (F.abs(h - page_h) <= 1.0), F.lit(False))


def painted(operator: Column) -> Column:
    """What a PDF's painting operator does to a path."""
    return F.when(operator.isin("S", "s"), "stroke").when(operator.isin("f", "F", "f*"), "fill").when(operator.isin("B", "B*", "b", "b*"), "both").when(operator.isin("W", "W*"), "clip").otherwise("none")


def first_hop(forwarded: Column, remote: Column) -> Column:
    """A client's address: the first of the forwarded ones, else the connection's."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), 1)), F.lit("")), remote)


def trace(events: Column, most: int = 20, length: int = 200) -> Column:
    """A client's events as they are logged: so many, each so long, white space folded."""
    return F.transform(F.slice(events, 1, most), lambda e: F.left(F.trim(F.regexp_replace(e, r"\s+", " ")), F.lit(length)))
