"""What a file's resources declare: colour spaces, colorants, fonts, and where pictures land at what resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import SIGNIFICANT_AREA, set_number

#: What the components of an ICC profile mean; colorants that stand for no ink; points of an inch.
ICC, NO_INK, INCH_PT = {1: "Gray", 3: "RGB", 4: "CMYK"}, ["All", "None"], 72.0


def decoded_name(raw: Column) -> Column:
    """A PDF name with its #xx read as characters; a # without two hex digits stays."""
    pieces = F.split(raw, "#")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("long")), F.substring(p, 3, 1_000_000))).otherwise(F.concat(F.lit("#"), p)))
    return F.when(F.size(pieces) > 1, F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(raw)


def colour_space(space: Column) -> Column:
    """struct(mode, spots) of a space (struct family, components, colorants and base: another such struct, of an Indexed one).

    A separation's colorants are spots and no mode; an indexed space is what it is based on.
    """

    def one(s: Column) -> tuple[Column, Column]:
        spot = s["family"].isin("Separation", "DeviceN")
        names = F.filter(F.transform(F.coalesce(s["colorants"], F.array().cast("array<string>")), decoded_name), lambda n: ~n.isin(NO_INK))
        icc = F.coalesce(F.concat(F.lit("ICCBased("), F.get(F.array(*[F.lit(ICC.get(k)) for k in range(5)]), s["components"]), F.lit(")")), F.lit("ICCBased"))
        return F.when(~spot, F.when(s["family"] == "ICCBased", icc).otherwise(s["family"])), F.when(spot, names).otherwise(F.array().cast("array<string>"))

    mode, spots = one(space)
    base_mode, base_spots = one(space["base"])
    indexed = (space["family"] == "Indexed") & space["base"].isNotNull()
    return F.struct(F.when(indexed, base_mode).otherwise(mode).alias("mode"), F.when(indexed, base_spots).otherwise(spots).alias("spots"))


def declared(resources: DataFrame) -> DataFrame:
    """file_id, fonts, colour_spaces, spot_names (sorted, each once), overprint, shows_text: all pages' resources together.

    resources: file_id, font, space (see colour_space), overprint, shows_text; nulls where a row has none.
    """
    found = resources.withColumn("found", F.when(F.col("space").isNotNull(), colour_space(F.col("space"))))
    once = lambda c: F.array_sort(F.collect_set(c))
    spots = F.array_sort(F.array_distinct(F.flatten(F.collect_set("found.spots"))))
    return found.groupBy("file_id").agg(once("font").alias("fonts"), once("found.mode").alias("colour_spaces"), spots.alias("spot_names"), F.coalesce(F.bool_or("overprint"), F.lit(False)).alias("overprint"), F.coalesce(F.bool_or("shows_text"), F.lit(False)).alias("shows_text"))


def described(px_w: Column, px_h: Column, ctm: Column, page_area_pt: Column) -> Column:
    """struct(placed_w, placed_h, dpi, area_fraction, x0, y0, x1, y1) of a picture under a matrix (struct a to f); null if it has no extent.

    Its size comes from the matrix's columns, not from a box, so turned pictures keep their sides; dpi is
    that of the worse axis; the box, in points, is that of the four corners.
    """
    w, h = F.hypot(ctm["a"], ctm["b"]), F.hypot(ctm["c"], ctm["d"])
    xs, ys = (F.array(ctm[o], ctm[p] + ctm[o], ctm[q] + ctm[o], ctm[p] + ctm[q] + ctm[o]) for o, p, q in (("e", "a", "c"), ("f", "b", "d")))
    dpi = F.rint(F.least(px_w / (w / INCH_PT), px_h / (h / INCH_PT)))
    share = F.when(page_area_pt > 0, w * h / page_area_pt).otherwise(0.0)
    return F.when(F.least(px_w, px_h, w, h) > 0, F.struct(F.bround(w * 25.4 / INCH_PT, 1).alias("placed_w"), F.bround(h * 25.4 / INCH_PT, 1).alias("placed_h"), dpi.alias("dpi"), share.alias("area_fraction"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def significant(placed: DataFrame, key: str = "file_id") -> DataFrame:
    """The placements (key, area_fraction) large enough to judge a file by; all of a file's where none is."""
    large = F.col("area_fraction") >= SIGNIFICANT_AREA
    some = F.max(large).over(Window.partitionBy(key))
    return placed.withColumn("some_large", some).filter(large | ~F.coalesce("some_large", F.lit(False))).drop("some_large")


def least_dpi(placed: DataFrame, key: str = "file_id") -> DataFrame:
    """key, min_dpi over the significant placements, worked out in one aggregation."""
    large = F.col("area_fraction") >= SIGNIFICANT_AREA
    return placed.groupBy(key).agg(F.coalesce(F.min(F.when(large, F.col("dpi"))), F.min("dpi")).alias("min_dpi"))


def full_size_dpi(dpi: Column, scale: Column) -> Column:
    """A resolution read off the page, at the size that is printed."""
    n = F.coalesce(set_number(scale), F.lit(1))
    return F.when(n == 1, dpi).otherwise(F.bround(dpi / n, 1))
