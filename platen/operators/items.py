"""Ordered items: dimensions as typed, scales, panels, and the geometry a template and a check both read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import panel_count, set_number

#: Fixed values in millimetres but for the scales.
SCALES, PAGE_CEILING_MM, SPEC_STRIP_MM, MARGIN_SPEC_MM, LARGEST_MM = [1, 2, 4, 5, 10, 20], 4800.0, 22.0, 12.0, 100_000.0
PANEL_LONG_MM, PANEL_SHORT_MM = 25_000.0, 15_000.0
#: A shop's list of materials is read on the driver; it has at most so many.
MATERIALS = 1_000


def parsed_dimension(value: Column, unit: Column) -> Column:
    """struct(mm, problem): comma or point, blanks anywhere, mm, cm or m. NaN is refused as no number."""
    text = F.replace(F.replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    kind = F.lower(F.trim(F.coalesce(unit, F.lit("mm"))))
    mm = number * F.when(kind == "mm", 1.0).when(kind == "cm", 10.0).when(kind == "m", 1000.0)
    problem = F.when(text == "", "dimensions_required").when(number.isNull(), "not_a_number").when(number <= 0, "must_be_positive").when(mm.isNull(), "unknown_unit").when(mm > LARGEST_MM, "absurd_dimension")
    return F.struct(F.when(problem.isNull(), mm).alias("mm"), problem.alias("problem"))


def chosen_scale(w: Column, h: Column) -> Column:
    """The first of the usual scales at which the longer side fits a page, or null."""
    return F.get(F.filter(F.array(*map(F.lit, SCALES)), lambda s: F.greatest(w, h) / s <= PAGE_CEILING_MM), F.lit(0))


def resolved(df: DataFrame, material: str = "material", width: str = "width_mm", height: str = "height_mm", scale: str | None = None) -> DataFrame:
    """df and item: struct(problem, scale, netto_mm, brutto_mm, safe_mm_box, bleed_mm, safe_mm, panels, spec_position, strip_mm, notices).

    One row per item whatever is wrong with it: the first problem in the order of the checks, or null.
    """
    m, w, h = (lambda n: F.col(f"{material}.{n}")), F.col(width), F.col(height)
    bleed, safe = F.coalesce(m("bleed_mm"), F.lit(0.0)), F.coalesce(m("safe_mm"), F.lit(0.0))
    panels = panel_count(w, h, bleed, m("max_width_mm"))
    long_, short = F.greatest(w, h) + bleed * 2, F.least(w, h) + bleed * 2
    too_big = (panels > 1) & ((long_ > F.coalesce(set_number(m("panel_max_long_mm")), F.lit(PANEL_LONG_MM))) | (short > F.coalesce(set_number(m("panel_max_short_mm")), F.lit(PANEL_SHORT_MM))))
    own = F.col(scale).cast("int") if scale else F.lit(None).cast("int")
    used = F.coalesce(own, chosen_scale(w + bleed * 2, h + bleed * 2))
    problem = (
        F.when(m("id").isNull(), "unknown_material")
        .when(~F.coalesce((w > 0) & (h > 0), F.lit(False)), "must_be_positive")
        .when(safe * 2 >= F.least(w, h), "safe_area_eats_job")
        .when(too_big, "too_big_to_panel")
        .when(own < 1, "not_a_number")
        .when(used.isNull(), "too_big_for_pdf")
    )
    position = F.coalesce(F.nullif(m("spec_position"), F.lit("")), F.lit("panel"))
    position = F.when((position == "margin") & (bleed < MARGIN_SPEC_MM), "below").otherwise(position)
    notices = F.array_compact(F.array(F.when(panels > 1, "panelled"), F.when(used != 1, "scaled")))
    fields = {
        "scale": used, "netto_mm": F.array(w, h), "brutto_mm": F.array(w + bleed * 2, h + bleed * 2), "safe_mm_box": F.array(w - safe * 2, h - safe * 2), "bleed_mm": bleed, "safe_mm": safe,
        "panels": panels, "spec_position": position, "strip_mm": F.when(position == "below", SPEC_STRIP_MM).otherwise(0.0), "notices": notices,
    }
    return df.withColumn("item", F.struct(problem.alias("problem"), *[F.when(problem.isNull(), c).alias(n) for n, c in fields.items()]))


def page_size(item: Column) -> Column:
    """The page: the scaled artwork and, unscaled, the strip below it."""
    return F.array(F.get(item["brutto_mm"], F.lit(0)) / item["scale"], F.get(item["brutto_mm"], F.lit(1)) / item["scale"] + item["strip_mm"])


def answers_for_page(pages: DataFrame, materials: DataFrame, netto: DataFrame, tolerance_mm: float = 0.5) -> DataFrame:
    """Every (material, finished size) whose artwork has a page's size: all answers, never a pick.

    pages: page_id, w, h; netto: netto_w, netto_h; materials: a shop's list of at most MATERIALS (id,
    bleed_mm). Each page is held against each material's bleed, and what is left meets the finished sizes on a
    grid of twice the tolerance, so that the join has keys to be dealt by.
    """
    shop = materials.select("id", F.col("bleed_mm").cast("double").alias("bleed_mm")).limit(MATERIALS + 1).collect()
    if len(shop) > MATERIALS:
        raise ValueError(f"more than {MATERIALS} materials: no shop's list")
    cell = tolerance_mm * 2
    list_ = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["bleed_mm"]).alias("bleed_mm")) for r in shop]) if shop else F.array().cast("array<struct<id:string,bleed_mm:double>>")
    asked = pages.select("page_id", "w", "h", F.explode(list_).alias("m")).select("page_id", "m.id", (F.col("w") - 2 * F.col("m.bleed_mm")).alias("left_w"), (F.col("h") - 2 * F.col("m.bleed_mm")).alias("left_h"))
    near = lambda c: F.explode(F.array(*[F.floor(F.col(c) / cell) + d for d in (-1, 0, 1)]))
    spread = asked.withColumn("cx", near("left_w")).withColumn("cy", near("left_h"))
    jobs = netto.withColumns({"cx": F.floor(F.col("netto_w") / cell), "cy": F.floor(F.col("netto_h") / cell)})
    return spread.join(jobs, ["cx", "cy"]).filter((F.abs(F.col("left_w") - F.col("netto_w")) <= tolerance_mm) & (F.abs(F.col("left_h") - F.col("netto_h")) <= tolerance_mm)).select("page_id", "id", "netto_w", "netto_h")


def eyelets(length: Column, pitch: Column) -> Column:
    """Positions along a side: both corners, and evenly between them no further apart than the pitch."""
    gaps = F.greatest(F.lit(1), F.ceil(length / pitch)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), gaps), lambda i: F.bround(length * i / gaps, 3)))


def seams(width: Column, roll: Column) -> Column:
    """Where strips meet: multiples of the roll's width short of the far edge by more than a millimetre."""
    n = F.greatest(F.ceil((width - 1) / roll).cast("int") - 1, F.lit(0))
    return F.when((roll > 0) & (n > 0), F.transform(F.sequence(F.lit(1), n), lambda i: roll * i)).otherwise(F.array().cast("array<double>"))
