"""Stamps: what a template writes into its page, what a returned file still says, and the geometry that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import SIDES, margins, scale_of, sewn

#: The stamp's version, what a token consists of, millimetres in a point of a page.
VERSION, TOKEN, MM = 1, "[A-Za-z0-9_-]{4,32}", 25.4 / 72
STAMP = "v int, template string, material string, netto_mm array<double>, page_mm array<double>, bleed_mm double, safe_mm double, scale int, label string, strip_mm double, sewn_sides_mm map<string,double>, safe_total_sides_mm map<string,double>, sides int"
#: The boxes a page may declare.
BOXES = ["mediabox", "cropbox", "bleedbox", "trimbox", "artbox"]


def identified(raw: Column, pages: Column, page: Column) -> Column:
    """struct(recognised, reason, stamp): the stamp on a page, or why there is none. raw: the page's text for it."""
    stamp = F.from_json(raw, STAMP)
    whole = F.try_parse_json(raw).isNotNull()
    reason = (
        F.when(pages.isNull(), "unreadable").when(page >= pages, "no such page").when(raw.isNull(), "no stamp").when(~whole, "damaged")
        .when(~F.coalesce(stamp["v"] == VERSION, F.lit(False)), "other version")
    )
    return F.struct(reason.isNull().alias("recognised"), F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNull(), stamp).alias("stamp"))


def printed_token(text: Column, mark: str) -> Column:
    """The token printed on the page behind the shop's mark and a colon, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"\Q{mark}\E:({TOKEN})", 1), F.lit(""))


def declared_boxes(raw: Column) -> Column:
    """name -> (width, height) in millimetres of the boxes that a page declares (name -> four numbers in points)."""
    known = F.map_filter(raw, lambda k, v: k.isin(BOXES) & (F.size(v) >= 4) & F.forall(F.slice(v, 1, 4), lambda x: x.isNotNull()))
    return F.transform_values(known, lambda k, v: F.array((F.get(v, F.lit(2)) - F.get(v, F.lit(0))) * MM, (F.get(v, F.lit(3)) - F.get(v, F.lit(1))) * MM))


def page_sizes(raw: Column) -> Column:
    """struct(declared, shown): the media box's size, and that of the crop box where there is one."""
    boxes = declared_boxes(raw)
    media, crop = F.try_element_at(boxes, F.lit("mediabox")), F.try_element_at(boxes, F.lit("cropbox"))
    return F.struct(media.alias("declared"), F.coalesce(crop, media).alias("shown"))


def geometry(stamp: Column) -> Column:
    """struct(netto_mm, brutto_mm, safe_mm_box, bleed_mm, safe_mm, scale, strip_mm) in full size, worked out anew from the stamp's numbers.

    A declared page, drawn to scale, beats finished size and bleed.
    """
    side = lambda c, k: F.get(stamp[c], F.lit(k))
    bleed, safe, scale = stamp["bleed_mm"], stamp["safe_mm"], scale_of(stamp["scale"])
    page = F.size(F.coalesce(stamp["page_mm"], F.array().cast("array<double>"))) > 0
    brutto = lambda k: F.when(page, side("page_mm", k) * scale).otherwise(side("netto_mm", k) + bleed * 2)
    return F.struct(
        stamp["netto_mm"].alias("netto_mm"), F.array(brutto(0), brutto(1)).alias("brutto_mm"), F.array(side("netto_mm", 0) - safe * 2, side("netto_mm", 1) - safe * 2).alias("safe_mm_box"),
        bleed.alias("bleed_mm"), safe.alias("safe_mm"), scale.alias("scale"), F.coalesce(stamp["strip_mm"], F.lit(0.0)).alias("strip_mm"),
    )


def item_payload(item: Column, material: Column, label: Column) -> Column:
    """The stamp of an item's template, as JSON; sizes with two decimals."""
    two = lambda c: F.bround(c, 2)
    fields = {"v": F.lit(VERSION), "material": material, "netto_mm": F.transform(item["netto_mm"], two), "bleed_mm": two(item["bleed_mm"]), "safe_mm": two(item["safe_mm"]), "scale": item["scale"], "label": label, "strip_mm": two(item["strip_mm"])}
    return F.to_json(F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)]))


def template_payloads(templates: DataFrame) -> DataFrame:
    """token, side, mirrored, stamp (JSON): a row for each printed side of each template, sizes in full.

    templates: token, name, material, page_mm, netto_mm (null: the page), bleed_mm, safe_mm, sewn_sides_mm,
    scale, sides, back_mirrored. The back of a flag is its front seen through the cloth, unless told otherwise.
    """
    from .templates import sides_of

    scale = scale_of(F.col("scale"))
    full = lambda c: F.bround(F.coalesce(c, F.lit(0.0)) * scale, 2)
    sides = sides_of(F.col("sides"))
    per_side = lambda of: F.create_map(*[x for s in SIDES for x in (F.lit(s), full(of(s)))])
    fields = {
        "v": F.lit(VERSION), "template": F.col("token").cast("string"), "material": F.coalesce("material", F.lit("")), "page_mm": F.transform("page_mm", lambda v: F.bround(v, 2)), "netto_mm": F.transform(F.coalesce("netto_mm", "page_mm"), lambda v: F.bround(v * scale, 2)),
        "bleed_mm": full(F.col("bleed_mm")), "safe_mm": full(F.col("safe_mm")), "sewn_sides_mm": per_side(lambda s: sewn(F.col("sewn_sides_mm"), s)), "safe_total_sides_mm": per_side(lambda s: margins(F.col("sewn_sides_mm"), F.col("safe_mm"), s)),
        "scale": scale, "label": F.coalesce("name", F.lit("")), "strip_mm": F.lit(0.0), "sides": sides,
    }
    stamp = F.to_json(F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)]))
    each = templates.select("token", stamp.alias("stamp"), F.coalesce("back_mirrored", F.lit(True)).alias("through"), F.explode(F.sequence(F.lit(1), sides)).alias("side"))
    return each.select("token", "side", ((F.col("side") == 2) & F.col("through")).alias("mirrored"), "stamp")
