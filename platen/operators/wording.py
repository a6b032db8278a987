"""Default sentences of findings and notices, in English; a shop's own table (code, template) overrides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The codes of rules and notices, each with a sentence of our own.
DEFAULTS = {
    "check.page_size.ok": "Page size fits: {page_w}×{page_h} mm",
    "check.page_size.rotated": "The page is turned",
    "check.page_size.rotated.detail": "Ordered {expected_w}×{expected_h} mm, received {page_w}×{page_h} mm.",
    "check.page_size.scaled": "Drawn at 1:{scale}",
    "check.page_size.no_bleed": "Finished size without bleed: {page_w}×{page_h} mm",
    "check.page_size.no_bleed.detail": "{bleed} mm of bleed a side make {expected_w}×{expected_h} mm.",
    "check.page_size.with_bleed": "Finished size and bleed: {page_w}×{page_h} mm",
    "check.page_size.two_up": "Two sides in one file: {page_w}×{page_h} mm",
    "check.page_size.finishing": "Size with an allowance for finishing: {page_w}×{page_h} mm",
    "check.page_size.oversize": "Far larger than ordered: {page_w}×{page_h} mm",
    "check.page_size.wrong": "Wrong page size",
    "check.page_size.wrong.detail": "Ordered {expected_w}×{expected_h} mm, received {page_w}×{page_h} mm.",
    "check.declared_trim.ok": "Declared trim fits: {trim_w}×{trim_h} mm",
    "check.declared_trim.rotated": "Declared trim is turned",
    "check.declared_trim.wrong": "Declared trim {trim_w}×{trim_h} mm instead of {expected_w}×{expected_h} mm",
    "check.template_guides.ok": "No guides left",
    "check.template_guides.present": "Guides of the template are still there",
    "check.bleed_coverage.ok": "Artwork reaches the bleed",
    "check.bleed_coverage.short": "Artwork ends {missing} mm short of the bleed",
    "check.bleed_coverage.unmeasured": "Bleed not measured",
    "check.safe_area.ok": "Safe area kept free",
    "check.safe_area.intrusion": "Content reaches {intrusion} mm into the safe margin of {safe} mm",
    "check.safe_area.unmeasured": "Safe area not measured",
    "check.resolution.ok": "Resolution {dpi} DPI",
    "check.resolution.low": "Resolution {dpi} DPI, at least {floor} needed",
    "check.resolution.unmeasured": "Resolution not measured",
    "check.office_origin.office": "Made with an office program ({application})",
    "check.colour_mode.ok": "CMYK",
    "check.colour_mode.rgb": "RGB colours ({spaces})",
    "check.colour_mode.icc": "Colours by an ICC profile",
    "check.spot_inks.found": "Extra inks: {inks}",
    "check.cut_path.ok": "Cut path found ({cut})",
    "check.cut_path.missing": "No cut path found",
    "check.cut_geometry.ok": "Cut path {cut}: {cut_w}×{cut_h} mm",
    "check.cut_geometry.ok.detail": "{length} of cutting in {contours} contours.",
    "check.cut_geometry.filled": "Cut path {cut} is filled",
    "check.cut_geometry.open": "Cut path {cut} is open",
    "check.cut_margins.ok": "Artwork goes beyond the cut",
    "check.cut_margins.bare": "No artwork beyond the cut on {share} of it",
    "check.cut_margins.off_sheet": "Cut path leaves the sheet ({sides})",
    "check.cut_margins.tight": "Too little sheet beyond the cut ({sides})",
    "check.cut_margins.unmeasured": "Artwork around the cut not measured",
    "check.raster_flat.ok": "Flattened",
    "check.raster_flat.layers": "Not flattened ({mode})",
    "check.fonts.ok": "No live text",
    "check.fonts.present": "Live text",
    "check.fonts.present.detail": "Fonts: {fonts}.",
    "check.overprint.on": "Overprint is on",
    "check.page_count.many": "{pages} pages",
    "check.page_count.cut_work": "{pages} pages, as cut work has",
    "check.text_height.ok": "Smallest text {smallest} mm",
    "check.text_height.small": "Text of {smallest} mm, at least {floor} mm needed",
    "check.split.required": "{netto_w}×{netto_h} mm is printed in strips",
    "check.named_size.ok": "The name's size fits: {named_w}×{named_h} mm",
    "check.named_size.differs": "The name says {named_w}×{named_h} mm, the order {netto_w}×{netto_h} mm",
    "check.filename.diacritics": "The name has diacritics",
    "check.filename.dots": "The name has more than one dot",
    "check.rule.failed": "A rule couldn't be checked",
    "check.rule.failed.detail": "{error}",
}


#: Notices that are advice.
ADVICE = ["panelled", "scaled"]
#: Up to so many of a shop's sentences are broadcast, after they were counted.
BROADCAST_TEXTS = 100_000


def defaults(spark: SparkSession, wording: DataFrame | None = None) -> DataFrame:
    """code, template: the shop's where it has one that isn't empty, else the default."""
    own = spark.createDataFrame(list(DEFAULTS.items()), "code string, template string")
    if wording is None:
        return own
    theirs = wording.select("code", F.col("template").alias("theirs")).filter(F.coalesce("theirs", F.lit("")) != "")
    return own.join(theirs, "code", "full").select("code", F.coalesce("theirs", "template").alias("template"))


def label(template: Column) -> Column:
    """A rule's label: its describing sentence with every placeholder elided."""
    return F.regexp_replace(template, r"\{[^}]*\}", "…")


def level(code: Column) -> Column:
    """Whether a notice is advice or a problem."""
    return F.when(code.isin(ADVICE), "info").otherwise("error")


def rendered(notices: DataFrame, wording: DataFrame | None = None) -> DataFrame:
    """notices (code, values) and text, label, level, optional: a code without a sentence stands for itself, but is null in optional."""
    from .rules import render

    texts = defaults(notices.sparkSession, wording).select(F.col("code").alias("text_code"), "template")
    texts = F.broadcast(texts) if wording is None or wording.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else texts
    found = notices.join(texts, notices["code"] == texts["text_code"], "left")
    text = F.coalesce("template", "code")
    return found.select(*notices.columns, render(text, F.col("values")).alias("text"), label(text).alias("label"), level(F.col("code")).alias("level"), F.when(F.col("template").isNotNull(), render(text, F.col("values"))).alias("optional"))
