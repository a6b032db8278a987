"""Types of the tables that the rules read. A null means not measured or not applicable, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIE = "struct<colorant:string,origin_mm:array<double>,size_mm:array<double>,page_mm:array<double>,length_mm:double,contours:int,closed:boolean,filled:boolean,bare_perimeter:double>"
PLACEMENT = "struct<rect_mm:array<double>,dpi:double,area_fraction:double>"

FACTS = {
    "file_id": "string", "filename": "string", "page_mm": "array<double>", "measured_scale": "int", "pages": "int", "producer": "string", "creator": "string", "has_metadata": "boolean",
    "fonts": "array<string>", "shows_text": "boolean", "colour_spaces": "array<string>", "spot_names": "array<string>", "cut_spot": "string", "overprint": "boolean",
    "raster_alpha": "boolean", "raster_mode": "string", "declared_boxes_mm": "map<string,array<double>>", "blank_edges_mm": "array<double>", "bleed_shortfall": "struct<share:double,missing_mm:double>",
    "safe_intrusion_mm": "double", "safe_intrusion_regions_mm": "array<array<double>>", "min_dpi": "double", "image_placements": f"array<{PLACEMENT}>", "text_min_height_mm": "double",
    "guides_present": "boolean", "die": DIE, "named_size": "struct<w:double,h:double,stated:boolean>", "has_diacritics": "boolean", "extra_dots": "boolean",
}
EXPECTED = {"netto_mm": "array<double>", "brutto_mm": "array<double>", "bleed_mm": "double", "safe_mm": "double", "scale": "int", "strip_mm": "double"}
MATERIAL = {
    "id": "string", "name": "string", "bleed_mm": "double", "safe_mm": "double", "min_dpi": "double", "max_width_mm": "double", "panel_max_long_mm": "double", "panel_max_short_mm": "double",
    "finishing_mm": "double", "min_text_mm": "double", "colour": "string", "spec_position": "string", "cut_path": "boolean", "notes": "string",
}


def as_struct(df: DataFrame, fields: dict[str, str], prefix: str = "") -> Column:
    """The fields as one struct; those that df lacks (under the prefix) are null."""
    have = set(df.columns)
    return F.struct(*[(F.col(f"`{prefix}{n}`") if f"{prefix}{n}" in have else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
