"""The rule queries on derived files, and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from . import derived

#: A shop's severities: one rule is softened, one silenced, one sharpened.
LEVELS = [("fonts", "info"), ("overprint", "off"), ("page_count", "red")]


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "rule_id string, level string")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all findings of all derived files under a shop's severities, worst first."""
    return rules.judge(derived.cases(spark, sf_dir), _levels(spark), columns=("place", "id", "level", "code"))


def finding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers behind the findings about bleed, text and margins, as they are printed."""
    found = rules.judge(derived.cases(spark, sf_dir), columns=("code", "values")).filter(F.col("code").isin("check.bleed_coverage.short", "check.text_height.small", "check.safe_area.intrusion"))
    value = lambda k: F.try_element_at("values", F.lit(k))
    return found.select("file_id", "code", F.coalesce(value("missing"), value("smallest"), value("intrusion")).alias("measured"), F.coalesce(value("bleed"), value("floor"), value("safe")).alias("wanted"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derived file's verdict, and how many findings make it."""
    return rules.summarise(derived.cases(spark, sf_dir), _levels(spark)).select("file_id", "verdict", "count")


def _same(a: str, b: str) -> str:
    return f"abs({a} - ({b})) <= greatest(0.5, ({b}) * 0.001)"


def _size(w: str, h: str, ww: str, hh: str) -> str:
    return f"({_same(w, ww)} AND {_same(h, hh)})"


def _either(ww: str, hh: str) -> str:
    return f"({_size('pw', 'ph', ww, hh)} OR {_size('ph', 'pw', ww, hh)})"


def _page_size() -> str:
    over = lambda w, h: f"({w} - bw BETWEEN 0 AND allow AND {h} - bh BETWEEN 0 AND allow)"
    near = lambda w, h: f"greatest(abs(ln(({w}) / bw)), abs(ln(({h}) / bh))) <= ln(2.0)"
    halves = " OR ".join(f"(({over(a, b)} OR {over(b, a)}) AND ({near(a, b)} OR {near(b, a)}))" for a, b in (("pw / 2", "ph"), ("pw", "ph / 2")))
    window = lambda w, h: f"CASE WHEN {w} - nw BETWEEN -0.5 AND 2 * mat_bleed + 0.5 AND {h} - nh BETWEEN -0.5 AND 2 * mat_bleed + 0.5 THEN greatest(0, least({w} - nw, {h} - nh)) END"
    grown = f"coalesce({window('pw', 'ph')}, {window('ph', 'pw')})"
    scaled = " OR ".join(_either(f"bw / {n}", f"bh / {n}") for n in range(2, 11))
    return f"""CASE WHEN {_size("pw", "ph", "bw", "bh + strip")} OR {_size("pw", "ph", "bw", "bh")} THEN 'green:ok'
        WHEN {_size("ph", "pw", "bw", "bh + strip")} OR {_size("ph", "pw", "bw", "bh")} THEN 'amber:rotated'
        WHEN {scaled} THEN 'info:scaled'
        WHEN mat_bleed > 0 AND {_either("nw", "nh")} THEN 'amber:no_bleed'
        WHEN mat_cut AND mat_bleed > 0 AND {grown} < 1 THEN 'amber:no_bleed'
        WHEN mat_cut AND mat_bleed > 0 AND {grown} IS NOT NULL THEN 'green:with_bleed'
        WHEN {halves} THEN 'red:two_up'
        WHEN NOT mat_cut AND ({over("pw", "ph")} OR {over("ph", "pw")}) THEN 'green:finishing'
        WHEN NOT mat_cut AND ((pw >= bw AND ph >= bh) OR (pw >= bh AND ph >= bw)) THEN 'amber:oversize'
        ELSE 'red:wrong' END"""


_CASES = f"""
WITH files AS ({derived.FILES_SQL}),
t AS (
    SELECT *, concat_ws('-', ok, ln, pk, sk) AS file_id, CASE WHEN mat_spec = 'below' THEN 22.0 ELSE 0.0 END AS strip, coalesce(mat_finishing, 500.0) AS allow,
        CASE WHEN kind = 3 THEN 10 ELSE 1 END AS sc, mat_cut AND sk % 4 <> 0 AS has_die,
        CASE WHEN pk % 3 = 0 THEN CASE WHEN disc <= 0.06 THEN 0.0 ELSE tax * 150 END WHEN pk % 10 <> 0 THEN greatest(tax * 200, 0.0, disc * 100, 0.25) END AS worst,
        CASE WHEN pk % 7 <> 0 THEN qty / 2 END AS smallest, coalesce(mat_text, 10.0) AS floor,
        mat_bleed * (sk % 3) * (CASE WHEN kind = 3 THEN 10 ELSE 1 END) AS gap_l, 3.0 * (CASE WHEN kind = 3 THEN 10 ELSE 1 END) AS gap_t,
        (bw - mat_bleed * (sk % 3) - nw) * (CASE WHEN kind = 3 THEN 10 ELSE 1 END) AS gap_r, (bh - 3.0 - nh) * (CASE WHEN kind = 3 THEN 10 ELSE 1 END) AS gap_b,
        CASE WHEN coalesce(mat_bleed, 0) = 0 THEN 3.0 ELSE mat_bleed END AS wanted,
        floor(nw / 10) * CASE WHEN ln = 1 THEN 10 ELSE 1 END AS name_w, floor(nh / 10) * CASE WHEN ln = 1 THEN 10 ELSE 1 END AS name_h
    FROM files)"""


def _trim() -> str:
    w, h = "CASE WHEN sk % 3 = 0 THEN nw / sc ELSE nh / sc END", "CASE WHEN sk % 3 = 0 THEN nh / sc ELSE nw / sc END"
    return f"""CASE WHEN sk % 3 = 2 OR (abs({w} - pw) <= 0.2 AND abs({h} - ph) <= 0.2) THEN NULL
        WHEN {_size(w, h, "nw / sc", "nh / sc")} THEN 'green:ok' WHEN {_size(w, h, "nh / sc", "nw / sc")} THEN 'amber:rotated' ELSE 'red:wrong' END"""


def _named() -> str:
    near = lambda a, b: f"abs({a} - {b}) <= greatest(0.5, {b} * 0.02)"
    same = lambda w, h: f"(({near(w, 'nw')} AND {near(h, 'nh')}) OR ({near(h, 'nw')} AND {near(w, 'nh')}))"
    return f"CASE WHEN {same('name_w', 'name_h')} OR (ln > 2 AND {same('name_w * 10', 'name_h * 10')}) THEN 'green:ok' ELSE 'info:differs' END"


_RULES = {
    "page_size": _page_size(),
    "declared_trim": _trim(),
    "template_guides": "CASE WHEN ln = 4 THEN NULL WHEN disc = 0.05 THEN 'red:present' ELSE 'green:ok' END",
    "bleed_coverage": "CASE WHEN has_die THEN NULL WHEN worst IS NULL THEN 'info:unmeasured' WHEN worst <= 0.5 THEN 'green:ok' WHEN worst > mat_bleed / 2 THEN 'red:short' ELSE 'amber:short' END",
    "safe_area": "CASE WHEN has_die THEN NULL WHEN pk % 8 = 0 THEN 'info:unmeasured' WHEN disc * 20 <= 0.5 THEN 'green:ok' ELSE 'amber:intrusion' END",
    "resolution": "CASE WHEN mat_dpi IS NULL THEN NULL WHEN sk % 7 = 0 THEN 'info:unmeasured' WHEN qty * 8 >= mat_dpi THEN 'green:ok' ELSE 'red:low' END",
    "office_origin": "CASE WHEN pk % 50 = 0 THEN 'red:office' END",
    "colour_mode": "CASE WHEN mat_colour <> 'cmyk' OR sk % 4 = 3 THEN NULL WHEN sk % 4 = 0 THEN 'amber:rgb' WHEN sk % 4 = 1 THEN 'info:icc' ELSE 'green:ok' END",
    "spot_inks": "CASE WHEN pk % 4 = 0 THEN 'amber:found' END",
    "cut_path": "CASE WHEN NOT mat_cut OR pk % 4 = 3 THEN NULL WHEN pk % 4 = 0 THEN 'green:ok' ELSE 'amber:missing' END",
    "cut_geometry": "CASE WHEN NOT has_die THEN NULL WHEN rf = 'R' THEN 'amber:filled' WHEN ls <> 'O' THEN 'amber:open' ELSE 'info:ok' END",
    "cut_margins": "CASE WHEN NOT has_die THEN NULL WHEN least(gap_l, gap_t, gap_r, gap_b) < -0.5 THEN 'red:off_sheet' WHEN least(gap_l, gap_t, gap_r, gap_b) < wanted - 0.5 THEN 'amber:tight' WHEN ln = 5 THEN 'info:unmeasured' WHEN disc > 0.06 THEN 'amber:bare' ELSE 'green:ok' END",
    "raster_flat": "CASE WHEN pk % 9 <> 0 THEN NULL WHEN sk % 2 = 0 THEN 'amber:layers' ELSE 'green:ok' END",
    "fonts": "CASE WHEN rf = 'R' THEN NULL WHEN ln > 1 AND ls = 'O' THEN 'amber:present' ELSE 'green:ok' END",
    "overprint": "CASE WHEN tax > 0.06 THEN 'amber:on' END",
    "page_count": "CASE WHEN ln <= 1 THEN NULL WHEN mat_cut THEN 'info:cut_work' ELSE 'amber:many' END",
    "text_height": "CASE WHEN smallest IS NULL THEN NULL WHEN smallest >= floor THEN 'green:ok' ELSE 'amber:small' END",
    "split": "CASE WHEN mat_roll IS NOT NULL AND ceil((least(nw, nh) + 2 * mat_bleed) / mat_roll) > 1 THEN 'amber:required' END",
    "named_size": _named(),
    "filename": "CASE WHEN rf = 'N' THEN 'amber:diacritics' WHEN rf = 'A' THEN 'amber:dots' END",
}

_FOUND = f"""{_CASES},
each AS (SELECT file_id, unnest([{", ".join(_RULES.values())}]) AS hit, unnest([{", ".join(f"'{r}'" for r in _RULES)}]) AS id, unnest(range({len(_RULES)})) AS turn FROM t),
graded AS (SELECT file_id, id, turn, split_part(hit, ':', 1) AS own, concat('check.', id, '.', split_part(hit, ':', 2)) AS code FROM each WHERE hit IS NOT NULL AND id <> 'overprint'),
levelled AS (SELECT *, CASE WHEN own = 'green' THEN own WHEN id = 'fonts' THEN 'info' WHEN id = 'page_count' THEN 'red' ELSE own END AS level FROM graded)"""

FINDINGS = f"""{_FOUND}
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY CASE level WHEN 'red' THEN 0 WHEN 'amber' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, turn)::INTEGER AS place, id, level, code FROM levelled"""

VERDICTS = f"""{_FOUND},
per AS (SELECT file_id, count(*) FILTER (WHERE level = 'red') AS red, count(*) FILTER (WHERE level = 'amber') AS amber FROM levelled GROUP BY file_id)
SELECT file_id, CASE WHEN red > 0 THEN 'red' WHEN amber > 0 THEN 'amber' ELSE 'ok' END AS verdict, CASE WHEN red > 0 THEN red ELSE amber END AS count FROM per"""

VALUES = f"""{_CASES}
SELECT file_id, 'check.bleed_coverage.short' AS code, printf('%.1f', worst) AS measured, printf('%.0f', mat_bleed) AS wanted FROM t WHERE NOT has_die AND worst > 0.5
UNION ALL SELECT file_id, 'check.safe_area.intrusion', printf('%.1f', disc * 20), printf('%.0f', mat_safe) FROM t WHERE NOT has_die AND pk % 8 <> 0 AND disc * 20 > 0.5
UNION ALL SELECT file_id, 'check.text_height.small', printf('%.1f', smallest), printf('%.0f', floor) FROM t WHERE smallest < floor"""

QUERIES = {"findings": (findings, FINDINGS), "finding_values": (finding_values, VALUES), "verdicts": (verdicts, VERDICTS)}
