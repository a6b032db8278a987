"""The rules that judge a returned file: facts, expected geometry and material in, ranked findings out.

Every rule is a list of cases, the first that holds is its finding. All rules run in one projection over one
scan and give a number each, of severity, rule and outcome; a case's numbers are sorted within its row and
exploded. Codes and sentences are looked up by the number, and values, regions and texts are worked out
behind that, for the outcome that was found, and only if somebody selects them. Nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.geometry import let
from ..functions.numbers import TOLERANCE_MM, length, percent, same_size, tenth, whole

#: Fixed values of the rules, in millimetres but for factors, shares and counts.
MIN_TEXT_MM, FINISHING_MM, TWO_UP_FACTOR, SCALES = 10.0, 500.0, 2.0, range(2, 11)
MIN_BLEED_MM, BARE_SHARE, NAMES_LISTED, TRIM_IS_MEDIA_MM, FALLBACK_BLEED_MM, SIGNIFICANT_AREA = 1.0, 0.06, 4, 0.2, 3.0, 0.01
#: Parts of names that tell what a colorant or a producer is.
OFFICE = ["word", "excel", "powerpoint", "microsoft print to pdf", "libreoffice"]
TECHNICAL = ["cut", "contour", "crease", "fold", "drill", "perf", "regmark", "register", "kiss", "score", "szyci", "tunel", "obszyci", "drzewiec", "cięc", "ciec", "zagięc", "zagiec"]
CUT = ["cut", "contour"]
PROCESS = ["cyan", "magenta", "yellow", "black", "all", "none", "process cyan", "process magenta", "process yellow", "process black"]
#: The names of a sheet's sides in verdicts about margins, and the order of severities.
SIDES = {"left": "z lewej", "top": "u góry", "right": "z prawej", "bottom": "u dołu"}
LEVELS = ["red", "amber", "info", "green"]

REGIONS = "array<array<double>>"



@functools.lru_cache(maxsize=512)
def _made(name: str, k: int | None, gateway: int) -> Column:
    return F.col(name) if k is None else F.get(F.col(name), F.lit(k))


def _field(name: str, k: int | None = None) -> Column:
    """A column, or its k-th entry: rules name the same ones hundreds of times, and each making is a call to the JVM."""
    return _made(name, k, id(SparkContext._gateway))


f, e, m = (lambda n: _field(f"facts.{n}")), (lambda n: _field(f"expected.{n}")), (lambda n: _field(f"material.{n}"))


class Finding(NamedTuple):
    """An outcome of a rule: what it is, and what it tells if it is found."""

    id: str
    level: str
    code: str
    values: dict[str, Column]
    regions: Column | None = None


#: A rule's cases in their order: when (None: always) and what is found (None: nothing).
Cases = list[tuple[Column | None, Finding | None]]


def finding(rule: str, level: str, outcome: str, regions: Column | None = None, **values: Column) -> Finding:
    return Finding(rule, level, f"check.{rule}.{outcome}", values, regions)


def first_of(*cases: tuple[Column, Finding | None], otherwise: Finding | None = None) -> Cases:
    """The finding of the first case that holds (null doesn't); None for no finding."""
    return [*cases, (None, otherwise)]


def any_marker(name: Column, markers: list[str]) -> Column:
    return F.lower(name).rlike("|".join(f"\\Q{x}\\E" for x in markers))


def listed(items: Column) -> Column:
    return F.array_join(F.slice(items, 1, NAMES_LISTED), ", ")


def set_number(x: Column) -> Column:
    """x, unless it is null or zero: zero counts as not set."""
    return F.when(x != 0, x)


def in_any(pairs: list[tuple[Column, Column]], test: Callable[[Column, Column], Column]) -> Column:
    out = F.lit(False)
    for w, h in pairs:
        out = out | F.coalesce(test(w, h), F.lit(False))
    return out


def page_w() -> Column:
    return _field("facts.page_mm", 0)


def page_h() -> Column:
    return _field("facts.page_mm", 1)


def netto_w() -> Column:
    return _field("expected.netto_mm", 0)


def netto_h() -> Column:
    return _field("expected.netto_mm", 1)


def brutto_w() -> Column:
    return _field("expected.brutto_mm", 0)


def brutto_h() -> Column:
    return _field("expected.brutto_mm", 1)


def cut_work() -> Column:
    return F.coalesce(m("cut_path"), F.lit(False))


def page_scale() -> Column:
    """The scale the page is drawn at, as it was measured, else as it was ordered."""
    return F.coalesce(set_number(f("measured_scale")), set_number(e("scale")), F.lit(1))


def drawn_scale() -> Column:
    """N where the page is the expected artwork at 1:N and the expectation is 1:1, else 1."""
    def of(s: Column) -> Column:
        fits = lambda n: same_size(s["pw"], s["ph"], s["bw"] / n, s["bh"] / n) | same_size(s["ph"], s["pw"], s["bw"] / n, s["bh"] / n)
        return F.get(F.filter(F.array(*map(F.lit, SCALES)), fits), F.lit(0))  # written out for every scale it is too much code for the JIT

    sides = F.struct(*[v.alias(k) for k, v in (("pw", page_w()), ("ph", page_h()), ("bw", brutto_w()), ("bh", brutto_h()))])
    return F.when(e("scale") == 1, F.coalesce(let(sides, of), F.lit(1))).otherwise(F.lit(1))


def _over(w: Column, h: Column, low_w: Column, low_h: Column, allowance: Column) -> Column:
    return (w - low_w).between(F.lit(0.0), allowance) & (h - low_h).between(F.lit(0.0), allowance)


def _two_up(w: Column, h: Column, want_w: Column, want_h: Column, allowance: Column) -> Column:
    """Half the page, along either axis, is within the allowance and within a factor of the wanted size."""
    far = lambda a, b: F.abs(F.log(F.greatest(a, F.lit(1e-6)) / F.greatest(b, F.lit(1e-6))))
    near = lambda a, b: F.greatest(far(a, want_w), far(b, want_h)) <= F.log(F.lit(TWO_UP_FACTOR))
    within = lambda a, b: _over(a, b, want_w, want_h, allowance) | _over(b, a, want_w, want_h, allowance)
    return in_any([(w / 2, h), (w, h / 2)], lambda a, b: within(a, b) & (near(a, b) | near(b, a)))


def page_size() -> Cases:
    width, art = brutto_w() / e("scale"), brutto_h() / e("scale")
    full = art + F.coalesce(e("strip_mm"), F.lit(0.0))
    ready_w, ready_h, bleed = netto_w() / e("scale"), netto_h() / e("scale"), e("bleed_mm") / e("scale")
    page = {"page_w": whole(page_w()), "page_h": whole(page_h())}
    told = {"expected_w": whole(width), "expected_h": whole(full), **page}
    turned_h = F.when(same_size(page_h(), page_w(), width, full), full).otherwise(art)
    allowance = F.coalesce(set_number(m("finishing_mm")), F.lit(FINISHING_MM))

    def growth(w: Column, h: Column) -> Column:
        a, b = w - ready_w, h - ready_h
        window = a.between(F.lit(-TOLERANCE_MM), bleed * 2 + TOLERANCE_MM) & b.between(F.lit(-TOLERANCE_MM), bleed * 2 + TOLERANCE_MM)
        return F.when(window, F.greatest(F.lit(0.0), F.least(a, b)))

    grown = F.coalesce(growth(page_w(), page_h()), growth(page_h(), page_w()))
    cut_bleed = cut_work() & (e("bleed_mm") > 0)
    no_bleed = finding("page_size", "amber", "no_bleed", bleed=whole(e("bleed_mm")), **told)
    oversize = ((page_w() >= width) & (page_h() >= art)) | ((page_w() >= art) & (page_h() >= width))
    within = _over(page_w(), page_h(), width, art, allowance) | _over(page_h(), page_w(), width, art, allowance)
    failed = Finding("check_page_size", "info", "check.rule.failed", {"error": F.lit("no page size")})
    return first_of(
        (page_w().isNull() | page_h().isNull() | width.isNull() | art.isNull(), failed),
        (same_size(page_w(), page_h(), width, full) | same_size(page_w(), page_h(), width, art), finding("page_size", "green", "ok", **page)),
        (same_size(page_h(), page_w(), width, full) | same_size(page_h(), page_w(), width, art), finding("page_size", "amber", "rotated", expected_w=whole(width), expected_h=whole(turned_h), **page)),
        (F.col("drawn") > 1, finding("page_size", "info", "scaled", scale=F.col("drawn"), expected_w=whole(width), expected_h=whole(art), **page)),
        ((e("bleed_mm") > 0) & (same_size(page_w(), page_h(), ready_w, ready_h) | same_size(page_h(), page_w(), ready_w, ready_h)), no_bleed),
        (cut_bleed & (grown < MIN_BLEED_MM), no_bleed),
        (cut_bleed & grown.isNotNull(), finding("page_size", "green", "with_bleed", netto_w=whole(ready_w), netto_h=whole(ready_h), **told)),
        (_two_up(page_w(), page_h(), width, art, allowance), finding("page_size", "red", "two_up", **told)),
        (~cut_work() & within, finding("page_size", "green", "finishing", allowance=whole(allowance), **told)),
        (~cut_work() & oversize, finding("page_size", "amber", "oversize", allowance=whole(allowance), **told)),
        otherwise=finding("page_size", "red", "wrong", **told),
    )


def declared_trim() -> Cases:
    side = lambda box, k: F.get(F.try_element_at(f("declared_boxes_mm"), F.lit(box)), F.lit(k))
    w, h = side("trimbox", 0), side("trimbox", 1)
    default = (F.abs(w - side("mediabox", 0)) <= TRIM_IS_MEDIA_MM) & (F.abs(h - side("mediabox", 1)) <= TRIM_IS_MEDIA_MM)
    want_w, want_h = netto_w() / page_scale(), netto_h() / page_scale()
    told = {"trim_w": whole(w * page_scale()), "trim_h": whole(h * page_scale()), "expected_w": whole(netto_w()), "expected_h": whole(netto_h())}
    return first_of(
        (w.isNull() | h.isNull() | F.coalesce(default, F.lit(False)), None),
        (same_size(w, h, want_w, want_h), finding("declared_trim", "green", "ok", **told)),
        (same_size(w, h, want_h, want_w), finding("declared_trim", "amber", "rotated", **told)),
        otherwise=finding("declared_trim", "red", "wrong", **told),
    )


def template_guides() -> Cases:
    return first_of((f("guides_present").isNull(), None), (f("guides_present"), finding("template_guides", "red", "present")), otherwise=finding("template_guides", "green", "ok"))


def bleed_coverage() -> Cases:
    share, missing = f("bleed_shortfall.share"), f("bleed_shortfall.missing_mm")
    worst = F.when(f("bleed_shortfall").isNotNull(), F.when(share <= BARE_SHARE, 0.0).otherwise(missing)).otherwise(F.array_max(f("blank_edges_mm")))
    told = {"missing": tenth(worst), "bleed": whole(e("bleed_mm"))}
    return first_of(
        (cut_work() & f("die").isNotNull(), None),
        (worst.isNull(), finding("bleed_coverage", "info", "unmeasured")),
        (worst <= TOLERANCE_MM, finding("bleed_coverage", "green", "ok")),
        (worst > e("bleed_mm") / 2, finding("bleed_coverage", "red", "short", **told)),
        otherwise=finding("bleed_coverage", "amber", "short", **told),
    )


def safe_area() -> Cases:
    depth = f("safe_intrusion_mm")
    return first_of(
        (cut_work() & f("die").isNotNull(), None),
        (depth.isNull(), finding("safe_area", "info", "unmeasured")),
        (depth <= TOLERANCE_MM, finding("safe_area", "green", "ok")),
        otherwise=finding("safe_area", "amber", "intrusion", regions=f("safe_intrusion_regions_mm"), intrusion=tenth(depth), safe=whole(e("safe_mm"))),
    )


def resolution() -> Cases:
    floor = set_number(m("min_dpi"))
    low = F.transform(F.filter(F.coalesce(f("image_placements"), F.array().cast("array<struct<rect_mm:array<double>,dpi:double,area_fraction:double>>")), lambda p: (p["dpi"] < floor) & (F.size(p["rect_mm"]) > 0)), lambda p: p["rect_mm"])
    return first_of(
        (floor.isNull(), None),
        (f("min_dpi").isNull(), finding("resolution", "info", "unmeasured")),
        (f("min_dpi") >= floor, finding("resolution", "green", "ok", dpi=whole(f("min_dpi")))),
        otherwise=finding("resolution", "red", "low", regions=low, dpi=whole(f("min_dpi")), floor=whole(floor)),
    )


def office_producer(producer: Column, creator: Column) -> Column:
    """The first of the office names in what made the file, or null."""
    made = F.lower(F.concat_ws(" ", F.coalesce(producer, F.lit("")), F.coalesce(creator, F.lit(""))))
    return F.get(F.filter(F.array(*map(F.lit, OFFICE)), lambda x: F.contains(made, x)), F.lit(0))


def office_origin() -> Cases:
    name = office_producer(f("producer"), f("creator"))
    return first_of((name.isNotNull(), finding("office_origin", "red", "office", application=F.initcap(name))))


def colour_mode() -> Cases:
    spaces = f("colour_spaces")
    rgb = F.filter(spaces, lambda s: F.contains(s, F.lit("RGB")))
    return first_of(
        (~F.coalesce(m("colour") == "cmyk", F.lit(False)) | ~F.coalesce(F.size(spaces) > 0, F.lit(False)), None),
        (F.size(rgb) > 0, finding("colour_mode", "amber", "rgb", spaces=listed(rgb))),
        (F.exists(spaces, lambda s: F.contains(s, F.lit("ICCBased"))), finding("colour_mode", "info", "icc")),
        otherwise=finding("colour_mode", "green", "ok"),
    )


def ink_spots(spots: Column) -> Column:
    """Colorants that are inks beside the process inks, in their order."""
    return F.filter(spots, lambda s: ~any_marker(s, TECHNICAL) & ~F.lower(F.trim(s)).isin(PROCESS))


def spot_inks() -> Cases:
    inks = ink_spots(f("spot_names"))
    return first_of((F.size(inks) > 0, finding("spot_inks", "amber", "found", inks=listed(inks))))


def cut_path() -> Cases:
    spots, chosen = f("spot_names"), F.nullif(f("cut_spot"), F.lit(""))
    found = F.when(chosen.isNull(), F.filter(spots, lambda s: any_marker(s, CUT))).otherwise(F.filter(spots, lambda s: s == chosen))
    return first_of((~cut_work() | spots.isNull(), None), (F.size(found) > 0, finding("cut_path", "green", "ok", cut=listed(found))), otherwise=finding("cut_path", "amber", "missing"))


def cut_geometry() -> Cases:
    die = lambda n: f(f"die.{n}")
    told = {"cut": die("colorant"), "cut_w": whole(F.get(die("size_mm"), F.lit(0)) * page_scale()), "cut_h": whole(F.get(die("size_mm"), F.lit(1)) * page_scale()), "length": length(die("length_mm") * page_scale()), "contours": die("contours")}
    return first_of(
        (f("die").isNull(), None),
        (die("filled"), finding("cut_geometry", "amber", "filled", **told)),
        (~die("closed"), finding("cut_geometry", "amber", "open", **told)),
        otherwise=finding("cut_geometry", "info", "ok", **told),
    )


def cut_margins() -> Cases:
    at = lambda n, k: F.get(f(f"die.{n}"), F.lit(k))
    sheet_w, sheet_h = F.coalesce(at("page_mm", 0), page_w()), F.coalesce(at("page_mm", 1), page_h())
    bleed = F.coalesce(set_number(m("bleed_mm")), set_number(e("bleed_mm")), F.lit(FALLBACK_BLEED_MM))
    gaps = {"left": at("origin_mm", 0), "top": at("origin_mm", 1), "right": sheet_w - at("origin_mm", 0) - at("size_mm", 0), "bottom": sheet_h - at("origin_mm", 1) - at("size_mm", 1)}
    gaps = {side: gap * page_scale() for side, gap in gaps.items()}
    off = F.array_join(F.array_compact(F.array(*[F.when(gap < -TOLERANCE_MM, side) for side, gap in gaps.items()])), ", ")
    tight = F.array_join(F.array_compact(F.array(*[F.when(gap < bleed - TOLERANCE_MM, F.concat(F.lit(f"{SIDES[side]} "), tenth(gap), F.lit(" mm"))) for side, gap in gaps.items()])), ", ")
    told, bare = {"cut": f("die.colorant"), "bleed": whole(bleed)}, f("die.bare_perimeter")
    return first_of(
        (f("die").isNull() | page_w().isNull(), None),
        (off != "", finding("cut_margins", "red", "off_sheet", sides=off, **told)),
        (tight != "", finding("cut_margins", "amber", "tight", sides=tight, **told)),
        (bare.isNull(), finding("cut_margins", "info", "unmeasured", **told)),
        (bare > BARE_SHARE, finding("cut_margins", "amber", "bare", share=percent(bare), **told)),
        otherwise=finding("cut_margins", "green", "ok", **told),
    )


def raster_flat() -> Cases:
    return first_of((f("raster_alpha").isNull(), None), (f("raster_alpha"), finding("raster_flat", "amber", "layers", mode=f("raster_mode"))), otherwise=finding("raster_flat", "green", "ok"))


def fonts() -> Cases:
    plain = F.transform(F.slice(f("fonts"), 1, NAMES_LISTED), lambda n: F.element_at(F.split(n, r"\+"), -1))
    shown = (F.size(f("fonts")) > 0) & F.coalesce(f("shows_text"), F.lit(False))
    return first_of((f("fonts").isNull(), None), (shown, finding("fonts", "amber", "present", fonts=F.array_join(plain, ", "))), otherwise=finding("fonts", "green", "ok"))


def overprint() -> Cases:
    return first_of((f("overprint"), finding("overprint", "amber", "on")))


def page_count() -> Cases:
    return first_of((F.coalesce(f("pages"), F.lit(0)) <= 1, None), (cut_work(), finding("page_count", "info", "cut_work", pages=f("pages"))), otherwise=finding("page_count", "amber", "many", pages=f("pages")))


def text_height() -> Cases:
    smallest, floor = f("text_min_height_mm"), F.coalesce(set_number(m("min_text_mm")), F.lit(MIN_TEXT_MM))
    return first_of((smallest.isNull(), None), (smallest >= floor, finding("text_height", "green", "ok", smallest=tenth(smallest))), otherwise=finding("text_height", "amber", "small", smallest=tenth(smallest), floor=whole(floor)))


def panel_count(w: Column, h: Column, bleed: Column, roll: Column) -> Column:
    """Strips a graphic is printed in: its short side with the bleed over the roll's width; 1 without a roll."""
    return F.coalesce(F.greatest(F.lit(1), F.ceil((F.least(w, h) + F.coalesce(bleed, F.lit(0.0)) * 2) / set_number(roll)).cast("int")), F.lit(1))


def split() -> Cases:
    panels = panel_count(netto_w(), netto_h(), m("bleed_mm"), m("max_width_mm"))
    return first_of((panels > 1, finding("split", "amber", "required", netto_w=whole(netto_w()), netto_h=whole(netto_h()), panels=panels, roll=whole(m("max_width_mm")))))


def named_size() -> Cases:
    size = f("named_size")
    read = names.reconciled(size["w"], size["h"], size["stated"], netto_w(), netto_h())
    told = {"named_w": whole(read["w"]), "named_h": whole(read["h"]), "netto_w": whole(netto_w()), "netto_h": whole(netto_h())}
    return first_of((size.isNull(), None), (names.named_same(read["w"], read["h"], netto_w(), netto_h()), finding("named_size", "green", "ok", **told)), otherwise=finding("named_size", "info", "differs", **told))


def filename() -> Cases:
    return first_of((f("has_diacritics"), finding("filename", "amber", "diacritics")), (f("extra_dots"), finding("filename", "amber", "dots")))


#: The rules in their order, which breaks ties between findings of one severity.
RULES = (page_size, declared_trim, template_guides, bleed_coverage, safe_area, resolution, office_origin, colour_mode, spot_inks, cut_path, cut_geometry, cut_margins, raster_flat, fonts, overprint, page_count, text_height, split, named_size, filename)


def render(template: Column, values: Column) -> Column:
    """The template with each {name} replaced by its value, once; names without a value stay."""
    parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
    name = lambda p: F.substring(p, 2, 1_000_000)
    value = lambda p: F.try_element_at(values, F.left(name(p), F.length(p) - 2))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\{\w+\}$"), F.coalesce(value(p), p)).otherwise(p)), "")


#: A finding's number holds its severity, its rule's place and its outcome's: they sort in that order.
_BY_LEVEL, _BY_RULE = 1_000_000, 1_000


class Bench(NamedTuple):
    """The rules under a shop's severities and wording: what is decided before any row is read."""

    outcomes: list[Finding]
    cases: list[Cases]
    levels: dict[str, str]
    templates: dict[str, str]

    def level(self, x: Finding) -> str | None:
        """The severity an outcome has here; None if it is silenced."""
        own = self.levels.get(x.id)
        return None if own == "off" else x.level if own is None or x.level == "green" else own

    def number(self, place: int) -> Column:
        """A rule's finding as a number, or null."""
        out, at = F.lit(None).cast("int"), [self.outcomes.index(x) if x else None for _, x in self.cases[place]]
        for (holds, x), i in reversed(list(zip(self.cases[place], at, strict=True))):
            level = self.level(x) if x else None
            told = F.lit(None).cast("int") if level is None else F.lit(LEVELS.index(level) * _BY_LEVEL + place * _BY_RULE + i)
            out = told if holds is None else F.when(holds, told).otherwise(out)  # null holds no more than false
        return out

    def at(self, number: Column, of: Callable[[Finding], str | None]) -> Column:
        """Something told of the outcome with a number."""
        quoted = ["NULL" if t is None else "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in map(of, self.outcomes)]
        return F.get(F.expr(f"array({', '.join(quoted)})"), (number % _BY_RULE).cast("int"))  # one call for all of them

    def chosen(self, number: Column, of: Callable[[Finding], Column | None], kind: str) -> Column:
        """What an outcome works out, of the one with a number alone."""
        out = F.lit(None).cast(kind)
        for i, x in enumerate(self.outcomes):
            told = of(x)
            if told is not None:
                out = F.when(number % _BY_RULE == i, told.cast(kind)).otherwise(out)
        return out

    def values(self, number: Column) -> Column:
        pairs = lambda x: [c for k, v in x.values.items() for c in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
        return F.coalesce(self.chosen(number, lambda x: F.create_map(*pairs(x)) if x.values else None, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def title(self, number: Column, values: Column) -> Column:
        return render(self.at(number, lambda x: self.templates.get(x.code, x.code)), values)

    def detail(self, number: Column, values: Column) -> Column:
        return F.coalesce(render(self.at(number, lambda x: self.templates.get(f"{x.code}.detail")), values), F.lit(""))


def _bench(levels: DataFrame | None, wording: DataFrame | None) -> Bench:
    """Both tables hold a row per rule or code; of them the driver reads what names a rule or code that there is."""
    from .wording import DEFAULTS

    cases = [r() for r in RULES]
    outcomes = [x for own in cases for _, x in own if x]
    ids, codes = sorted({x.id for x in outcomes}), [c for x in outcomes for c in (x.code, f"{x.code}.detail")]
    graded = {r["rule_id"]: r["level"] for r in levels.filter(F.col("rule_id").isin(ids) & F.col("level").isin("off", "info", "amber", "red")).select("rule_id", "level").collect()} if levels is not None else {}
    own = {r["code"]: r["template"] for r in wording.filter(F.col("code").isin(codes) & (F.coalesce("template", F.lit("")) != "")).select("code", "template").collect()} if wording is not None else {}
    return Bench(outcomes, cases, graded, DEFAULTS | own)


def _numbered(cases: DataFrame, bench: Bench, keys: tuple[str, ...], bare: Column | None, back: Column | None) -> DataFrame:
    """keys, facts, expected, material, drawn and numbers: each case's findings, worst first."""
    # what made the structs runs once a row, not wherever a rule reads a field: nothing is merged across an explode
    flags = [(F.lit(False) if c is None else F.coalesce(c, F.lit(False))).alias(n) for c, n in ((bare, "bare"), (back, "back"))]
    once = cases.select(*keys, F.explode(F.array(F.struct("facts", "expected", "material", *flags))).alias("case")).select(*keys, "case.*")
    once = once.withColumn("drawn", drawn_scale())
    places = [i for i, r in enumerate(RULES)]
    told = [bench.number(i) if RULES[i] is not cut_path or back is None else F.when(~F.col("back"), bench.number(i)) for i in places]
    numbers = F.sort_array(F.array_compact(F.array(*told)))
    numbers = numbers if bare is None else F.when(~F.col("bare"), numbers).otherwise(F.array().cast("array<int>"))
    # filters on what is made of the numbers would run every rule once more: none is pushed below an explode
    return once.select("*", F.explode(F.array(numbers)).alias("numbers"))


#: What is told of a finding.
TOLD = ("place", "id", "level", "code", "values", "regions", "title", "detail")


def judge(cases: DataFrame, levels: DataFrame | None = None, wording: DataFrame | None = None, keys: tuple[str, ...] = ("file_id",), bare: Column | None = None, back: Column | None = None, columns: tuple[str, ...] = TOLD) -> DataFrame:
    """Findings of every case, worst first (place), a row each: keys and the columns asked for.

    cases: keys and the structs facts, expected, material (null fields: not known). levels (rule_id, level):
    off removes a rule's finding, another level replaces any but green. wording (code, template) over
    the defaults. Where ``bare`` holds the file is the template itself and has no finding; where ``back`` holds
    it is the back of a pair, which is asked for no cut path of its own.
    """
    bench = _bench(levels, wording)
    each = _numbered(cases, bench, keys, bare, back).select(*keys, "facts", "expected", "material", "drawn", F.posexplode_outer("numbers").alias("pos", "number")).filter("number IS NOT NULL")
    number = F.col("number")
    level = F.get(F.array(*map(F.lit, LEVELS)), F.floor(number / _BY_LEVEL).cast("int"))
    values = functools.cache(lambda: bench.values(number))
    made = {
        "place": lambda: F.col("pos") + 1, "id": lambda: bench.at(number, lambda x: x.id), "level": lambda: level, "code": lambda: bench.at(number, lambda x: x.code), "values": values,
        "regions": lambda: bench.chosen(number, lambda x: None if x.regions is None else F.when(F.size(x.regions) > 0, x.regions), REGIONS),
        "title": lambda: let(values(), lambda v: bench.title(number, v)), "detail": lambda: let(values(), lambda v: bench.detail(number, v)),
    }
    return each.select(*keys, *[made[c]().alias(c) for c in columns])


def summarise(cases: DataFrame, levels: DataFrame | None = None, wording: DataFrame | None = None, keys: tuple[str, ...] = ("file_id",), bare: Column | None = None, back: Column | None = None) -> DataFrame:
    """A line per case: the worst of red, amber and ok, how many findings have it, and their titles in order. See judge; it all happens within the row."""
    bench = _bench(levels, wording)
    each = _numbered(cases, bench, keys, bare, back)
    first = F.get("numbers", F.lit(0))
    level = F.floor(first / _BY_LEVEL).cast("int")
    worst = F.when(level == 0, "red").when(level == 1, "amber").otherwise("ok")
    same = F.when(worst != "ok", F.filter("numbers", lambda k: F.floor(k / _BY_LEVEL) == level)).otherwise(F.array().cast("array<int>"))
    titles = F.transform(F.col("same"), lambda k: let(bench.values(k), lambda v: bench.title(k, v)))
    each = each.withColumn("verdict", worst).withColumn("same", same)
    return each.select(*keys, "verdict", F.size("same").cast("long").alias("count"), F.array_join(titles, "; ").alias("titles"))
