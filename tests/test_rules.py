"""Rules on known cases, and a plain restatement of the page-size rule on random sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from platen.operators import rules
from platen.operators.wording import DEFAULTS, defaults
from platen.schemas import EXPECTED, FACTS, MATERIAL, as_struct

BANNER = {"id": "b", "bleed_mm": 20.0, "safe_mm": 30.0, "min_dpi": 100.0, "max_width_mm": 1600.0, "colour": "cmyk", "cut_path": False}
STICKER = BANNER | {"bleed_mm": 3.0, "cut_path": True}
DIE = {"colorant": "Cut", "origin_mm": [3.0, 3.0], "size_mm": [100.0, 50.0], "page_mm": None, "length_mm": 300.0, "contours": 1, "closed": True, "filled": False, "bare_perimeter": 0.0}



def judged(spark, facts, netto=(1000.0, 2000.0), material=BANNER, scale=1, strip=0.0, levels=None, wording=None):
    expected = {"netto_mm": list(netto), "brutto_mm": [n + 2 * material["bleed_mm"] for n in netto], "bleed_mm": material["bleed_mm"], "safe_mm": material["safe_mm"], "scale": scale, "strip_mm": strip}
    facts = {"page_mm": [n / scale for n in expected["brutto_mm"]], "file_id": "f"} | facts
    schema = ", ".join(f"{p}_{n} {t}" for p, fields in (("f", FACTS), ("e", EXPECTED), ("m", MATERIAL)) for n, t in fields.items())
    row = [d.get(n) for d, fields in ((facts, FACTS), (expected, EXPECTED), (material, MATERIAL)) for n in fields]
    df = spark.createDataFrame([row], schema)
    cases = df.select(F.lit("f").alias("file_id"), as_struct(df, FACTS, "f_").alias("facts"), as_struct(df, EXPECTED, "e_").alias("expected"), as_struct(df, MATERIAL, "m_").alias("material"))
    levels = levels and spark.createDataFrame(list(levels.items()), "rule_id string, level string")
    wording = wording and spark.createDataFrame(list(wording.items()), "code string, template string")
    return rules.judge(cases, levels, wording), cases


def by_id(found):
    return {r["id"]: r for r in found.collect()}


def test_artwork_short_of_the_bleed(spark):
    found = by_id(judged(spark, {"bleed_shortfall": {"share": 0.5, "missing_mm": 15.0}})[0])
    r = found["bleed_coverage"]
    assert r["level"] == "red" and r["values"] == {"missing": "15.0", "bleed": "20"} and "15.0" in r["title"]
    assert by_id(judged(spark, {"bleed_shortfall": {"share": 0.05, "missing_mm": 15.0}})[0])["bleed_coverage"]["level"] == "green"
    at_ten = by_id(judged(spark, {"page_mm": [104.0, 204.0], "measured_scale": 10, "bleed_shortfall": {"share": 0.5, "missing_mm": 15.0}})[0])
    assert at_ten["bleed_coverage"]["values"] == r["values"] and at_ten["page_size"]["code"] == "check.page_size.scaled" and at_ten["page_size"]["values"]["scale"] == "10"


def test_only_inks_are_inks(spark):
    found = by_id(judged(spark, {"spot_names": ["Cut", "PANTONE 711 C", "Process Cyan", "linia szycia"]})[0])
    assert found["spot_inks"]["values"] == {"inks": "PANTONE 711 C"}


def test_structure_rules(spark):
    facts = {
        "producer": "Microsoft Print To PDF", "colour_spaces": ["ICCBased(CMYK)"], "fonts": ["AAAAAA+Lato", "Arial", "B", "C", "D"], "shows_text": True, "overprint": True, "pages": 3, "text_min_height_mm": 4.04,
        "min_dpi": 72.4, "image_placements": [{"rect_mm": [1.0, 2.0, 3.0, 4.0], "dpi": 72.4, "area_fraction": 0.5}, {"rect_mm": [9.0, 9.0, 9.0, 9.0], "dpi": 200.0, "area_fraction": 0.5}], "raster_alpha": True, "raster_mode": "RGBA",
        "guides_present": True, "declared_boxes_mm": {"trimbox": [2000.0, 1000.0], "mediabox": [1040.0, 2040.0]}, "named_size": {"w": 100.0, "h": 200.0, "stated": False}, "has_diacritics": True, "extra_dots": True, "safe_intrusion_mm": 3.25, "safe_intrusion_regions_mm": [[0.0, 1.0, 2.0, 3.0]],
    }
    found = by_id(judged(spark, facts)[0])
    want = {
        "office_origin": ("red", {"application": "Microsoft Print To Pdf"}), "colour_mode": ("info", {}), "fonts": ("amber", {"fonts": "Lato, Arial, B, C"}), "overprint": ("amber", {}), "page_count": ("amber", {"pages": "3"}),
        "text_height": ("amber", {"smallest": "4.0", "floor": "10"}), "resolution": ("red", {"dpi": "72", "floor": "100"}), "raster_flat": ("amber", {"mode": "RGBA"}), "template_guides": ("red", {}),
        "declared_trim": ("amber", {"trim_w": "2000", "trim_h": "1000", "expected_w": "1000", "expected_h": "2000"}), "named_size": ("green", {"named_w": "1000", "named_h": "2000", "netto_w": "1000", "netto_h": "2000"}), "filename": ("amber", {}),
        "safe_area": ("amber", {"intrusion": "3.2", "safe": "30"}),
    }
    for rule, (level, values) in want.items():
        assert (found[rule]["level"], found[rule]["values"]) == (level, values), rule
    assert found["resolution"]["regions"] == [[1.0, 2.0, 3.0, 4.0]] and found["safe_area"]["regions"] == [[0.0, 1.0, 2.0, 3.0]]
    assert [r["level"] for r in sorted(found.values(), key=lambda r: r["place"])] == sorted((r["level"] for r in found.values()), key=rules.LEVELS.index)


def test_cut_work(spark):
    small = {"page_mm": [106.0, 56.0], "die": DIE, "spot_names": ["CutContour"]}
    found = by_id(judged(spark, small, (100.0, 50.0), STICKER)[0])
    assert found["cut_path"]["values"] == {"cut": "CutContour"} and "bleed_coverage" not in found and "safe_area" not in found
    assert found["cut_geometry"]["values"] == {"cut": "Cut", "cut_w": "100", "cut_h": "50", "length": "300 mm", "contours": "1"} and found["cut_margins"]["level"] == "green"
    tight = by_id(judged(spark, small | {"page_mm": [101.0, 51.0], "die": DIE | {"origin_mm": [0.5, 0.5]}}, (100.0, 50.0), STICKER)[0])["cut_margins"]
    assert tight["values"]["sides"] == "z lewej 0.5 mm, u góry 0.5 mm, z prawej 0.5 mm, u dołu 0.5 mm"
    off = by_id(judged(spark, small | {"die": DIE | {"origin_mm": [-2.0, 3.0]}}, (100.0, 50.0), STICKER)[0])["cut_margins"]
    assert (off["level"], off["values"]["sides"]) == ("red", "left")
    bare = by_id(judged(spark, small | {"die": DIE | {"bare_perimeter": 0.125}}, (100.0, 50.0), STICKER)[0])["cut_margins"]
    assert (bare["level"], bare["values"]["share"]) == ("amber", "12%")
    scaled = by_id(judged(spark, small | {"measured_scale": 10, "die": DIE | {"filled": True}}, (100.0, 50.0), STICKER)[0])["cut_geometry"]
    assert (scaled["code"], scaled["values"]["length"], scaled["values"]["cut_w"]) == ("check.cut_geometry.filled", "3.00 m", "1000")
    chosen = by_id(judged(spark, small | {"spot_names": ["PANTONE 806 C"], "cut_spot": "PANTONE 806 C"}, (100.0, 50.0), STICKER)[0])["cut_path"]
    assert chosen["level"] == "green"


def test_severities_and_wording(spark):
    facts = {"fonts": ["A"], "shows_text": True, "overprint": True, "safe_intrusion_mm": 0.0}
    found = by_id(judged(spark, facts, levels={"fonts": "red", "overprint": "off", "safe_area": "red", "bleed_coverage": "bogus"}, wording={"check.fonts.present": "Text {fonts} {other}", "check.safe_area.ok": ""})[0])
    assert found["fonts"]["level"] == "red" and found["fonts"]["title"] == "Text A {other}"
    assert "overprint" not in found and found["safe_area"]["level"] == "green" and found["safe_area"]["title"] == DEFAULTS["check.safe_area.ok"]
    assert found["bleed_coverage"]["level"] == "info"


def test_missing_page_is_a_failed_rule(spark):
    found = by_id(judged(spark, {"page_mm": None}, levels={"page_size": "off"})[0])
    assert found["check_page_size"]["code"] == "check.rule.failed" and found["check_page_size"]["level"] == "info"


def test_summary(spark):
    found, cases = judged(spark, {"overprint": True, "pages": 2, "safe_intrusion_mm": 0.0, "blank_edges_mm": [0.0] * 4, "min_dpi": 150.0})
    r = rules.summarise(cases).first()
    amber = [x["title"] for x in sorted(found.collect(), key=lambda x: x["place"]) if x["level"] == "amber"]
    assert (r["verdict"], r["count"], r["titles"]) == ("amber", len(amber), "; ".join(amber)) and "Overprint is on" in amber
    softened = spark.createDataFrame([(x["id"], "off") for x in found.collect() if x["level"] == "amber"], "rule_id string, level string")
    assert tuple(rules.summarise(cases, softened).first())[1:] == ("ok", 0, "")


def test_templates_and_backs_are_not_judged_as_designs(spark):
    _, cases = judged(spark, {"overprint": True, "spot_names": [], "page_mm": [106.0, 56.0]}, (100.0, 50.0), STICKER)
    assert rules.judge(cases, bare=F.lit(True)).count() == 0 and rules.summarise(cases, bare=F.lit(True)).first()["verdict"] == "ok"
    front, back = by_id(rules.judge(cases)), by_id(rules.judge(cases, back=F.lit(True)))
    assert set(front) - set(back) == {"cut_path"} and rules.judge(cases, bare=F.lit(None).cast("boolean")).count() == len(front)


def test_values_are_substituted_once(spark):
    made = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x"), F.lit("ink"), F.lit("Cut {a}"))
    text = lambda t: spark.range(1).select(rules.render(F.lit(t), made).alias("t")).first()["t"]
    assert text("{a} {b} {c} {ink}{a}") == "{b} x {c} Cut {a}{b}" and text("no { brace } {") == "no { brace } {" and text("") == ""


def test_every_outcome_has_a_sentence(spark):
    import inspect
    import re

    source = inspect.getsource(rules)
    codes = {f"check.{a}.{b}" for a, b in re.findall(r'finding\("(\w+)", [^,]+, "(\w+)"', source)}
    assert codes and codes <= set(DEFAULTS)
    assert defaults(spark).count() == len(DEFAULTS)


def plain_page_size(page, netto, bleed, cut, finishing):
    """The rule in plain words, for a 1:1 expectation without a strip."""
    near = lambda a, b: abs(a - b) <= max(0.5, b * 0.001)
    fits = lambda size, turn=False: all(near(a, b) for a, b in zip(page[::-1] if turn else page, size, strict=True))
    full = (netto[0] + 2 * bleed, netto[1] + 2 * bleed)
    if fits(full):
        return "ok"
    if fits(full, True):
        return "rotated"
    if any(fits((full[0] / n, full[1] / n), t) for n in range(2, 11) for t in (False, True)):
        return "scaled"
    if bleed > 0 and (fits(netto) or fits(netto, True)):
        return "no_bleed"
    if cut and bleed > 0:
        for p in (page, page[::-1]):
            over = [a - b for a, b in zip(p, netto, strict=True)]
            if all(-0.5 <= o <= 2 * bleed + 0.5 for o in over):
                return "no_bleed" if max(0, min(over)) < 1 else "with_bleed"
    within = lambda p: any(all(0 <= a - b <= finishing for a, b in zip(q, full, strict=True)) for q in (p, p[::-1]))
    for half in ((page[0] / 2, page[1]), (page[0], page[1] / 2)):
        if within(half) and any(max(abs(math.log(a / b)) for a, b in zip(q, full, strict=True)) <= math.log(2) for q in (half, half[::-1])):
            return "two_up"
    if not cut:
        if within(page):
            return "finishing"
        if any(all(a >= b for a, b in zip(q, full, strict=True)) for q in (page, page[::-1])):
            return "oversize"
    return "wrong"


def test_page_size_on_random_sizes(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(600):
        netto = (float(rng.randint(50, 900)), float(rng.randint(50, 900)))
        bleed, cut, finishing = rng.choice([0.0, 3.0, 20.0]), rng.random() < 0.4, rng.choice([100.0, 500.0])
        full = (netto[0] + 2 * bleed, netto[1] + 2 * bleed)
        page = rng.choice([full, full[::-1], netto, netto[::-1], (full[0] / 5, full[1] / 5), (2 * full[0], full[1]), (full[0] + 90, full[1] + 7), (full[0] + 700, full[1]), (netto[0] + bleed, netto[1] + bleed), (full[0] - 30, full[1])])
        page = (page[0] + rng.choice([0, 0.4, 0.6, -0.4]), page[1])
        rows.append((str(i), list(page), list(netto), list(full), bleed, cut, finishing))
        want[str(i)] = plain_page_size(page, netto, bleed, cut, finishing)
    df = spark.createDataFrame(rows, "file_id string, f_page_mm array<double>, e_netto_mm array<double>, e_brutto_mm array<double>, e_bleed_mm double, m_cut_path boolean, m_finishing_mm double").withColumn("e_scale", F.lit(1))
    cases = df.select("file_id", as_struct(df, FACTS, "f_").alias("facts"), as_struct(df, EXPECTED, "e_").alias("expected"), as_struct(df, MATERIAL, "m_").alias("material"))
    got = {r["file_id"]: r["code"].rpartition(".")[2] for r in rules.judge(cases).filter("id = 'page_size'").collect()}
    assert got == want and len(set(want.values())) >= 9


@pytest.mark.parametrize(("size", "material", "welded"), [((4000, 4000), (0.0, 3200.0), True), ((3200, 9000), (0.0, 3200.0), False), ((3300, 3000), (0.0, 3200.0), False), ((1366, 2000), (3.0, 1370.0), True), ((1360, 2000), (3.0, 1370.0), False), ((6000, 7000), (0.0, None), False)])
def test_welded_jobs(spark, size, material, welded):
    n = spark.range(1).select(rules.panel_count(F.lit(float(size[0])), F.lit(float(size[1])), F.lit(material[0]), F.lit(material[1]).cast("double"))).first()[0]
    assert (n > 1) == welded


def test_rules_run_once_a_case(spark):
    """No filter that is inferred or pushed down works out the rules' numbers once more."""
    from platen.plans import judging, templating

    for query in (judging.findings, judging.finding_values, judging.verdicts, templating.bare_files):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_sort(") + plan.count("sort_array(") == 1, query.__name__
