"""Items, names, dates, outlines, orders, state, geometry, meshes, rasters, sources and the stream, on known answers."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.functions import dates, editor, geometry, names, numbers
from platen.operators import components, die, items, mesh, orders, outlines, polygons, raster, scenes, state, templates
from platen.sources import files, sheet, shop
from platen.streaming import quiet, ticks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("value", "unit", "mm"), [("800", "mm", 800), ("80", "cm", 800), ("0,8", "m", 800), ("80,5", "cm", 805), (" 300 ", "cm", 3000)])
def test_typed_dimensions(spark, value, unit, mm):
    assert one(spark, items.parsed_dimension(lit(value), lit(unit)))["mm"] == mm


@pytest.mark.parametrize(("value", "unit", "problem"), [("", "mm", "dimensions_required"), ("abc", "mm", "not_a_number"), ("nan", "mm", "not_a_number"), ("0", "mm", "must_be_positive"), ("-5", "mm", "must_be_positive"), ("5", "furlong", "unknown_unit"), ("200", "m", "absurd_dimension")])
def test_refused_dimensions(spark, value, unit, problem):
    assert one(spark, items.parsed_dimension(lit(value), lit(unit))) == (None, problem)


def test_resolved_item(spark):
    df = spark.createDataFrame([(("b", 20.0, 30.0, 1600.0, "panel"), 1000.0, 2000.0), (("s", 3.0, 3.0, None, "margin"), 9000.0, 50.0), (("b", 20.0, 30.0, 1600.0, "panel"), 50.0, 50.0), (None, 1.0, 1.0)], "m struct<id:string,bleed_mm:double,safe_mm:double,max_width_mm:double,spec_position:string>, width_mm double, height_mm double")
    from platen.schemas import MATERIAL

    df = df.withColumn("material", F.when(F.col("m").isNotNull(), F.struct(*[(F.col(f"m.{n}") if n in ("id", "bleed_mm", "safe_mm", "max_width_mm", "spec_position") else F.lit(None)).cast(t).alias(n) for n, t in MATERIAL.items()])))
    got = [r["item"] for r in items.resolved(df).collect()]
    assert got[0]["netto_mm"] == [1000, 2000] and got[0]["brutto_mm"] == [1040, 2040] and got[0]["safe_mm_box"] == [940, 1940] and got[0]["scale"] == 1
    assert got[1]["scale"] == 2 and got[1]["spec_position"] == "below" and got[1]["strip_mm"] == 22 and got[1]["notices"] == ["scaled"]
    assert got[2]["problem"] == "safe_area_eats_job" and got[3]["problem"] == "unknown_material"


@pytest.mark.parametrize(
    ("name", "size"),
    [("baner_800x2000mm.pdf", (800, 2000, True)), ("76cm x 37cm", (760, 370, True)), ("1,5m x 3m", (1500, 3000, True)), ("300x150a.tif", (300, 150, False)), ("760x370mm", (760, 370, True)), ("100x200makieta", (100, 200, False)), ("no size", None), ("0x5cm", None), (None, None), ("5×7 CM", (50, 70, True))],
)
def test_sizes_in_names(spark, name, size):
    got = one(spark, names.named_size(lit(name).cast("string")))
    assert (got and tuple(got)) == size


@pytest.mark.parametrize(("name", "ext", "dots", "marks"), [("a.pdf", "pdf", False, False), ("a.b.PDF", "pdf", True, False), ("łąka.tif", "tif", False, True), ("ł.tif", "tif", False, False), ("plain", "", False, False), (".hidden", "", True, False), (None, "", False, False)])
def test_name_facts(spark, name, ext, dots, marks):
    n = lit(name).cast("string")
    assert one(spark, F.struct(names.extension(n), names.extra_dots(n), names.has_diacritics(names.stem(n)))) == (ext, dots, marks)


def test_number_texts(spark):
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.25,), (0.75,), (1234.0,)], "x double").select(numbers.whole(F.col("x")).alias("w"), numbers.tenth(F.col("x")).alias("t"), numbers.length(F.col("x")).alias("l")).collect()
    assert [r["w"] for r in halves] == ["0", "2", "2", "0", "1", "1234"] and [r["t"] for r in halves][3:5] == ["0.2", "0.8"] and halves[5]["l"] == "1.23 m"
    assert one(spark, numbers.clamped(lit(float("nan")), 0.0, 9.0, 5.0)) == 5.0
    assert [one(spark, numbers.true_text(lit(x).cast("string"))) for x in ("nie", " 0 ", None, "tak", "TRUE")] == [False, False, False, True, True]


def test_easter_and_working_days(spark):
    day = lambda s: lit(s).cast("date")
    assert str(one(spark, dates.easter(lit(2026)))) == "2026-04-05" and str(one(spark, dates.easter(lit(2024)))) == "2024-03-31"
    assert str(one(spark, dates.working_days_before(day("2026-10-05"), 2))) == "2026-10-01" and str(one(spark, dates.working_days_before(day("2026-11-12"), 2))) == "2026-11-09"
    assert str(one(spark, dates.warehouse_day(day("2026-09-14"), day("2026-09-19")))) == "2026-09-14" and str(one(spark, dates.warehouse_day(day(None), day("2026-09-19")))) == "2026-09-17"
    assert one(spark, dates.warehouse_day(day(None), day(None))) is None
    easters = spark.range(1900, 2200).select("id", dates.easter(F.col("id").cast("int")).alias("e")).collect()
    for r in easters:  # the classic golden-number steps
        y = r["id"]
        a, b, c = y % 19, y // 100, y % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        el = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = (a + 11 * h + 22 * el) // 451
        n = h + el - 7 * m + 114
        assert r["e"] == datetime.date(y, n // 31, n % 31 + 1)


GATES = [("gate53", "Gate 53", 2300.0, 2300.0, 0, [(725, 353), (353, 412), (353, 412), (726, 112)]), ("gate64", "Gate 64", 2300.0, 2300.0, 1, [(825, 403), (403, 462), (403, 462), (826, 122)]), ("flag", "Flag", 800.0, 2400.0, 2, [(633, 2200)])]


def ranked(spark, uploads, page=(2300.0, 2300.0)):
    templates = spark.createDataFrame([g[:5] for g in GATES], "token string, name string, page_w double, page_h double, ord int")
    cuts = spark.createDataFrame([(g[0], i, "cut", float(w), float(h)) for g in GATES for i, (w, h) in enumerate(g[5])], "token string, ord int, type string, w double, h double")
    up = spark.createDataFrame([("f", *u) for u in uploads], "file_id string, w double, h double, closed boolean")
    return outlines.ranked(templates, cuts, up, spark.createDataFrame([("f", *page)], "file_id string, page_w double, page_h double"))


def test_templates_by_their_outlines(spark):
    got = ranked(spark, [(725.3, 353.1, True), (353.0, 412.4, True), (2000.0, 5.0, False)])
    assert [(r["token"], r["matched"], r["outlines"]) for r in got.orderBy("place").collect()] == [("gate53", 3, 4), ("gate64", 0, 4)]
    assert outlines.decisive(got).first()["token"] == "gate53"
    few = ranked(spark, [(726.0, 112.0, True)])
    assert few.orderBy("place").first()["matched"] == 1 and outlines.decisive(few).count() == 0
    assert ranked(spark, [(1.0, 1.0, True)], (800.0, 2403.0)).first()["token"] == "flag" and ranked(spark, [(1.0, 1.0, True)], (500.0, 500.0)).count() == 0


def test_boxes_by_role(spark):
    rows = [("t", "cut", False, 0.0, 0.0, 440.0, 740.0, 500.0, 800.0, 20.0, 45.0), ("u", "sew", True, 5.0, 5.0, 100.0, 60.0, 500.0, 800.0, 20.0, 45.0), ("v", "cut", False, 0.0, 0.0, None, 740.0, None, None, 20.0, 45.0)]
    df = spark.createDataFrame(rows, "token string, type string, safe_base boolean, x double, y double, w double, h double, page_w double, page_h double, bleed_mm double, safe_mm double")
    got = {r["token"]: r for r in outlines.role_boxes(df).collect()}
    assert got["t"]["netto"] == [440, 740] and got["t"]["brutto"] == [480, 780] and got["t"]["safe"] == [350, 650]
    assert got["u"]["netto"] is None and got["u"]["brutto"] == [500, 800] and got["u"]["safe"] is None and got["u"]["safe_from"] == "base"
    assert got["v"]["netto"] is None and got["v"]["brutto"] is None


def test_order_texts(spark):
    assert one(spark, orders.addresses(lit("a@b.pl, A@B.pl; x /c@d.e junk@"))) == ["a@b.pl", "c@d.e"]
    assert [one(spark, orders.plural(lit(n), "adres", "adresy", "adresów")) for n in (1, 2, 5, 12, 22, 112)] == ["1 adres", "2 adresy", "5 adresów", "12 adresów", "22 adresy", "112 adresów"]
    assert one(spark, orders.status(lit(" TRANSPORT "))) == "transport" and one(spark, orders.status(lit("Wyceny"))) is None
    assert one(spark, orders.shipping_line(lit("dhl"), lit("1 2"))) == "DHL, tracking 1 2: https://www.dhl.com/pl-en/home/tracking.html?tracking-id=1%202"
    assert one(spark, orders.shipping_line(lit("Spedycja"), lit(""))) == "SUPPLY CHAIN" and one(spark, orders.shipping_line(lit(""), lit(None).cast("string"))) is None
    assert one(spark, orders.shipping_line(lit("Foo"), lit("9"))) == "Foo, tracking 9" and one(spark, orders.escaped(lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    ics = one(spark, orders.calendar(lit("A, b"), lit("2026-09-01").cast("date"), lit("2026-09-03").cast("date"), lit("x\ny"), lit("k|s"), lit("2026-01-01 00:00:00").cast("timestamp")))
    assert "DTEND;VALUE=DATE:20260904" in ics and "SUMMARY:A\\, b" in ics and "DESCRIPTION:x\\ny" in ics and ics.endswith("END:VCALENDAR")
    assert one(spark, orders.rows_label(lit(6), lit(7))) == "rows 6–7"


FJORD = [("001/09", "Ola", "ola@x.pl"), ("001/09", "Nola", "Nola@x.pl"), ("001/09", "Pola", "pola@x.pl")]


def test_groups_and_pending(spark):
    rows = [(i + 2, *r, "P" + str(i), "Produkcja") for i, r in enumerate(FJORD)] + [(6, "003/09", "Kari", "kari@x.pl", "Round table", "Produkcja"), (7, "003/09", "Kari", "KARI@x.pl", "Shelving", "Produkcja")]
    df = spark.createDataFrame(rows, "ord int, code string, pm string, email string, product string, status string")
    none = lit(None).cast("string")
    df = df.withColumn("group", orders.group_key(F.col("code"), none, none, F.col("pm"), F.col("email"), none.cast("date")))
    groups = {r["group"]: r["n"] for r in df.groupBy("group").agg(F.array_sort(F.collect_list("ord")).alias("n")).collect()}
    assert len(groups) == 4 and groups["003/09|kari@x.pl"] == [6, 7]
    key, at = "003/09|kari@x.pl", lambda h: datetime.datetime(2026, 9, 1, h)
    log = [(at(1), key, "Produkcja", "kari@x.pl", "round TABLE")]
    schema = "sent_at timestamp, group string, status string, recipients string, items string"
    wait = lambda log: sorted(r["ord"] for r in orders.pending(df.filter("ord >= 6"), spark.createDataFrame(log, schema)).collect())
    assert wait(log) == [7]
    assert wait([*log, (at(2), key, "Produkcja", orders.INVALIDATED, "")]) == [6, 7]
    assert wait([*log, (at(2), key, "Produkcja", orders.INVALIDATED, ""), (at(3), key, "Produkcja", "kari@x.pl", "Shelving | x")]) == [6]
    assert wait([(at(1), key, "Produkcja", "nobody", "Shelving")]) == [6, 7]
    firsts = orders.first_filled(df, ["code"], "ord", ["product"]).filter("code = '003/09'").first()
    assert firsts["product"] == "Round table"
    shipped = df.withColumn("warehouse_email", lit("M@x.pl")).withColumn("day", lit("2026-09-16").cast("date"))
    told = orders.digest(shipped.filter("ord >= 6"), F.col("day").isNotNull(), F.col("day")).collect()
    assert [(r["address"], r["rows"], r["products"]) for r in told] == [("m@x.pl", 2, ["Round table", "Shelving"])]


def test_lists(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, ord int")
    moved = orders.reordered(df, spark.createDataFrame([("c", 0), ("x", 1)], "id string, pos int"))
    assert [r["id"] for r in moved.orderBy("ord").collect()] == ["c", "a", "b"]
    assert sorted(tuple(r) for r in orders.upserted(df, spark.createDataFrame([("b", 9), ("d", 3)], df.schema)).collect()) == [("a", 0), ("b", 9), ("c", 2), ("d", 3)]


def test_state(spark):
    at = lambda m, s=0: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m, seconds=s)
    df = spark.createDataFrame([(1, at(m)) for m in (0, 20, 29, 31, 50, 62, 200)] + [(2, at(0)), (2, at(30)), (2, at(60, 1)), (3, None)], "u int, at timestamp")
    assert sorted((r["u"], r["told_at"]) for r in state.throttled(df, "u", "at").collect()) == [(1, at(m)) for m in (0, 31, 62, 200)] + [(2, at(0)), (2, at(30)), (2, at(60, 1))]
    held = [(r["started"], r["events"]) for r in state.sessions(df.filter("u = 2"), "u", "at").orderBy("started").collect()]
    assert held == [(at(0), 2), (at(60, 1), 1)]
    files = spark.createDataFrame([("a", at(0), 50), ("b", at(1000), 60), ("c", at(2000), 30), ("d", at(-90000), 1)], "f string, at timestamp, bytes long")
    assert [r["f"] for r in state.kept(files, "at", "bytes", lit(at(2000)), 30, 100, "f").orderBy("f").collect()] == ["b", "c"]
    flags = spark.createDataFrame([("k", i, f) for i, f in enumerate([True, False, True, True, True])], "k string, i int, f boolean")
    assert state.first_run(flags, ["k"], "i", "f", 3).first()["begin"] == 2 and state.first_run(flags, ["k"], "i", "f", 4).first()["begin"] is None
    tiles = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1), (5, 1), (0, 2))], "page int, x int, y int")
    assert sorted(tuple(r) for r in state.merged_tiles(tiles).collect()) == [(1, 0, 0, 1, 1), (1, 0, 2, 0, 2), (1, 5, 1, 5, 1)]


def test_stream_equals_batch_in_order(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = {tuple(r) for r in state.throttled(spark.read.parquet(path), "user_id", "ts", 360).collect()}
    source = str(tmp_path / "in")
    spark.read.parquet(path).select("user_id", "ts").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(source)
    query = quiet.throttled(stream, 360).writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("told").collect()} == batch


def test_windows_that_can_no_longer_change(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, at(1), "a"), (2, at(2), "a"), (3, at(6), "b"), (4, at(40), "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = quiet.counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["event_type"], r["n"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]  # the last window may still change


def test_ticks_send_once(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("g", "Produkcja", "Table", "k@x.pl"), ("g", "Produkcja", "Chair", "k@x.pl"), ("h", "Produkcja", "Desk", "nobody"), ("i", "transport", "Lamp", "l@x.pl")], "group string, status string, product string, pm_email string")
    log = str(tmp_path / "log")
    spark.createDataFrame([(at, "g", "Produkcja", "k@x.pl", "chair")], ticks.LOG).write.parquet(log)
    source = str(tmp_path / "in")
    spark.createDataFrame([("g", "Produkcja", at), ("h", "Produkcja", at), ("g", "Produkcja", at)], "group string, status string, ticked_at timestamp").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("group string, status string, ticked_at timestamp").parquet(source)
    for _ in range(2):  # a batch that runs again sends nothing
        ticks.on_ticks(stream(), lambda: rows, log).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted((r["group"], r["items"]) for r in spark.read.schema(ticks.LOG).parquet(log).collect()) == [("g", "chair"), ("g", "table")]


def square(n):
    return F.array(*[geometry.point(x, y) for x, y in ((0, 0), (n, 0), (n, n), (0, n))])


def test_geometry(spark):
    ring = square(10)
    assert one(spark, geometry.signed_area(ring)) == 100 and one(spark, geometry.perimeter(ring)) == 40 and one(spark, geometry.signed_area(F.slice(ring, 1, 2))) == 0
    assert one(spark, geometry.inside(ring, lit(5.0), lit(5.0))) and not one(spark, geometry.inside(ring, lit(15.0), lit(5.0)))
    assert one(spark, geometry.distance_to_ring(ring, lit(5.0), lit(3.0))) == 3 and one(spark, geometry.distance_to_ring(ring, lit(13.0), lit(14.0))) == 5
    assert one(spark, geometry.clipped(lit(-5.0), lit(5.0), lit(5.0), lit(5.0), lit(10.0), lit(10.0))) == (0, 5, 5, 5)
    assert one(spark, geometry.clipped(lit(-5.0), lit(-5.0), lit(-1.0), lit(5.0), lit(10.0), lit(10.0))) is None and one(spark, geometry.clipped(lit(float("inf")), lit(0.0), lit(1.0), lit(5.0), lit(10.0), lit(10.0))) is None
    box = one(spark, geometry.box(geometry.curve(geometry.point(0, 0), geometry.point(0, 10), geometry.point(10, 10), geometry.point(10, 0))))
    assert box["x1"] == 10 and box["y1"] == pytest.approx(7.5)
    assert one(spark, F.size(geometry.thinned(F.array_repeat(geometry.point(0, 0), 1001)))) == 335
    box = lambda *v: F.struct(*[lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    fit = one(spark, geometry.fit_orientation(box(0, 0, 2, 1), box(0, 0, 10, 20)))
    assert fit["turn"] == 1 and fit["error"] == pytest.approx(0) and [fit[f"a{k}"] * 2 + fit[f"c{k}"] for k in "uv"] == [10, 20]  # a corner goes to the next
    assert one(spark, geometry.fit_orientation(box(0, 0, 1, 1), box(0, 0, 3, 3)))["turn"] == 0 and one(spark, geometry.fit_orientation(box(0, 0, 1e-12, 1), box(0, 0, 3, 3))) is None
    flat = one(spark, geometry.fit_orientation(box(0, 0, 2, 1), box(0, 0, 3, 0)))
    assert flat["error"] == pytest.approx(np.log(3e9 / 2)) and flat["av"] == flat["bv"] == 0 and one(spark, geometry.fit_orientation(box(0, 0, 2, 1), F.struct(lit(0.0).alias("x0"), lit(0.0).alias("y0"), lit(None).cast("double").alias("x1"), lit(1.0).alias("y1")))) is None
    hole = F.array(square(10), F.array(*[geometry.point(x, y) for x, y in ((2, 2), (8, 2), (8, 8), (2, 8))]))
    assert one(spark, geometry.in_polygons(hole, lit(1.0), lit(1.0))) and not one(spark, geometry.in_polygons(hole, lit(5.0), lit(5.0)))
    assert one(spark, F.size(geometry.flattened(geometry.point(0, 0), geometry.point(0, 10), geometry.point(10, 10), geometry.point(10, 0)))) == int((30 / 0.05) ** 0.5 + 1)
    assert one(spark, geometry.mirrored(F.array(geometry.point(1, 2)), lit(10.0), lit(20.0), lit(True)))[0] == (9, 18)
    assert one(spark, items.eyelets(lit(1000.0), lit(300.0))) == [0, 250, 500, 750, 1000] and one(spark, items.seams(lit(3500.0), lit(1600.0))) == [1600, 3200] and one(spark, items.seams(lit(1600.5), lit(1600.0))) == []


def test_meshes(spark):
    t = spark.createDataFrame([(1, i, *v) for i, v in enumerate([(0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7)])] + [(2, 0, 5, 6, 7), (2, 1, 0, 1, 2), (2, 2, 2, 7, 9)], "mesh long, t long, v0 long, v1 long, v2 long")
    got = {(r["mesh"], r["t"]): r["island"] for r in mesh.islands(t).collect()}
    assert [got[1, i] for i in range(4)] == [0, 0, 1, 1] and [got[2, i] for i in range(3)] == [0, 0, 0]
    pts = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (7.0, 3.0)]
    df = spark.createDataFrame([("a", x, y, 2 * x - y + 5) for x, y in pts] + [("line", float(i), 2.0 * i, 1.0) for i in range(4)], "k string, x double, y double, u double")
    fit = {r["k"]: r for r in mesh.affine_fit(df, ["k"], "x", "y", "u").collect()}
    assert (fit["a"]["a"], fit["a"]["b"], fit["a"]["c"], fit["a"]["residual"]) == pytest.approx((2, -1, 5, 0), abs=1e-9) and fit["line"]["a"] is None
    assert {r["k"]: r["collinear"] for r in mesh.collinear(df, "k").collect()} == {"a": False, "line": True}


def test_maps_in_space(spark):
    rng = np.random.default_rng(4)
    true = np.array([[2.0, -1.0, 0.5, 3.0], [0.25, 4.0, -2.0, -7.0]])
    groups = {"any": rng.normal(size=(40, 3)) * 50, "few": rng.normal(size=(3, 3)), "line": np.arange(9)[:, None] * np.array([1.0, -2.0, 3.0]) + 5, "point": np.full((6, 3), 2.0)}
    flat = rng.normal(size=(30, 2)) * 20
    groups["flat"] = flat @ np.array([[1.0, 0.0, 2.0], [0.0, 1.0, -1.0]]) + np.array([0.0, 0.0, 4.0])
    noise = {"any": 0.3, "flat": 0.2}
    rows = [(k, *map(float, p), *map(float, true @ [*p, 1] + rng.normal(size=2) * noise.get(k, 0))) for k, ps in groups.items() for p in ps] + [("any", None, 1.0, 1.0, 1.0, 1.0)]
    got = {r["k"]: r for r in mesh.space_fit(spark.createDataFrame(rows, "k string, x double, y double, z double, u double, v double"), ["k"], "x", "y", "z", "u", "v").collect()}
    assert all(got[k]["au"] is None and got[k]["residual_u"] is None for k in ("few", "line", "point"))
    for k in ("any", "flat"):
        own = np.array([r[1:] for r in rows if r[0] == k and r[1] is not None])
        a = np.column_stack([own[:, :3], np.ones(len(own))])
        want = np.linalg.lstsq(a, own[:, 3:], rcond=None)[0]  # of all best maps the smallest
        assert got[k]["flat"] == (k == "flat")
        for n, w in zip("uv", want.T, strict=True):
            assert [got[k][f"{c}{n}"] for c in "abcd"] == pytest.approx(w, abs=1e-5)
            assert got[k][f"residual_{n}"] == pytest.approx(np.abs(a @ w - own[:, 3 + "uv".index(n)]).max(), abs=1e-5)


def test_islands_of_any_shape(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(1, i, i, i + 1, i + 2) for i in range(300)]  # a strip, the worst for passing labels on
    rows += [(2, i, 0, 1000 + 2 * i, 1001 + 2 * i) for i in range(400)] + [(2, 900, 5, 6, 7)]  # a vertex in nearly every triangle
    rows += [(3, i, *map(int, rng.integers(0, 150, 3))) for i in range(60)] + [(3, 99, 4, 4, 4), (4, 7, 1, 2, 3), (4, 8, None, 2, 3)]
    df = spark.createDataFrame(rows, "mesh long, t long, v0 long, v1 long, v2 long").repartition(5)
    want, parents = {}, {}

    def top(x):
        while parents.setdefault(x, x) != x:
            x = parents[x]
        return x

    for m, _, *vs in rows:
        for v in vs[1:] if None not in vs else []:
            parents[top((m, v))] = top((m, vs[0]))
    numbers = {}
    for m, t, *vs in rows:  # by falling age within a mesh
        if None not in vs:
            want[m, t] = numbers.setdefault(m, {}).setdefault(top((m, vs[0])), len(numbers[m]))
    for hot in (1000, 2):
        monkeypatch.setattr(components, "HOT", hot)
        got = {(r["mesh"], r["t"]): r["island"] for r in mesh.islands(df).collect()}
        assert got == want | {(4, 8): None}
    assert mesh.islands(df.limit(0)).count() == 0


def test_small_parts_are_done_within_tasks_and_large_ones_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(p, int(a), int(b)) for p in range(40) for a, b in rng.integers(0, 60, (40, 2))] + [(50, i, i + 1) for i in range(300)] + [(51, 7, 7), (52, 1, None), (None, 1, 2)]
    links = spark.createDataFrame(rows, "mesh long, a long, b long").repartition(5)
    parents, want = {}, {}

    def top(x):
        while parents.setdefault(x, x) != x:
            x = parents[x]
        return x

    for p, a, b in rows:
        if p is not None and b is not None:
            one_, other = sorted((top((p, a)), top((p, b))))
            parents[other] = one_
    want = {x: top(x)[1] for x in list(parents)}
    result = lambda: {(r["mesh"], r["node"]): r["root"] for r in components.components(links).collect()}
    for small in (100, 0):
        monkeypatch.setattr(components, "SMALL", small)
        assert result() == want
    monkeypatch.setattr(components, "SMALL", 100_000)
    monkeypatch.setattr(components, "_by_joins", None)  # no round of joins for parts that fit a task
    assert result() == want


def laid(spark, islands, boxes):
    columns = "x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(islands)], f"mesh long, island int, {columns}")
    right = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], f"mesh long, box int, {columns}")
    return {r["island"]: r["box"] for r in mesh.assigned(left, right).collect()}


def test_islands_choose_page_boxes(spark):
    assert laid(spark, [(0, 0, 1, 1), (0, 0, 3, 3)], [(0, 0, 0.2, 0.2), (0.5, 0.5, 0.9, 0.9)]) == {1: 1, 0: 0}  # equal shapes: the largest take the largest
    assert laid(spark, [(0, 0, 4, 1), (0, 0, 2, 2)], [(0, 0, 0.4, 0.4), (0, 0.5, 0.4, 0.6)]) == {0: 1, 1: 0}  # a clearly better shape beats size
    assert laid(spark, [(0, 0, 1, 1), (0, 0, 2, 2), (0, 0, 3, 3)], [(0, 0, 0.5, 0.5)]) == {0: 0, 1: 0, 2: 0}  # none to spare: shared
    assert laid(spark, [(0, 0, 1, 1), (0, 0, 0, 5)], [(0, 0, 0.5, 0.5), (0, 0, 0.4, 0.4)]) == {0: 0} and laid(spark, [(0, 0, 1, 1)], []) == {}
    assert laid(spark, [(0, 0, 1, 1)], [(0, 0, 1, 0), (0, 0, 0.5, 0.5)]) == {0: 1} and laid(spark, [(0, 0, 1, 1)], [(0, 0, 1, 0)]) == {0: 0}  # a page box of no height fits worst
    assert laid(spark, [(0, 0, 1, 1), (float("nan"), 0, 1, 1)], [(1, 1, 0, 0.5), (float("nan"), 0, 1, 1)]) == {}


def picture(spark, *pages):
    rows = [(i, p.shape[1], bytes(p.tobytes())) for i, p in enumerate(pages)]
    return raster.pixels(spark.createDataFrame(rows, "id long, width int, pixels binary"))


def plain_edges(page, per_mm):
    """Blank edges as the words say: lines inked to 55 %, two millimetres of them in a row."""
    mask = (page < 250).any(axis=2)
    if not mask.any():
        return [mask.shape[1] / 2 / per_mm] * 4
    n, out = max(2, round(2 * per_mm)), []
    for lines in (mask.mean(axis=0), mask.mean(axis=1), mask.mean(axis=0)[::-1], mask.mean(axis=1)[::-1]):
        flags = lines >= 0.55
        out.append(next((i for i in range(len(flags) - n + 1) if flags[i : i + n].all()), len(flags) / 2) / per_mm)
    return out


def test_rasters(spark):
    rng = np.random.default_rng(2)
    white, block = np.full((40, 60, 3), 255, np.uint8), np.full((40, 60, 3), 255, np.uint8)
    block[10:36, 6:50] = 0
    some = [np.where(np.repeat(np.repeat(rng.random((8, 12)) < p, 5, 0), 5, 1)[..., None], 0, 255).astype(np.uint8).repeat(3, 2) for p in (0.5, 0.7, 0.9)]
    pages = [white, block, *some]
    px = picture(spark, *pages)
    got = {r["id"]: [r[s] for s in raster.SIDES] for r in raster.blank_edges(px, 1.0).collect()}
    assert got == {i: plain_edges(p, 1.0) for i, p in enumerate(pages)} and got[1] == [6, 10, 10, 4] and got[0] == [30] * 4
    guide = np.full((40, 40, 3), 255, np.uint8)
    guide[10, :] = 0
    beside = guide.copy()
    beside[12:16, :] = 0
    assert {r["id"]: r["guides_present"] for r in raster.guides(picture(spark, guide, beside, white), 1.0, 10.0).collect()} == {0: True, 1: False, 2: False}
    assert raster.largest_rectangle(block[..., 0] == 255) == (0, 0, 60, 10) and raster.largest_rectangle(np.zeros((2, 2), bool)) is None
    free = raster.free_rectangles(px.filter("id = 1").select("id", "x", "y", (~raster.ink()).alias("free"))).first()
    assert tuple(free) == (1, 0, 0, 60, 10)
    cells = spark.range(25).select(F.lit(1).cast("long").alias("id"), (F.col("id") % 5).alias("x"), F.floor(F.col("id") / 5).alias("y"))
    assert raster.cleared(cells, cells.filter("x = 2 and y = 2"), 1).filter("free").count() == 16
    assert picture(spark, np.zeros((0, 0, 3), np.uint8)).count() == 0


def test_intrusions(spark):
    board = np.full((100, 100, 3), 255, np.uint8)
    board[20:40:2, 5:45] = 0
    deep = lambda **depths: raster.intrusions(picture(spark, board), dict.fromkeys(raster.SIDES, 0.0) | depths, 1.0)
    regions, depth = deep(left=30.0)
    assert depth.first()["intrusion_mm"] == 30 and [tuple(r)[1:] for r in regions.collect()] == [(0, 20, 30, 30)] or depth.first()["intrusion_mm"] > 20
    assert deep(right=30.0)[1].first()["intrusion_mm"] == 0 and deep()[1].first()["intrusion_mm"] == 0 and deep(left=60.0, right=50.0)[1].first()["intrusion_mm"] == 0
    frame = np.full((100, 100, 3), 255, np.uint8)
    for k in range(0, 100, 2):  # a ring of detail: its union is hollow, so it stays in strips
        frame[k, :8] = frame[k, 92:] = frame[:8, k] = frame[92:, k] = 0
    regions, depth = raster.intrusions(picture(spark, frame), dict.fromkeys(raster.SIDES, 10.0), 1.0)
    assert regions.count() > 1 and depth.first()["intrusion_mm"] == 10
    strips = spark.createDataFrame([(1, x, y) for y in range(4) for x in range(5 - y % 2)], "page long, x long, y long")
    sizes = spark.createDataFrame([(1, 100, 100)], "id long, width long, height long")
    assert [tuple(r) for r in raster.regions(strips, sizes, 1.0).collect()] == [(1, 0, 0, 50, 40)]  # runs of 50 and 40 fuse into one block


def test_shop_document(spark, tmp_path):
    assert shop.document(spark, str(tmp_path / "none.json")).count() == 0
    doc = {"version": 1, "materials": [{"id": "mesh", "name": "Mesh", "bleed_mm": 20, "safe_mm": 40}, {"id": "Bad Id", "name": "x", "bleed_mm": 1, "safe_mm": 1}, {"id": "deep", "name": "x", "bleed_mm": 501, "safe_mm": 1}, {"id": "twin", "name": "x", "bleed_mm": 1, "safe_mm": 1}, {"id": "twin", "name": "y", "bleed_mm": 1, "safe_mm": 1}, {"id": "c", "name": "x", "bleed_mm": 1, "safe_mm": 1, "colour": "rgb"}, {"id": "n", "bleed_mm": 1, "safe_mm": 1}], "rules": {"fonts": "off", "new": "amber", "x": "loud"}, "messages": {"a": "b"}}
    (tmp_path / "shop.json").write_text(json.dumps(doc))
    got = shop.document(spark, str(tmp_path / "shop.json"))
    assert [r["problem"] for r in shop.materials(got).orderBy("ord").collect()] == [None, "id", "bleed_mm", "duplicate id", "duplicate id", "colour", "name"]
    assert {tuple(r) for r in shop.levels(got).collect()} == {("fonts", "off"), ("new", "amber")} and shop.wording(got).first()["template"] == "b"


def test_order_sheet(spark, tmp_path):
    text = '"Produkt",STAN,Klient,Projekt,pm,"Numer śledzenia\nhint",Data dostawy do klienta\nTable,Produkcja,N,F,Kari,"1,2",2026-09-19\nChair,,N,F,Kari,,bad\n'
    (tmp_path / "s.csv").write_text(text, encoding="utf-8")
    rows = sheet.orders(spark, str(tmp_path / "s.csv")).orderBy("ord").collect()
    assert rows[0]["product"] == "Table" and rows[0]["tracking"] == "1,2" and str(rows[0]["delivery"]) == "2026-09-19" and rows[0]["leader"] is None and rows[1]["delivery"] is None
    (tmp_path / "t.csv").write_text("Produkt\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Stan"):
        sheet.orders(spark, str(tmp_path / "t.csv"))


def ring_of(points):
    return F.array(*[geometry.point(float(x), float(y)) for x, y in points])


def test_polygons(spark):
    area = lambda ring: one(spark, geometry.signed_area(ring))
    for points, sign in (([(0, 0), (100, 0), (100, 100), (0, 100)], 1), ([(0, 100), (100, 100), (100, 0), (0, 0)], -1)):
        for by, side in ((-10, 80), (5, 110)):
            moved = one(spark, polygons.offset(ring_of(points), by))
            assert moved["problem"] is None and area(ring_of([(p["x"], p["y"]) for p in moved["ring"]])) == pytest.approx(sign * side * side)  # the direction stays
    square_ = ring_of([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])
    assert one(spark, polygons.offset(square_, -60))["problem"] == "nothing left" and one(spark, polygons.offset(ring_of([(0, 0), (1, 1)]), 1))["problem"] == "too few points"
    star = [(np.cos(a) * r, np.sin(a) * r) for a, r in zip(np.linspace(0, 2 * np.pi, 24, endpoint=False), [100, 70] * 12, strict=True)]
    inner = one(spark, F.forall(polygons.offset(ring_of(star), -8)["ring"], lambda p: (geometry.distance_to_ring(ring_of(star), p["x"], p["y"]) >= 0.98 * 8) & geometry.inside(ring_of(star), p["x"], p["y"])))
    assert inner
    assert abs(area(polygons.clip(square_, 50, -10, 200, 50))) == 2500 and one(spark, F.size(polygons.clip(square_, 200, 200, 300, 300))) == 0
    even = one(spark, polygons.resampled(ring_of([(0, 0), (100, 0), (100, 100), (0, 100)]), 8))
    assert [tuple(p) for p in even] == [(0, 0), (50, 0), (100, 0), (100, 50), (100, 100), (50, 100), (0, 100), (0, 50)]
    rings = spark.range(1).select(F.col("id"), square_.alias("ring"))
    assert tuple(polygons.inscribed_boxes(rings, 10).first()) == (0, 0, 0, 100, 100)


def test_dies(spark):
    box = ring_of([(4, 4), (36, 4), (36, 36), (4, 36)])
    rings = spark.range(1).select("id", box.alias("ring"))
    page = np.full((40, 40, 3), 255, np.uint8)
    page[:, :20] = 0
    px = picture(spark, page)
    points = die.samples(rings, 4.0).collect()
    assert len(points) == 4 * 8 and all(r["nx"] ** 2 + r["ny"] ** 2 == pytest.approx(1) for r in points)
    assert all((r["x"] + r["nx"] > 36) or (r["x"] + r["nx"] < 4) or (r["y"] + r["ny"] > 36) or (r["y"] + r["ny"] < 4) for r in points)
    assert die.bare_perimeter(rings, px, 1.0, 2.0).first()["bare"] == pytest.approx(0.5, abs=0.05)
    page[:] = 255
    page[8:32, 8:32] = 0
    short = die.bleed_shortfall(rings, picture(spark, page), 1.0, 10.0).first()
    assert short["share"] > 0.7 and 4 <= short["missing_mm"] <= 5  # from the far sides a pixel more
    assert die.bleed_shortfall(rings, picture(spark, np.full((40, 40, 3), 255, np.uint8)), 1.0, 10.0).first()["share"] == 0
    rows = np.full((60, 60, 3), 255, np.uint8)
    rows[4:36, 4:36] = 0
    rows[47:56, 47:56] = 0  # of the second contour only the inner part
    two = spark.range(1).select("id", F.explode(F.array(box, ring_of([(40, 40), (60, 40), (60, 60), (40, 60)]))).alias("ring"))
    alone = [die.bleed_shortfall(two.filter(F.get("ring", F.lit(0))["x"] == x), picture(spark, rows), 1.0, 8.0).first()["share"] for x in (4, 40)]
    taken = [die.samples(two.filter(F.get("ring", F.lit(0))["x"] == x), 4.0, outward=False).count() for x in (4, 40)]
    both = die.bleed_shortfall(two, picture(spark, rows), 1.0, 8.0).first()["share"]
    assert alone[0] == 0 and alone[1] > 0.3 and both == pytest.approx((alone[0] * taken[0] + alone[1] * taken[1]) / sum(taken), abs=1e-3)
    assert die.samples(two, 4.0).groupBy("ring_no").count().count() == 2
    twice = spark.range(2).select(F.lit("f").alias("file_id"), box.alias("ring"), (F.col("id") == 1).alias("closed"), F.lit(False).alias("filled"), F.lit("Cut").alias("colorant"))
    rolled = die.rolled_up(twice).first()
    assert (rolled["contours"], rolled["length_mm"], rolled["closed"], rolled["x1"]) == (1, 128, True, 36)


def test_held_uploads_by_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(1, 3), datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 200)), rng.randint(1, 60), i) for i in range(120)] + [(4, None, 1, 999), (5, datetime.datetime(2026, 1, 1), 500, 1000)]
    got = {tuple(r) for r in state.evicted(spark.createDataFrame(rows, "k long, at timestamp, n long, i long"), "k", "at", "n", "i", 30, 100).collect()}
    want = set()
    for k in (1, 2, 3, 5):
        held = []
        for _, at, n, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3])):
            held = [h for h in held if h[0] + datetime.timedelta(minutes=30) >= at]
            while held and sum(h[1] for h in held) + n > 100:
                held.remove(min(held, key=lambda h: h[0]))
            held.append((at, n, i))
        want |= {(k, i) for _, _, i in held}
    assert got == want


def test_a_hot_key_streams(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(1, at + datetime.timedelta(minutes=m)) for m in range(3000)] + [(None, at), (None, at)]
    got = state.throttled(spark.createDataFrame(rows, "u int, at timestamp"), "u", "at").groupBy("u").count().collect()
    assert {r["u"]: r["count"] for r in got} == {1: 100, None: 1}


def png(w, h, depth, colour, *chunks):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + b"".join(chunk(*c) for c in chunks) + chunk(b"IDAT", b"")


def test_raster_headers(spark):
    import struct

    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x01\x01,\x01,\x00\x00\xff\xc0\x00\x14\x08\x00\x20\x00\x40\x04" + bytes(12)
    made = {"a": png(300, 600, 8, 6, (b"pHYs", struct.pack(">IIB", 11811, 11811, 1))), "b": png(5, 5, 1, 0), "c": png(5, 5, 8, 3, (b"tRNS", b"x")), "d": jpeg, "e": b"%PDF-1.7", "f": None, "g": png(30000, 30000, 8, 2), "h": png(10, 10, 8, 2, (b"pHYs", struct.pack(">IIB", 10, 10, 1))), "i": b"\x89PNG\r\n\x1a\n"}
    got = {r["path"]: r for r in files.raster_headers(spark.createDataFrame(list(made.items()), "path string, content binary")).collect()}
    assert (got["a"]["mode"], got["a"]["alpha"], got["a"]["colour_space"]) == ("RGBA", True, "DeviceRGB") and got["a"]["width_mm"] == pytest.approx(25.4, abs=0.01)
    assert got["b"]["mode"] == "1" and (got["c"]["colour_space"], got["c"]["alpha"]) == ("Indexed", True) and (got["d"]["mode"], got["d"]["width"], got["d"]["dpi_x"]) == ("CMYK", 64, 300)
    assert [got[k]["reason"] for k in "efgi"] == ["no known picture", "no known picture", "too many pixels", "damaged: KeyError"] and got["h"]["width_mm"] is None


def glb(doc, blob):
    import struct

    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(blob), 0x004E4942) + blob
    return struct.pack("<III", 0x46546C67, 2, 12 + len(body)) + body


def test_glb(spark):
    import struct

    blob = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<6H", 0, 0, 65535, 0, 0, 65535) + struct.pack("<3H", 0, 1, 2)
    doc = {"meshes": [{"primitives": [{"attributes": {"POSITION": 0, "TEXCOORD_0": 1}, "indices": 2}]}], "bufferViews": [{"byteOffset": 0}, {"byteOffset": 36}, {"byteOffset": 48}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}, {"bufferView": 1, "componentType": 5123, "type": "VEC2", "count": 3, "normalized": True}, {"bufferView": 2, "componentType": 5123, "type": "SCALAR", "count": 3}]}
    df = spark.createDataFrame([("a", glb(doc, blob)), ("b", b"nothing here"), ("c", None)], "path string, content binary")
    v = files.glb_vertices(df).orderBy("path", "v").collect()
    assert [(r["x"], r["y"], r["tu"], r["tv"]) for r in v if r["path"] == "a"] == [(0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)] and {r["path"] for r in v if r["reason"]} == {"b", "c"}
    assert [tuple(r) for r in files.glb_triangles(df).collect()] == [("a", 0, 0, 0, 0, 1, 2)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "ab-12.glb").write_bytes(b"x")
    (tmp_path / "a b.glb").write_bytes(b"y")
    assert [(r["token"], bytes(r["content"])) for r in files.side_files(spark, str(tmp_path), "glb").collect()] == [("ab-12", b"x")]
    assert files.allowed(str(tmp_path / "ab-12.glb"), [str(tmp_path)]).endswith("ab-12.glb")
    with pytest.raises(PermissionError):
        files.allowed(str(tmp_path / ".." / "other"), [str(tmp_path)])
    line = files.logged(lit("anna"), lit("1.2.3.4"), lit("POST"), lit("/api/check"), lit(200), lit(31.7))
    assert tuple(one(spark, files.access_log(line))) == ("anna", "1.2.3.4", "POST", "/api/check", 200, 31)
    assert one(spark, files.access_log(lit("anna 1.2.3.4 GET /static/x.js 200 3ms"))) is None and one(spark, files.access_log(lit("?"))) is None
    store = tmp_path / "shop.json"
    store.write_text('{"version": 1, "rules": {"a": "off"}}')
    files.rewritten(spark, str(store), {"rules": {"b": "red"}})
    assert json.loads(store.read_text()) == {"version": 1, "rules": {"b": "red"}} and not (tmp_path / "shop.json.tmp").exists()


def test_editor_bounds_hold_the_corners(spark):
    for turn in (0.0, 0.7, 2.0, -3.0):
        e = F.struct(*[lit(v).alias(k) for k, v in (("x", 10.0), ("y", 20.0), ("scale", 1.5), ("rotation", turn), ("width", 30.0), ("height", 8.0))])
        assert tuple(one(spark, editor.bounds(e))) == pytest.approx(tuple(one(spark, geometry.box(editor.corners(e)))))
    assert one(spark, editor.topmost(F.array(e, e), geometry.point(10, 20))) == one(spark, e) and one(spark, editor.topmost(F.array(e), geometry.point(99, 99))) is None


def test_names_of_files(spark):
    held = ["plan.pdf", "żółw.pdf", "łąka", "l", "ł.pdf", None, "e\u0301.pdf", "\u1e69", "日本", "가"]
    import unicodedata

    for n in held:
        want = any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", n or ""))
        assert one(spark, names.has_diacritics(lit(n).cast("string"))) == want, n


def many_files(spark):
    """Templates, cuts, outlines and pages of forty files of two kinds and twenty templates of two kinds on their page."""
    shelf = spark.createDataFrame([(i, f"T{i:02}", 1000.0, 500.0, i) for i in range(20)] + [(99, "other", 3000.0, 500.0, 99)], "token long, name string, page_w double, page_h double, ord long")
    cuts = spark.createDataFrame([(i, k, "cut", 100.0 + 300 * (i > 0), 50.0 + k) for i in range(20) for k in (0, 9)] + [(99, 0, "cut", 1.0, 1.0)], "token long, ord int, type string, w double, h double")
    up = spark.createDataFrame([(f, 100.5 + 300 * (f % 2), h, True) for f in range(40) for h in (50.0, 59.5)] + [(f, 700.0, 7.0, False) for f in range(40)], "file_id long, w double, h double, closed boolean")
    return shelf, cuts, up, spark.createDataFrame([(f, 1001.0, 499.0) for f in range(40)], "file_id long, page_w double, page_h double")


def test_ranks_are_found_once_for_files_that_are_alike(spark):
    tables = many_files(spark)
    files, places = outlines.ranked_kinds(*tables)
    assert files.count() == 40 and files.select("alike").distinct().count() == 2 and places.count() == 40
    got = {(r["file_id"], r["token"]): (r["matched"], r["outlines"], r["place"]) for r in outlines.ranked(*tables).collect()}
    assert len(got) == 800 and got[0, 0] == (2, 2, 1) and got[0, 5] == (0, 2, 6) and got[1, 0] == (0, 2, 20) and got[1, 19] == (2, 2, 19)


def test_decisive_by_kind(spark):
    files, places = outlines.ranked_kinds(*many_files(spark))
    got = {r["file_id"]: r["token"] for r in outlines.decisive(places, "alike").join(files, "alike").collect()}
    assert got == {f: 0 for f in range(0, 40, 2)}


def test_candidates_that_are_ranked_are_told_by_their_pages(spark):
    shelf, _, _, pages = many_files(spark)
    pairs = spark.createDataFrame([(0, 3, "T03"), (0, 99, "other"), (77, 3, "T03")], "file_id long, token long, name string")
    assert sorted((r["file_id"], r["token"]) for r in outlines.unranked(pairs, shelf, pages).collect()) == [(0, 99), (77, 3)]


def test_places_of_equal_areas_agree_in_any_order(spark):
    rows = [("f", 1, 200.0, 600.0), ("f", 1, 300.0, 400.0), ("f", 1, 600.0, 200.0), ("f", 1, 400.0, 300.0)]
    for own in (rows, rows[::-1]):
        got = outlines.candidates(spark.createDataFrame(own, "file_id string, ord int, w double, h double").coalesce(1)).orderBy("place").collect()
        assert [r["w"] for r in got] == [200.0, 300.0, 400.0, 600.0]


def test_candidates_by_name(spark):
    ranked = spark.createDataFrame([("f", "a", "A", 2, 3)], "file_id string, token string, name string, matched long, outlines long")
    shelf = spark.createDataFrame([("a", "A", 100.0, 200.0), ("b", "B", 201.0, 99.5), ("c", "C", 100.0, 230.0), ("d", "D", None, 200.0)], "token string, name string, trim_w double, trim_h double")
    named = spark.createDataFrame([("f", 100.0, 200.0), ("g", 98.5, 203.0), ("h", 0.0, 1.0)], "file_id string, w double, h double")
    got = sorted((r["file_id"], r["token"], r["matched"]) for r in templates.named_candidates(ranked, shelf, named).collect())
    assert got == [("f", "a", 2), ("f", "b", 0), ("g", "a", 0), ("g", "b", 0)]


def test_scenes(spark):
    assert [one(spark, scenes.carrier(lit(w), lit(h))) for w, h in ((9e9, 1000.0), (1.0, 2000.0), (12000.0, 4000.0), (12001.0, 4000.0))] == ["barrier", "fence", "billboard", "frame"]
    size = lambda name, kind: one(spark, scenes.finished_size(lit(name), lit(kind), lit(40.0), lit(50.0), lit(1000.0), lit(2000.0), lit(10)))
    assert size("Vento S", "sheet") == (800, 1800) and size("other", "flat") == (400, 500) and size("ventos", "sheet") is None
    assert one(spark, scenes.first_hop(lit("1.1.1.1, 2.2.2.2"), lit("x"))) == "1.1.1.1" and one(spark, scenes.first_hop(lit(None).cast("string"), lit("x"))) == "x"
    assert one(spark, scenes.trace(F.array(lit(" a \n b "), lit("c" * 300))))[0] == "a b" and one(spark, scenes.painted(lit("b*"))) == "both"


def test_folded_names(spark):
    import unicodedata

    texts = ["\u0142\u00f3d\u017a", "\u0141\u00c9", "stra\u00dfe \ufb01 \u00bd \u2122", "\u65e5\u672c", "plain.pdf", "", None, "e\u0301"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(names.folded(F.col("t"))).collect()]
    want = ["".join(c for c in unicodedata.normalize("NFKD", (t or "").replace("\u0142", "l").replace("\u0141", "L")) if ord(c) < 128) for t in texts]
    assert got == want and got[0] == "lodz"


def test_stored_outlines(spark):
    point = "struct<x double, y double>"
    shape = f"i int, start {point}, segments array<struct<a {point}, b {point}, to {point}>>, closed boolean, w double, h double, o {point}"
    line = lambda x, y: (None, None, (x, y))
    rows = [
        (0, (0.12345, 1.0), [line(10.0004, 1.0), ((12.0, 1.0), (12.0, 5.0), (10.0, 5.0)), line(-2.0, 5.0)], True, None, None, None),
        (1, (0.0, 0.0), [line(3.0, 4.0)], None, 7.0, 8.0, (1.0, 2.0)),
        (2, (1.0, 1.0), [], False, None, None, None),
        (3, None, [line(1.0, 1.0)], True, None, None, None),
        (4, (0.0, 0.0), None, True, None, None, None),
    ]
    df = spark.createDataFrame(rows, shape).select("i", outlines.stored(*[F.col(c) for c in ("start", "segments", "closed", "w", "h", "o")]).alias("s"))
    got = {r["i"]: r for r in df.select("i", "s", outlines.restored(F.col("s")).alias("r")).collect()}
    assert got[3]["s"] is None and got[4]["s"] is None and got[3]["r"] is None
    first = got[0]["s"]
    assert first["start"] == [0.123, 1.0] and [(s["kind"], s["numbers"]) for s in first["segments"]] == [("l", [10.0, 1.0]), ("c", [12.0, 1.0, 12.0, 5.0, 10.0, 5.0]), ("l", [-2.0, 5.0])]
    t = np.linspace(0, 1, 2001)
    widest = (10.0004 * (1 - t) ** 3 + 36 * t * (1 - t) ** 2 + 36 * t**2 * (1 - t) + 10 * t**3).max()
    assert first["width_mm"] == pytest.approx(widest + 2, abs=0.06) and first["height_mm"] == 4.0 and first["origin_mm"] == [-2.0, 1.0] and first["closed"]
    one = got[1]["s"]
    assert (one["width_mm"], one["height_mm"], one["origin_mm"], one["closed"]) == (7.0, 8.0, [1.0, 2.0], False)
    assert (got[2]["s"]["width_mm"], got[2]["s"]["origin_mm"], got[2]["s"]["segments"]) == (0.0, [1.0, 1.0], [])
    back = got[0]["r"]
    assert back["segments"][0]["a"] is None and tuple(back["segments"][1]["b"]) == (12.0, 5.0) and tuple(back["segments"][2]["to"]) == (-2.0, 5.0) and tuple(back["origin_mm"]) == (-2.0, 1.0)


def test_faces_sizes_ticks_and_stamps(spark):
    from platen.operators import stamps

    faces = [("  A ", [0.0, 0.0, 1.0, 1.0]), ("", [0.0, 0.0, 1.0, 1.0]), ("B", [0.0, 1.0]), ("C", [0.0, None, 1.0, 1.0]), (None, None)]
    df = spark.createDataFrame([(faces,)], "f array<struct<label string, box array<double>>>")
    assert [(x["label"], x["box"]) for x in df.select(templates.valid_faces(F.col("f")).alias("f")).first()["f"]] == [("A", [0.0, 0.0, 1.0, 1.0])]
    sizes = spark.createDataFrame([(0, 1999.96), (1, 12.34), (2, 7.0)], "i int, x double").orderBy("i").select(numbers.size_text(F.col("x")).alias("t"))
    assert [r["t"] for r in sizes.collect()] == ["2000", "12.3", "7"]
    ticks_ = spark.createDataFrame([(0, " true"), (1, "TRUE"), (2, "yes"), (3, None)], "i int, x string").orderBy("i").select(F.coalesce(orders.ticked(F.col("x")), F.lit(False)).alias("t"))
    assert [r["t"] for r in ticks_.collect()] == [True, True, False, False]
    item = "i struct<netto_mm array<double>, bleed_mm double, safe_mm double, scale double, strip_mm double>"
    text = spark.createDataFrame([((([100.126, 50.0], 3.0, 5.0, 1.0, None)),)], item).select(stamps.item_payload(F.col("i"), F.lit("mesh"), F.lit("L"))).first()[0]
    assert json.loads(text)["netto_mm"] == [100.13, 50.0] and json.loads(text)["material"] == "mesh"


def test_boxes_are_assigned_without_a_call_for_each_mesh(spark):
    """The greedy choice is a fold within rows, so many small meshes don't cost a Python call each."""
    rows = spark.createDataFrame([(m, k, 0.0, 0.0, 1.0 + k, 2.0) for m in range(3) for k in range(2)], "mesh long, island int, x0 double, y0 double, x1 double, y1 double")
    found = mesh.assigned(rows, rows.withColumnRenamed("island", "box"))
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
    # the larger chooses first: 2 by 2 fits its own kind, 1 by 2 takes what is left
    assert sorted((r["mesh"], r["island"], r["box"]) for r in found.collect()) == [(m, k, k) for m in range(3) for k in range(2)]


def test_rings_are_cut_once(spark):
    """However often a cut ring is named, its four cuts are planned once; rings of few files are dealt out."""
    from platen.plans import drawing

    plan = lambda q: q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan(drawing.clipped_rings).count("flatten(") == 4
    assert "RepartitionByExpression" in plan(drawing.ring_shapes)


def test_island_boxes_in_parts(spark, monkeypatch):
    """The more triangles, the more parts: what one task sorts stays as it is."""
    triangles = spark.createDataFrame([(m, t, t, t + 1, t + 2) for m in range(3) for t in range(20)], "mesh long, t long, v0 long, v1 long, v2 long")
    numbered = triangles.select("mesh", "t", (F.col("t") % 2).cast("int").alias("island"))
    vertices = spark.createDataFrame([(m, v, float(v * 7 % 10 + m), float(v)) for m in range(3) for v in range(22)], "mesh long, v long, u_mm double, v_mm double")
    monkeypatch.setattr(mesh, "TASK_ROWS", 10)
    found = mesh.island_boxes(numbered, triangles, vertices)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(", 18\n") == 4  # 180 corners
    want = {}
    for m in range(3):
        for i in range(2):
            own = [v for t in range(i, 20, 2) for v in (t, t + 1, t + 2)]
            want[m, i] = (min(v * 7 % 10 + m for v in own), min(own), max(v * 7 % 10 + m for v in own), max(own))
    assert {(r["mesh"], r["island"]): (r["u0"], r["v0"], r["u1"], r["v1"]) for r in found.collect()} == want
