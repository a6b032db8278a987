"""Queries of order tracking, names, dates and state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import orders, state
from . import derived


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of order rows: how many, and of each detail the first that is filled."""
    rows = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    keyed = rows.withColumn("group_key", orders.group_key(*[F.col(c) for c in ("order_code", "client", "project", "pm", "pm_email", "delivery")]))
    return orders.first_filled(keyed, ["group_key"], "ord", ["product", "tracking"], F.count(F.lit(1)).alias("rows"))


ORDER_GROUPS = f"""
WITH s AS ({derived.SHEET_SQL}),
k AS (SELECT *, CASE WHEN order_code <> '' THEN concat(upper(order_code), '|', lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END))
    ELSE concat_ws('|', client, project, lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END), strftime(delivery, '%Y%m%d')) END AS group_key FROM s)
SELECT group_key, count(*) AS rows, arg_min(product, ord) FILTER (WHERE product <> '') AS product, arg_min(tracking, ord) FILTER (WHERE tracking <> '') AS tracking FROM k GROUP BY group_key"""


def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows not yet sent under their group and status, after the log's last invalidations."""
    rows = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    keyed = rows.withColumn("group", orders.group_key(*[F.col(c) for c in ("order_code", "client", "project", "pm", "pm_email", "delivery")])).withColumn("status", orders.status(F.col("status")))
    return orders.pending(keyed, derived.from_sql(spark, sf_dir, derived.LOG_SQL)).select("ord", "group", "status", "product")


PENDING = f"""
WITH s AS ({derived.SHEET_SQL}), log AS ({derived.LOG_SQL}),
k AS (SELECT *, CASE WHEN order_code <> '' THEN concat(upper(order_code), '|', lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END))
    ELSE concat_ws('|', client, project, lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END), strftime(delivery, '%Y%m%d')) END AS "group" FROM s),
live AS (SELECT * FROM log l WHERE NOT EXISTS (SELECT 1 FROM log v WHERE v."group" = l."group" AND v.status = l.status AND v.recipients LIKE '(invalidated%' AND v.sent_at >= l.sent_at) AND recipients LIKE '%@%'),
sent AS (SELECT DISTINCT "group", status, lower(trim(unnest(string_split(items, ' | ')))) AS item FROM live)
SELECT ord, k."group", k.status, product FROM k WHERE product <> '' AND NOT EXISTS (SELECT 1 FROM sent WHERE sent."group" = k."group" AND sent.status = k.status AND sent.item = lower(product))"""


def warehouse_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each warehouse address is told on each day: two working days before delivery."""
    rows = dates.with_working_days_before(derived.from_sql(spark, sf_dir, derived.SHEET_SQL), "delivery", dates.NOTICE_DAYS, "told")
    out = orders.digest(rows, F.col("told").isNotNull(), F.col("told"))
    return out.select("address", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", F.array_join("products", "; ").alias("products"))


#: Easter in SQL by the classic steps of the calendar's golden numbers, for the years of the data; weekends and holidays skipped by counting back.
_HOLIDAYS = """
years AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1980, 2040) t(y)),
moons AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM years),
weeks AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM moons),
easters AS (SELECT y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) AS e FROM weeks),
free AS (SELECT make_date(y, m, d) AS day FROM easters, (VALUES (1, 1), (1, 6), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)) f(m, d) UNION SELECT (e + n)::DATE FROM easters, (VALUES (0), (1), (49), (60)) g(n)),
days AS (SELECT day::DATE AS day FROM range(DATE '1980-01-01', DATE '2039-12-31', INTERVAL 1 DAY) t(day)),
working AS (SELECT day, row_number() OVER (ORDER BY day) AS nr FROM days WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM free)),
ranked AS (SELECT day, (SELECT max(nr) FROM working w WHERE w.day < d.day) AS nr FROM days d),
back AS (SELECT r.day, a.day AS one, b.day AS two FROM ranked r LEFT JOIN working a ON a.nr = r.nr LEFT JOIN working b ON b.nr = r.nr - 1)"""

DIGEST = f"""
WITH {_HOLIDAYS.strip()}, s AS ({derived.SHEET_SQL}),
t AS (SELECT s.*, back.two AS told FROM s JOIN back ON back.day = s.delivery WHERE product <> ''),
each AS (SELECT DISTINCT ord, product, told, lower(unnest(list_filter(regexp_split_to_array(warehouse_email, '[\\s,;/]+'), lambda x: regexp_full_match(x, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')))) AS address FROM t)
SELECT address, strftime(told, '%Y-%m-%d') AS day, count(*) AS rows, string_agg(product, '; ' ORDER BY ord) AS products FROM each GROUP BY address, told"""


def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order: whether its day is worked, and the working days one and two before it."""
    day = F.col("o_orderdate").cast("date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return rows.select("o_orderkey", F.lit(None).cast("boolean").alias("worked"), *[F.lit(None).cast("string").alias(c) for c in ("one_before", "two_before")])
    steps = dates.working_day_steps(spark, first, last, (1, 2)).select("day", "worked", text("back_1").alias("one_before"), text("back_2").alias("two_before"))
    return rows.join(F.broadcast(steps) if (last - first).days <= dates.BROADCAST_DAYS else steps, "day").select("o_orderkey", "worked", "one_before", "two_before")


WORKING = f"""
WITH {_HOLIDAYS.strip()}
SELECT o_orderkey, o_orderdate::DATE IN (SELECT day FROM working) AS worked, strftime(one, '%Y-%m-%d') AS one_before, strftime(two, '%Y-%m-%d') AS two_before FROM orders JOIN back ON back.day = o_orderdate::DATE"""


def lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order: its window around the day, and how many months a calendar of it shows."""
    day = F.col("o_orderdate").cast("date")
    window = dates.lead_time(day, F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise((F.col("o_custkey") % 50).cast("string")), F.when(F.col("o_custkey") % 4 == 0, F.lit(None)).otherwise((F.col("o_custkey") % 90).cast("string")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), window.alias("w"), F.date_sub(day, 20).alias("today"))
    return rows.select("o_orderkey", F.date_format("w.start", "yyyy-MM-dd").alias("start_day"), F.date_format("w.end", "yyyy-MM-dd").alias("end_day"), F.size(dates.shown_months(F.col("today"), F.col("w.start"), F.col("w.end"))).cast("long").alias("months"))


LEAD = """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 END AS b, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE o_custkey % 90 END AS a FROM orders),
w AS (SELECT *, (day - b::INTEGER)::DATE AS s, (day + a::INTEGER)::DATE AS e, (day - 20)::DATE AS today FROM d),
m AS (SELECT *, least(today, s) AS f, greatest(today, e) AS l FROM w),
n AS (SELECT *, datediff('month', date_trunc('month', f), date_trunc('month', l)) + 1 AS n FROM m)
SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day,
    CASE WHEN n > 3 THEN 1 + (CASE WHEN date_trunc('month', s) <> date_trunc('month', f) THEN 1 ELSE 0 END) + (CASE WHEN date_trunc('month', e) <> date_trunc('month', f) AND date_trunc('month', e) <> date_trunc('month', s) THEN 1 ELSE 0 END) ELSE n END::BIGINT AS months FROM n"""


def throttled_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that are told: a user's first, then the first at least six hours after the last told one."""
    out = state.throttled(read(spark, sf_dir, "events"), "user_id", "ts", 360)
    return out.select("user_id", F.unix_micros("told_at").alias("told_us"))


THROTTLED = """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events),
told AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL
    SELECT told.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = told.user_id AND e.t - told.t >= 21600000000) FROM told WHERE (SELECT min(e.t) FROM e WHERE e.user_id = told.user_id AND e.t - told.t >= 21600000000) IS NOT NULL)
SELECT user_id, t AS told_us FROM told"""


def visit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: each event holds its session open for thirty minutes."""
    out = state.sessions(read(spark, sf_dir, "events"), "user_id", "ts")
    return out.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "events")


SESSIONS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT user_id, min(t) AS started_us, max(t) AS ended_us, count(*) AS events FROM s GROUP BY user_id, nr"""


def since_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events after their last error."""
    out = orders.since_marker(read(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "error")
    return out.select("user_id", "event_id", "event_type")


SINCE = "SELECT user_id, event_id, event_type FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS m FROM events) WHERE m IS NULL OR ts > m"


def kept_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as designs by day and price: those of the last year that a cap on the running total keeps."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").cast("long").alias("bytes"))
    cap = rows.agg((F.sum("bytes") / 20).cast("long")).first()[0]
    newest = rows.agg(F.max("at")).first()[0]
    return state.kept(rows, "at", "bytes", F.lit(newest), 365, cap or 0, "o_orderkey").select("o_orderkey", "total")


KEPT = """
WITH r AS (SELECT o_orderkey, o_orderdate AS at_, trunc(o_totalprice)::BIGINT AS bytes FROM orders),
t AS (SELECT *, sum(bytes) OVER (ORDER BY at_ DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM r)
SELECT o_orderkey, total::BIGINT AS total FROM t WHERE at_ >= (SELECT max(at_) FROM r) - INTERVAL 365 DAY AND total <= (SELECT trunc(sum(bytes) / 20)::BIGINT FROM r)"""


def busy_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring hours in which an event type occurs."""
    hours = read(spark, sf_dir, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"))
    return state.islands(hours, ["event_type"], "hour").select("event_type", F.col("first").alias("first_hour"), F.col("last").alias("last_hour"), F.col("n").alias("hours"))


BUSY = """
WITH h AS (SELECT DISTINCT event_type, epoch_us(ts) // 3600000000 AS hour FROM events),
r AS (SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM h)
SELECT event_type, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM r GROUP BY event_type, run"""


def detail_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of pages, from lines with a discount, merged into boxes."""
    tiles = read(spark, sf_dir, "lineitem").filter("l_discount > 0.02").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_suppkey") % 9).alias("y"))
    return state.merged_tiles(tiles)


BOXES = """
WITH t AS (SELECT DISTINCT l_orderkey % 50 AS page, l_partkey % 12 AS x, l_suppkey % 9 AS y FROM lineitem WHERE l_discount > 0.02),
a AS (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS run FROM t),
b AS (SELECT page, y, min(x) AS x0, max(x) AS x1 FROM a GROUP BY page, y, run),
c AS (SELECT *, y - row_number() OVER (PARTITION BY page, x0, x1 ORDER BY y) AS run FROM b)
SELECT page, x0, min(y) AS y0, x1, max(y) AS y1 FROM c GROUP BY page, x0, x1, run"""


def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names of files say, derived from parts: extension, dots, diacritics, size."""
    p = read(spark, sf_dir, "part")
    unit = F.element_at(F.array(*map(F.lit, ("mm", "cm", "", "m", " CM "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "żółw").otherwise("plan"), F.when(F.col("p_partkey") % 3 == 0, ".v1_").otherwise("_"), F.col("p_size"), F.lit(",5"), unit, F.when(F.col("p_partkey") % 2 == 0, " x ").otherwise("X"), (F.col("p_partkey") % 900).cast("string"), F.when(F.col("p_partkey") % 7 == 0, "makieta").otherwise(""), F.when(F.col("p_partkey") % 11 == 0, ".TIFF").otherwise(".pdf"))
    t = p.select("p_partkey", name.alias("name")).withColumn("size", names.named_size(F.col("name")))
    return t.select("p_partkey", names.extension(F.col("name")).alias("extension"), names.extra_dots(F.col("name")).alias("extra_dots"), names.has_diacritics(F.col("name")).alias("diacritics"), F.col("size.w").alias("w"), F.col("size.h").alias("h"), F.coalesce("size.stated", F.lit(False)).alias("stated"))


NAMES = """
WITH u AS (SELECT p_partkey, p_size, (['mm', 'cm', '', 'm', ' CM '])[p_partkey % 5 + 1] AS unit, p_partkey % 900 AS second FROM part),
f AS (SELECT *, CASE lower(trim(unit)) WHEN 'cm' THEN 10.0 WHEN 'm' THEN 1000.0 ELSE 1.0 END AS factor FROM u)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'tiff' ELSE 'pdf' END AS extension, p_partkey % 3 = 0 AS extra_dots, p_partkey % 4 = 0 AS diacritics,
    CASE WHEN ok THEN round((p_size + 0.5) * factor, 2) END AS w, CASE WHEN ok THEN round(second * factor, 2)::DOUBLE END AS h, ok AND trim(unit) <> '' AS stated
FROM (SELECT *, second > 0 AND (p_partkey % 2 = 0 OR unit IN ('', ' CM ')) AS ok FROM f)"""  # a unit with a letter right behind it is none


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in each order's free text, the first spelling of each."""
    rows = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    return rows.select("ord", F.array_join(orders.addresses(F.col("warehouse_email")), ",").alias("addresses"), orders.plural(F.col("ord") % 130, "adres", "adresy", "adresów").alias("counted"))


ADDRESSES = f"""
WITH s AS ({derived.SHEET_SQL}),
a AS (SELECT ord, unnest(regexp_split_to_array(warehouse_email, '[\\s,;/]+')) AS a, unnest(range(len(regexp_split_to_array(warehouse_email, '[\\s,;/]+')))) AS i FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY ord, lower(a) ORDER BY i) AS nth FROM a WHERE regexp_full_match(a, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'))
SELECT ord, string_agg(a, ',' ORDER BY i) AS addresses, concat(ord % 130, ' ', CASE WHEN ord % 130 = 1 THEN 'adres' WHEN ord % 10 BETWEEN 2 AND 4 AND NOT ord % 130 % 100 BETWEEN 12 AND 14 THEN 'adresy' ELSE 'adresów' END) AS counted FROM f WHERE nth = 1 GROUP BY ord"""

#: Letters of the parts' names, and what stands for them so that there is something to fold.
_PLAIN, _MARKED = "aceilnosuz", "\u00e4\u00e7\u0119\u00ef\u0142\u0144\u00f3\u00df\u016f\u017c"


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names, written with marks, in ASCII."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", names.folded(F.translate("p_name", _PLAIN, _MARKED)).alias("folded"))


FOLDED = f"SELECT p_partkey, regexp_replace(strip_accents(translate(translate(coalesce(p_name, ''), '{_PLAIN}', '{_MARKED}'), '\u0142\u0141', 'lL')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM part"


QUERIES = {
    "order_groups": (order_groups, ORDER_GROUPS), "pending_items": (pending_items, PENDING), "warehouse_digest": (warehouse_digest, DIGEST), "working_days": (working_days, WORKING), "lead_times": (lead_times, LEAD),
    "throttled_visits": (throttled_visits, THROTTLED), "visit_sessions": (visit_sessions, SESSIONS), "since_last_error": (since_last_error, SINCE), "kept_designs": (kept_designs, KEPT), "busy_hours": (busy_hours, BUSY),
    "detail_boxes": (detail_boxes, BOXES), "name_facts": (name_facts, NAMES), "folded_names": (folded_names, FOLDED), "addresses": (addresses, ADDRESSES),
}
