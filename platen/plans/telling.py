"""Queries of what is told to whom, of lists, traces and held files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import holding, orders, scenes, state
from ..sources import files
from . import derived
from .tracking import _HOLIDAYS, read

_KEY = "CASE WHEN order_code <> '' THEN concat(upper(order_code), '|', lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END)) ELSE concat_ws('|', client, project, lower(CASE WHEN pm_email <> '' THEN pm_email ELSE pm END), strftime(delivery, '%Y%m%d')) END"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    return rows.withColumn("group", orders.group_key(*[F.col(c) for c in ("order_code", "client", "project", "pm", "pm_email", "delivery")]))


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that go with each row of the sheet: shipping line, calendar, escaped product, redirected mail."""
    t = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    carrier = F.element_at(F.array(*map(F.lit, ("DHL", "excel", "Own transport", "Spedycja", "Foo", ""))), (F.col("ord") % 6 + 1).cast("int"))
    ics = orders.calendar(F.concat(F.lit("Item, "), F.col("product")), F.col("delivery"), F.date_add("delivery", 2), F.lit("a\nb;c"), F.concat(F.lit("k|"), F.col("ord").cast("string")), F.col("delivery").cast("timestamp"))
    mail = orders.redirected(orders.addresses(F.col("warehouse_email")), F.col("product"), F.when(F.col("ord") % 2 == 0, "test@x.pl").otherwise(""))
    ymd = F.date_format("delivery", "yyyyMMdd")
    return t.select("ord", orders.shipping_line(carrier, F.col("tracking")).alias("shipping"), ics.alias("ics"), orders.escaped(F.concat(F.lit("<"), F.col("product"), F.lit('&"'))).alias("escaped"), mail["to"].alias("mail_to"), mail["subject"].alias("subject"), orders.item_id(F.concat(F.lit(" "), F.col("product"))).alias("item"), orders.reply_to(F.concat(F.lit("Jan "), F.col("pm_email"))).alias("reply_to"), orders.number(F.when(F.col("ord") % 3 == 0, "x").otherwise(F.col("ord").cast("string"))).alias("number"), dates.dotted(dates.shifted(ymd, 30)).alias("later"))


ORDER_TEXTS = f"""
WITH s AS ({derived.SHEET_SQL}), a AS (SELECT ord, 'b' || (ord % 9) || '@w.example' AS b, 'a' || (c_nationkey % 4) || '@w.example' AS a FROM s JOIN orders ON o_orderkey = ord JOIN customer ON c_custkey = o_custkey)
SELECT s.ord, CASE ord % 6 WHEN 0 THEN CASE WHEN tracking = '' THEN 'DHL' ELSE concat('DHL, tracking ', tracking, ': https://www.dhl.com/pl-en/home/tracking.html?tracking-id=', tracking) END WHEN 1 THEN CASE WHEN tracking <> '' THEN concat('Parcel list: ', tracking) END
    WHEN 2 THEN CASE WHEN tracking = '' THEN 'Own transport' ELSE concat('Own transport, driver:', chr(10), tracking) END WHEN 3 THEN 'SUPPLY CHAIN' WHEN 4 THEN CASE WHEN tracking = '' THEN 'Foo' ELSE concat('Foo, tracking ', tracking) END ELSE CASE WHEN tracking <> '' THEN concat('tracking ', tracking) END END AS shipping,
    array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//platen//EN', 'METHOD:PUBLISH', 'BEGIN:VEVENT', concat('UID:k', ord, '@platen'), concat('DTSTAMP:', strftime(delivery, '%Y%m%dT000000Z')), concat('DTSTART;VALUE=DATE:', strftime(delivery, '%Y%m%d')), concat('DTEND;VALUE=DATE:', strftime(delivery + 3, '%Y%m%d')), concat('SUMMARY:Item\\, ', product), 'DESCRIPTION:a\\nb\\;c', 'END:VEVENT', 'END:VCALENDAR'], chr(13) || chr(10)) AS ics,
    concat('&lt;', product, '&amp;&quot;') AS escaped, CASE WHEN ord % 2 = 0 THEN 'test@x.pl' ELSE concat(a, ',', b) END AS mail_to, CASE WHEN ord % 2 = 0 THEN concat('[TEST → ', a, ', ', b, '] ', product) ELSE product END AS subject, lower(product) AS item, pm_email AS reply_to, CASE WHEN ord % 3 = 0 THEN 0 ELSE ord END::DOUBLE AS number, strftime(delivery + 30, '%d.%m.%Y') AS later
FROM s JOIN a USING (ord)"""


def digest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What warehouse addresses are still to be told on each day of a delivery: those told already are left out."""
    t = derived.from_sql(spark, sf_dir, derived.SHEET_SQL)
    told = t.filter(F.col("ord") % 4 == 0).select(F.concat(F.lit("A"), F.col("ord") % 4, F.lit("@W.example")).alias("address"), F.col("delivery").alias("day")).distinct()
    out = orders.digest(t, F.col("delivery").isNotNull(), F.col("delivery"), told)
    forced = orders.digest(t, F.col("delivery").isNotNull(), F.col("delivery"), told, force=True).groupBy("address", "day").agg(F.sum("rows").alias("forced"))
    return forced.join(out.select("address", "day", "rows"), ["address", "day"], "left").select("address", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "forced")


DIGEST_LEFT = f"""
WITH s AS ({derived.SHEET_SQL}), e AS (SELECT DISTINCT ord, delivery, lower(unnest(list_filter(regexp_split_to_array(warehouse_email, '[\\s,;/]+'), lambda x: regexp_full_match(x, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')))) AS address FROM s WHERE product <> ''),
t AS (SELECT DISTINCT concat('a', ord % 4, '@w.example') AS address, delivery FROM s WHERE ord % 4 = 0),
f AS (SELECT address, delivery, count(*) AS forced FROM e GROUP BY address, delivery)
SELECT address, strftime(delivery, '%Y-%m-%d') AS day, CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.address = f.address AND t.delivery = f.delivery) THEN forced END AS rows, forced::BIGINT AS forced FROM f"""


def warehouse_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day each row's warehouse is told: its own, else two working days before the delivery."""
    t = derived.from_sql(spark, sf_dir, derived.SHEET_SQL).select("ord", F.when(F.col("ord") % 9 != 0, F.col("delivery")).alias("delivery"), F.when(F.col("ord") % 5 == 0, F.date_sub("delivery", 40)).alias("own"))
    counted = dates.with_working_days_before(t, "delivery", dates.NOTICE_DAYS, "noticed")
    return counted.select("ord", F.date_format(F.coalesce("own", "noticed"), "yyyy-MM-dd").alias("day"))


WAREHOUSE_DAYS = f"WITH {_HOLIDAYS.strip()}, s AS ({derived.SHEET_SQL}) SELECT ord, strftime(CASE WHEN ord % 5 = 0 THEN delivery - 40 WHEN ord % 9 <> 0 THEN two END, '%Y-%m-%d') AS day FROM s LEFT JOIN back ON back.day = s.delivery"


def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row with a product: how many rows its group and status has, and which."""
    t = _keyed(spark, sf_dir).withColumn("status", orders.status(F.col("status")))
    return orders.rows_in_group(t, "group", "ord", "status").select("ord", "rows", "label")


GROUP_LABELS = f"""
WITH s AS (SELECT *, {_KEY} AS g FROM ({derived.SHEET_SQL}) s WHERE product <> '')
SELECT ord, count(*) OVER w AS rows, CASE WHEN min(ord) OVER w = max(ord) OVER w THEN concat('row ', ord) ELSE concat('rows ', min(ord) OVER w, '–', max(ord) OVER w) END AS label FROM s WINDOW w AS (PARTITION BY g, status)"""


def voided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each group's log no longer count."""
    return orders.voided(derived.from_sql(spark, sf_dir, derived.LOG_SQL)).groupBy("group", "status").agg(F.count_if("voided").alias("voided"), F.count(F.lit(1)).alias("lines"))


VOIDED = f"""
WITH l AS (SELECT *, max(CASE WHEN recipients LIKE '(invalidated%' THEN sent_at END) OVER (PARTITION BY "group", status) AS m FROM ({derived.LOG_SQL}) l)
SELECT "group", status, count(*) FILTER (WHERE sent_at <= m AND recipients NOT LIKE '(invalidated%') AS voided, count(*) AS lines FROM l GROUP BY "group", status"""


def listed_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price list put in another order, some of its rows replaced and some added."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    wanted = s.filter("id % 10 = 3").select("id", (-F.col("id")).alias("pos")).unionByName(spark.createDataFrame([(-5, 0)], "id long, pos long"))
    changes = s.filter("id % 7 = 0").select("id", "ord", F.lit("changed").alias("name")).unionByName(spark.createDataFrame([(-1, 10**9, "new")], "id long, ord long, name string"))
    return orders.reordered(orders.upserted(s, changes), wanted).select("id", F.col("ord").cast("long").alias("ord"), "name")


LISTED = """
WITH s AS (SELECT s_suppkey AS id, s_suppkey AS ord, CASE WHEN s_suppkey % 7 = 0 THEN 'changed' ELSE s_name END AS name FROM supplier UNION ALL SELECT -1, 1000000000, 'new')
SELECT id, row_number() OVER (ORDER BY id % 10 <> 3, CASE WHEN id % 10 = 3 THEN -id ELSE ord END) AS ord, name FROM s"""


def client_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of each user's events, and where they came from."""
    e = read(spark, sf_dir, "events").withColumn("said", F.concat(F.lit("  "), F.col("event_type"), F.lit(" \n\t "), F.col("event_id").cast("string"), F.lit(" ")))
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "said"))), lambda x: x["said"]).alias("said"))
    hop = scenes.first_hop(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id") % 9, F.lit(", 1.1.1.1"))), F.lit("remote"))
    line = files.logged(F.lit("u"), hop, F.lit("GET"), F.when(F.col("user_id") % 5 == 0, "/static/x.js").otherwise("/api/check"), F.lit(200), F.col("user_id"))
    return per.select("user_id", F.array_join(scenes.trace(F.col("said"), 3, 12), "|").alias("trace"), files.access_log(line).alias("l")).select("user_id", "trace", F.col("l.address").alias("address"), F.col("l.ms").alias("ms"))


TRACES = """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, left(concat(event_type, ' ', event_id), 12) AS said FROM events)
SELECT user_id, string_agg(said, '|' ORDER BY event_id) AS trace, CASE WHEN user_id % 5 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN concat('10.0.0.', user_id % 9) ELSE 'remote' END END AS address, CASE WHEN user_id % 5 <> 0 THEN user_id END AS ms FROM n WHERE i <= 3 GROUP BY user_id"""


def first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's first three neighbouring events of a kind begin."""
    e = read(spark, sf_dir, "events").withColumn("flag", F.col("event_id") % 3 != 0)
    return state.first_run(e, ["user_id"], "event_id", "flag", 3)


FIRST_RUNS = """
WITH e AS (SELECT user_id, event_id, event_id % 3 <> 0 AS f FROM events), w AS (SELECT *, f AND lead(f, 1, false) OVER w AND lead(f, 2, false) OVER w AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(event_id) FILTER (WHERE run) AS begin FROM w GROUP BY user_id"""


def held_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held of each user's uploads after their last one. A fold that SQL can't follow."""
    e = read(spark, sf_dir, "events").withColumn("bytes", F.col("event_id") % 97 * 1000)
    return state.evicted(e, "user_id", "ts", "bytes", "event_id", 60 * 24 * 20, 100_000)


def upload_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads that users put and ask for again: what each is given, by its owner and the restarted clock."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    put = i % 3 == 0
    asked = e.select("user_id", F.col("ts").alias("at"), F.when(put, "put").otherwise("get").alias("kind"), F.concat(F.lit("u"), i % 4).alias("token"), F.when(put, i % 1000).alias("size"), F.when(put & (i % 2 == 0), "ann").alias("owner"), F.when(i % 5 > 1, "ann").otherwise("bob").alias("caller"))
    return holding.answers(asked, "user_id", HELD_DAYS * 24 * 60)


#: Users' events lie days apart, so uploads are held for days here.
HELD_DAYS = 4

#: All that a user puts fits under the cap, so only time ends an upload: it is there if no gap since it was put was too long.
UPLOADS = f"""
WITH e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS micros, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS kind, concat('u', event_id % 4) AS token, CASE WHEN event_id % 6 = 0 THEN 'ann' END AS owner, CASE WHEN event_id % 5 > 1 THEN 'ann' ELSE 'bob' END AS caller, event_id FROM events),
g AS (SELECT *, row_number() OVER w AS n, micros - lag(micros) OVER w > {HELD_DAYS} * 86400000000 AS broken FROM e WINDOW w AS (PARTITION BY user_id, token ORDER BY micros, kind DESC, event_id % 1000, owner NULLS FIRST, caller)),
p AS (SELECT *, max(CASE WHEN kind = 'put' THEN n END) OVER (PARTITION BY user_id, token ORDER BY n) AS since FROM g),
q AS (SELECT *, count(*) FILTER (WHERE broken AND kind = 'get') OVER (PARTITION BY user_id, token, since ORDER BY n) AS gaps, first_value(owner) OVER (PARTITION BY user_id, token, since ORDER BY n) AS whose FROM p)
SELECT user_id, micros, kind, token, kind = 'put' OR (since IS NOT NULL AND gaps = 0 AND coalesce(whose = caller, TRUE)) AS given FROM q"""


def recalled_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which saved designs a link still opens."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 6 == 0, "t").otherwise("token-0123456789-"), F.col("o_orderkey")).alias("token"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").cast("string").alias("filename"))
    newest = o.agg(F.max("at")).first()[0]
    return state.recalled(o, o.select("token"), F.lit(newest))


RECALLED = """
SELECT concat(CASE WHEN o_orderkey % 6 = 0 THEN 't' ELSE 'token-0123456789-' END, o_orderkey) AS token, CASE WHEN o_orderkey % 6 <> 0 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY THEN o_orderkey::VARCHAR END AS filename FROM orders"""

QUERIES = {
    "order_texts": (order_texts, ORDER_TEXTS), "digest_left": (digest_left, DIGEST_LEFT), "warehouse_days": (warehouse_days, WAREHOUSE_DAYS), "group_labels": (group_labels, GROUP_LABELS), "voided_lines": (voided_lines, VOIDED), "listed_suppliers": (listed_suppliers, LISTED),
    "client_traces": (client_traces, TRACES), "first_runs": (first_runs, FIRST_RUNS), "held_uploads": (held_uploads, None), "upload_answers": (upload_answers, UPLOADS), "recalled_designs": (recalled_designs, RECALLED),
}
