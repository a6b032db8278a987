"""Order tracking: groups, what is still to be sent, digests, and the texts that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The log's marker of a resend request, and what separates its items.
INVALIDATED, ITEMS = "(invalidated — resend requested)", " | "
#: Fixed value: the statuses that are told to a project manager.
NOTIFY = ["Produkcja", "transport", "Delivered"]
#: How the shipping line of a carrier is written, and where its parcels are tracked.
CARRIERS = {
    "DHL": ("track", "https://www.dhl.com/pl-en/home/tracking.html?tracking-id="),
    "DPD": ("track", "https://tracktrace.dpd.com.pl/parcelDetails?typ=1&p1="),
    "InPost": ("track", "https://inpost.pl/sledzenie-przesylek?number="),
    "FedEx": ("track", "https://www.fedex.com/fedextrack/?trknbr="),
    "UPS": ("track", "https://www.ups.com/track?loc=en_US&tracknum="),
    "EXCEL": ("list", ""),
    "Own transport": ("driver", ""),
    "Spedycja": ("label", "SUPPLY CHAIN"),
}
_ADDRESS = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def ticked(c: Column) -> Column:
    return F.upper(text(c)) == "TRUE"


def addresses(c: Column) -> Column:
    """The addresses of a free text, the first spelling of each, whatever its case."""
    found = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;/]+"), lambda a: a.rlike(_ADDRESS))
    first = lambda all_: F.filter(all_, lambda a, i: F.array_position(F.transform(all_, F.lower), F.lower(a)) == i + 1)
    return F.get(F.transform(F.array(found), first), F.lit(0))  # an array of one: the text is split once


def status(c: Column) -> Column:
    """The told status that a text means, or null."""
    return F.get(F.filter(F.array(*map(F.lit, NOTIFY)), lambda s: F.lower(s) == F.lower(text(c))), F.lit(0))


def group_key(code: Column, client: Column, project: Column, pm: Column, pm_email: Column, delivery: Column) -> Column:
    """The order's code in capitals and its manager in small letters; without a code client, project, manager, day."""
    who = F.lower(F.when(text(pm_email) != "", text(pm_email)).otherwise(text(pm)))
    day = F.coalesce(F.date_format(delivery, "yyyyMMdd"), F.lit(""))
    return F.when(text(code) != "", F.concat(F.upper(text(code)), F.lit("|"), who)).otherwise(F.concat_ws("|", text(client), text(project), who, day))


def first_filled(df: DataFrame, keys: list[str], order: str, columns: list[str], *more: Column) -> DataFrame:
    """One row per group: of each column the first value, by order, that isn't empty, and more aggregates; partial before the shuffle."""
    return df.groupBy(*keys).agg(*more, *[F.min_by(F.col(c), F.when(text(F.col(c)) != "", F.col(order))).alias(c) for c in columns])


def since_marker(df: DataFrame, keys: list[str], at: str, marker: Column) -> DataFrame:
    """The rows after their group's last marker (all, where there is none), by time, ties of a marker's time left out.

    The last markers are combined before they are shuffled; a group of very many rows is split where they meet.
    """
    last = df.filter(marker).groupBy(*keys).agg(F.max(at).alias("marker_at"))
    return df.join(last, keys, "left").filter(F.col("marker_at").isNull() | (F.col(at) > F.col("marker_at"))).select(*df.columns)


def voided(log: DataFrame) -> DataFrame:
    """log and voided: the line no longer counts, because a resend of its group and status was asked for at its time or later, itself apart."""
    last = log.filter(F.col("recipients") == INVALIDATED).groupBy("group", "status").agg(F.max("sent_at").alias("marker_at"))
    gone = F.coalesce((F.col("sent_at") <= F.col("marker_at")) & (F.col("recipients") != INVALIDATED), F.lit(False))
    return log.join(last, ["group", "status"], "left").select(*log.columns, gone.alias("voided"))


def rows_in_group(df: DataFrame, group: str, place: str, status_: str | None = None) -> DataFrame:
    """df's rows with a product, and rows, label: how many rows their group (and status) has, and which."""
    keys = [group, *([status_] if status_ else [])]
    held = df.filter(text(F.col("product")) != "")
    per = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), rows_label(F.min(place), F.max(place)).alias("label"))
    return held.join(per, keys)


def item_id(product: Column) -> Column:
    """What makes two rows the same item: the product's text."""
    return F.lower(text(product))


def reply_to(leader: Column) -> Column:
    """The first address of a project's leader, or an empty text."""
    return F.coalesce(F.get(addresses(leader), F.lit(0)), F.lit(""))


def number(x: Column) -> Column:
    """A cell's number; 0 for anything else."""
    value = text(x).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def redirected(recipients: Column, subject: Column, test: Column) -> Column:
    """struct(to, subject): all to the test's mailbox, with the real ones in the subject, if there is one."""
    on = text(test) != ""
    return F.struct(F.when(on, test).otherwise(F.array_join(recipients, ",")).alias("to"), F.when(on, F.concat(F.lit("[TEST → "), F.array_join(recipients, ", "), F.lit("] "), subject)).otherwise(subject).alias("subject"))


def sent_items(log: DataFrame) -> DataFrame:
    """group, status, item (small letters) of what went out since the last invalidation. log: sent_at, group, status, recipients, items."""
    live = since_marker(log, ["group", "status"], "sent_at", F.col("recipients") == INVALIDATED).filter(F.contains("recipients", F.lit("@")))
    items = live.select("group", "status", F.explode(F.split("items", r" \| ")).alias("item"))
    return items.select("group", "status", F.lower(F.trim("item")).alias("item")).filter("item <> ''").distinct()


def pending(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows (group, status, product) not yet sent under their group and status; doubles wait together."""
    wanted = rows.filter(text(F.col("product")) != "").withColumn("item", F.lower(text(F.col("product"))))
    return wanted.join(sent_items(log), ["group", "status", "item"], "left_anti").drop("item")


def digest(rows: DataFrame, due: Column, day: Column, told: DataFrame | None = None, force: bool = False) -> DataFrame:
    """address, day, rows, products of what is due, a row per address; told (address, day) is left out, unless forced.

    products is in the order of the rows' ord. An address's due rows of one day are gathered in a list.
    """
    each = rows.filter((text(F.col("product")) != "") & due).select(F.explode(F.transform(addresses(F.col("warehouse_email")), F.lower)).alias("address"), day.alias("day"), "ord", "product")
    if told is not None and not force:
        each = each.join(told.select(F.lower("address").alias("address"), "day"), ["address", "day"], "left_anti")
    products = F.transform(F.array_sort(F.collect_list(F.struct("ord", "product"))), lambda x: x["product"])
    return each.groupBy("address", "day").agg(F.count(F.lit(1)).alias("rows"), products.alias("products"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """A count and its Polish form."""
    form = F.when(n == 1, one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)
    return F.concat(n.cast("string"), F.lit(" "), form)


def escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def shipping_line(carrier: Column, detail: Column) -> Column:
    """The line that tells how an order travels, or null."""
    name, more = text(carrier), text(detail)
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(kind).alias("kind"), F.lit(x).alias("x")) for k, (kind, x) in CARRIERS.items()])
    rule = F.get(F.filter(table, lambda r: F.lower(r["name"]) == F.lower(name)), F.lit(0))
    url = F.concat(rule["x"], F.replace(F.url_encode(more), F.lit("+"), F.lit("%20")))
    unknown = F.array_join(F.array_compact(F.array(F.nullif(name, F.lit("")), F.when(more != "", F.concat(F.lit("tracking "), more)))), ", ")
    return (
        F.when((name == "") & (more == ""), None)
        .when(rule.isNull(), unknown)
        .when(rule["kind"] == "label", rule["x"])
        .when(rule["kind"] == "list", F.when(more != "", F.concat(F.lit("Parcel list: "), more)))
        .when(more == "", rule["name"])
        .when(rule["kind"] == "driver", F.concat(rule["name"], F.lit(", driver:\n"), more))
        .otherwise(F.concat(rule["name"], F.lit(", tracking "), more, F.lit(": "), url))
    )


def rows_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("row "), first)).otherwise(F.concat(F.lit("rows "), first, F.lit("–"), last))


def calendar(summary: Column, start: Column, end: Column, description: Column, seed: Column, stamp: Column) -> Column:
    """An all-day event as iCalendar text; its end is exclusive."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    held = lambda c: F.regexp_replace(c, "([,;])", r"\\$1")
    lines = [F.lit(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//platen//EN", "METHOD:PUBLISH", "BEGIN:VEVENT")]
    lines += [F.concat(F.lit("UID:"), F.regexp_replace(seed, r"[^\w]", ""), F.lit("@platen")), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start)), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(end, 1)))]
    lines += [F.concat(F.lit("SUMMARY:"), held(summary)), F.concat(F.lit("DESCRIPTION:"), held(F.replace(description, F.lit("\n"), F.lit("\\n")))), F.lit("END:VEVENT"), F.lit("END:VCALENDAR")]
    return F.array_join(F.array(*lines), "\r\n")


#: A list that a person orders: it is put in order in one task, which this bounds.
LISTED = 1_000_000


def reordered(df: DataFrame, wanted: DataFrame, key: str = "id", place: str = "ord") -> DataFrame:
    """df with place anew: the wanted keys (key, pos) first in their order, the others as they were. For lists of at most LISTED rows."""
    if df.limit(LISTED + 1).count() > LISTED:
        raise ValueError(f"more than {LISTED} rows: nobody ordered them by hand")
    once = wanted.groupBy(key).agg(F.min("pos").alias("pos"))
    out = df.join(once, key, "left")
    return out.withColumn(place, F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_last(), place))).drop("pos")


def upserted(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """df with the changes' rows in place of those of the same key, and the new ones added."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)
