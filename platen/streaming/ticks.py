"""Sending on ticks as a stream: each batch of ticked groups sends what their rows still wait for, and logs it.

A batch that runs again finds its own lines in the log and sends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import orders

LOG = "sent_at timestamp, group string, status string, recipients string, items string"


def sent(ticks: DataFrame, rows: DataFrame, log: DataFrame) -> DataFrame:
    """LOG lines of what ticks (group, status, ticked_at) send: a line per group and status with rows that wait.

    rows: group, status, product, pm_email. An order's items are gathered in its line.
    """
    asked = ticks.groupBy("group", "status").agg(F.max("ticked_at").alias("sent_at"))
    waiting = orders.pending(rows.join(asked.select("group", "status"), ["group", "status"], "left_semi"), log)
    per = waiting.groupBy("group", "status").agg(F.array_join(F.array_sort(F.collect_set(orders.item_id(F.col("product")))), orders.ITEMS).alias("items"), F.array_join(F.array_sort(F.collect_set(F.get(orders.addresses(F.col("pm_email")), F.lit(0)))), ", ").alias("recipients"))
    return per.filter("recipients <> ''").join(asked, ["group", "status"]).select("sent_at", "group", "status", "recipients", "items")


def on_ticks(ticks: DataFrame, rows: Callable[[], DataFrame], log_path: str) -> DataStreamWriter:
    """A writer that appends to the log under log_path what each batch of a stream of ticks sends; rows() reads the sheet as it stands."""

    def batch(own: DataFrame, _: int) -> None:
        log = own.sparkSession.read.schema(LOG).parquet(log_path)
        sent(own, rows(), log).write.mode("append").parquet(log_path)

    return ticks.writeStream.foreachBatch(batch)
