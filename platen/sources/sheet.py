"""An order sheet as CSV: its columns are found by the first line of their headers, whatever their order or case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header of each role.
HEADERS = {
    "deadline": "MAX DEADLINE KLIENTA", "delivery": "Data dostawy do klienta", "shipped": "Data wysyłki z Polski", "warehouse_date": "Data maila do magazynu", "produced": "Data ukończenia produkcji",
    "confirmed": "Data potwierdzenia", "status": "Stan", "approve": "Zatwierdź maila", "sent_at": "Wysłano", "client": "Klient", "pm": "PM", "pm_email": "E-mail PM", "warehouse_email": "E-mail magazyn odbiorcy",
    "warehouse_size": "wymiar i waga paczki - uprzedzenie magazynu odbiorcy", "project": "Projekt", "order_code": "Nr zlecenia", "product": "Produkt", "carrier": "Przewoźnik dostawy", "address": "Adres dostawy",
    "size": "Wymiar i waga (szacunek)", "tracking": "Numer śledzenia", "offer": "Link do oferty", "days_before": "Dni przed", "days_after": "Dni po", "leader": "LEADER",
}
REQUIRED = ["status", "client", "project", "pm", "product"]
DATES = ["deadline", "delivery", "shipped", "warehouse_date", "produced", "confirmed"]


def _plain(header: str) -> str:
    lines = (header or "").splitlines()
    return lines[0].strip().lower() if lines else ""


def orders(spark: SparkSession, path: str, headers: dict[str, str] = HEADERS) -> DataFrame:
    """A column for each role (null where the sheet has none) and ord; a missing required role is an error.

    ord grows with the rows of a file; days are dates, all else is text.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    found = {_plain(c): c for c in reversed(raw.columns)}
    missing = [headers[r] for r in REQUIRED if _plain(headers[r]) not in found]
    if missing:
        raise ValueError("missing headers: " + ", ".join(missing))
    column = lambda role: F.col("`" + found[_plain(headers[role])].replace("`", "``") + "`") if _plain(headers[role]) in found else F.lit(None).cast("string")
    typed = lambda role: column(role).try_cast("date") if role in DATES else column(role)
    return raw.select(F.monotonically_increasing_id().alias("ord"), *[typed(r).alias(r) for r in headers])
