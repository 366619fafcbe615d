"""Exports of shipments, documents, issues and catches: filters with checked parameters, one row each, cells that no spreadsheet runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions import money
from quaywise.functions.text import guard_cell

SHIPMENT_TABS = ["needs_review", "ready", "approved", "posted", "rejected", "open", "all"]
DOCUMENT_VIEWS = ["attention", "matched", "all"]
LOOSE = ["new", "processing", "unmatched", "error", "needs_review"]
#: Documents that only hold others.
CONTAINER_STATUSES = ["split", "archive"]


def _one_of(value: str | None, allowed: list[str], default: str) -> str:
    value = value or default
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def in_days(rows: DataFrame, day: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose day lies between two ISO dates, both included; a date that isn't one is refused."""
    for text, keep in ((first, F.col(day) >= F.lit(first)), (last, F.col(day) <= F.lit(last))):
        if text:
            date.fromisoformat(text)
            rows = rows.filter(keep)
    return rows


def filter_shipments(rows: DataFrame, status: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    status = _one_of(status, SHIPMENT_TABS, "needs_review")
    return in_days(rows if status == "all" else rows.filter(F.col("status") == status), "created_on", first, last)


def filter_documents(rows: DataFrame, view: str | None = None, doc_type: str | None = None, text: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Documents of a view and type whose name or number has a text, without those that only hold others."""
    view = _one_of(view, DOCUMENT_VIEWS, "attention")
    rows = rows.filter(~F.col("status").isin(CONTAINER_STATUSES))
    if view != "all":
        rows = rows.filter(F.col("status").isin(LOOSE) if view == "attention" else F.col("status") == "matched")
    if doc_type:
        rows = rows.filter(F.col("doc_type") == doc_type)
    if text:
        q = F.lit(text.lower())
        rows = rows.filter(F.contains(F.lower("number"), q) | F.contains(F.lower("vendor_name"), q))
    return in_days(rows, "received_on", first, last)


def filter_issues(rows: DataFrame, open_only: bool = False, severity: str | None = None) -> DataFrame:
    rows = rows.filter(~F.col("resolved")) if open_only else rows
    return rows.filter(F.col("severity") == _one_of(severity, ["error", "warning"], "")) if severity else rows


def money_text(rows: DataFrame, by: list[str], amount: str, currency: str, out: str) -> DataFrame:
    """Amounts of a key by currency as one cell, 'EUR 1,000.00; USD 20.00'."""
    sums = rows.filter(F.col(amount).isNotNull()).groupBy(*by, currency).agg(F.sum(amount).cast(money.MONEY).alias("_a"))
    entry = F.struct(F.col(currency).alias("c"), F.concat_ws(" ", currency, F.format_number("_a", 2)).alias("t"))
    return sums.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "; ").alias(out))


def shipments(rows: DataFrame, docs: DataFrame, issues: DataFrame, home_rate: Column) -> DataFrame:
    """A row for each shipment: documents, invoices and credits with their totals, open issues and the money at risk.

    ``rows``: org_id, shipment_id, status. ``docs``: org_id, shipment_id, doc_id, doc_type, total, currency; ``home_rate`` is the rate of a
    document's currency. ``issues``: open ones, with severity, code, amount_at_risk and currency.
    """
    by = ["org_id", "shipment_id"]
    credit = F.col("doc_type") == "credit_note"
    payable = docs.filter(F.col("doc_type").isin("freight_invoice", "commercial_invoice", "credit_note")).withColumn("signed", F.when(credit, -F.abs("total")).otherwise(F.col("total")).cast(money.MONEY))
    counts = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(credit).alias("n_credits"), F.count_if(F.col("doc_type").isin("freight_invoice", "commercial_invoice")).alias("n_invoices"))
    sums = payable.groupBy(*by, "currency").agg(F.sum("signed").cast(money.MONEY).alias("t"), F.first(home_rate).alias("rate"))
    home = sums.withColumn("home", money.half_even(F.col("t") * F.col("rate"))).groupBy(*by).agg(F.when(F.count_if(F.col("home").isNull()) == 0, F.sum("home").cast(money.MONEY)).alias("total_home"))
    found = issues.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.array_join(F.array_sort(F.collect_set("code")), "; ").alias("open_issues"))
    out = rows.join(counts, by, "left").join(money_text(payable, by, "signed", "currency", "totals"), by, "left").join(home, by, "left")
    out = out.join(money_text(payable.filter(credit).withColumn("c", F.abs("total")), by, "c", "currency", "credits"), by, "left").join(found, by, "left")
    out = out.join(money_text(issues.filter("amount_at_risk > 0"), by, "amount_at_risk", "currency", "at_risk"), by, "left")
    return out.na.fill(0, ["n_docs", "n_credits", "n_invoices", "n_errors", "n_warnings"]).na.fill("", ["totals", "credits", "open_issues", "at_risk"])


def documents(docs: DataFrame, fields: DataFrame, links: DataFrame, names: list[str], threshold: float = 0.85) -> DataFrame:
    """A row for each document: its values by name, the shipment that it is in (if any) with its status, and what a person should check.

    ``docs``: doc_id and more. ``fields``: doc_id, name, value, confidence, source. ``links``: doc_id, shipment_id, shipment_status.
    """
    doubt = (F.col("confidence") < threshold) & ~F.col("source").eqNullSafe("human")
    wide = fields.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"value_{n}") for n in names],
        F.array_join(F.array_sort(F.collect_set(F.when(doubt, F.col("name")))), ", ").alias("to_check"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("source") == "human", F.col("name")))), ", ").alias("corrected"),
    )
    return docs.join(wide, "doc_id", "left").join(links, "doc_id", "left")


def savings(catches: DataFrame) -> DataFrame:
    """Catches that count, as they are exported: the outcome amounts add up to ``counted``; withdrawn ones are left out."""
    counted = (F.col("prevented") + F.col("at_risk") + F.col("accepted")).cast(money.MONEY)
    return catches.filter("outcome <> 'withdrawn'").select("catch_id", "code", "outcome", "caught", counted.alias("counted"), F.trunc("month", "month").alias("month"), guard_cell("vendor").alias("vendor"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV that spreadsheets open as UTF-8 (the header begins with a byte-order mark) and whose cells they don't run."""
    cells = [guard_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    out = rows.select(*cells)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.csv(path, header=True, escape='"')
