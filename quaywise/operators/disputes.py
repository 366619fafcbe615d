"""Disputes: what an invoice can be disputed for, default amounts, credits that name them, what was recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.functions import keys, money

OPEN = ["draft", "sent", "acknowledged", "credit_received"]
WAITING = ["sent", "acknowledged"]


def disputable(issues: DataFrame, disputes: DataFrame) -> DataFrame:
    """Invoices with money at risk in open issues and no open dispute: the codes and the sum for each currency.

    ``issues``: the schema of rules. ``disputes``: org_id, invoice_id, status.
    """
    busy = disputes.filter(F.col("status").isin(OPEN)).select("org_id", F.col("invoice_id").alias("doc_id")).distinct()
    rows = issues.filter("doc_id is not null and amount_at_risk > 0").join(busy, ["org_id", "doc_id"], "left_anti")
    return rows.groupBy("org_id", "shipment_id", "doc_id", "currency").agg(
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.sum("amount_at_risk").cast(money.MONEY).alias("amount")
    )


def default_amounts(disputes: DataFrame, items: DataFrame) -> DataFrame:
    """Each dispute's amount: its items' money at risk in the dispute's currency, items without a currency among them."""
    same = F.col("amount").isNotNull() & (F.coalesce("item_currency", F.lit("")).isin("") | (F.col("item_currency") == F.col("currency")))
    rows = disputes.select("dispute_id", "currency").join(items.withColumnRenamed("currency", "item_currency"), "dispute_id", "left")
    return rows.groupBy("dispute_id").agg(F.coalesce(F.sum(F.when(same, F.col("amount"))), F.lit(0)).cast(money.MONEY).alias("amount"))


def credit_suggestions(credits: DataFrame, disputes: DataFrame) -> DataFrame:
    """Credit notes that name the invoice of exactly one waiting dispute of the vendor, in its currency: dispute_id, doc_id, amount.

    ``credits``: org_id, doc_id, vendor_name, original (invoice number), total, currency, received_on. ``disputes``: org_id, dispute_id,
    vendor_key, invoice_number, currency, status, credit_note (null: none yet). Of several credits of a dispute the latest is offered.
    """
    named = credits.withColumns({"vendor_key": keys.vendor_key("vendor_name"), "_no": keys.norm_ref("original")}).filter("_no <> '' and total is not null and total <> 0")
    waiting = disputes.filter(F.col("status").isin(WAITING) & F.col("credit_note").isNull()).withColumn("_no", keys.norm_ref("invoice_number"))
    single = waiting.groupBy("org_id", "vendor_key", "_no").agg(F.count(F.lit(1)).alias("_n"), F.min("dispute_id").alias("dispute_id"), F.min("currency").alias("_currency")).filter("_n = 1")
    met = named.join(single, ["org_id", "vendor_key", "_no"]).filter("currency is null or _currency is null or currency = _currency")
    best = met.groupBy("dispute_id").agg(F.max(F.struct("received_on", "doc_id", F.abs("total").alias("amount"))).alias("c"))
    return best.select("dispute_id", "c.doc_id", F.col("c.amount").cast(money.MONEY).alias("amount"))


def recorded(credits: DataFrame) -> DataFrame:
    """What becomes of a credit that a person records: ok, or why it is refused.

    ``credits``: dispute_id, status, amount, disputed, invoice_total (null: unknown), confirmed (a credit over the disputed amount was confirmed).
    """
    outcome = (
        F.when(~F.col("status").isin([*WAITING, "credit_received"]), "not waiting").when(F.col("amount").isNull() | (F.col("amount") <= 0), "no amount")
        .when(F.col("amount") > F.col("invoice_total"), "above the invoice").when((F.col("disputed") > 0) & (F.col("amount") > F.col("disputed")) & ~F.col("confirmed"), "above the dispute").otherwise("ok")
    )
    short = F.when(F.col("outcome") == "ok", F.greatest(F.lit(0).cast(money.MONEY), (F.col("disputed") - F.col("amount")).cast(money.MONEY)))
    return credits.withColumn("outcome", outcome).withColumn("outstanding", short)


def recoveries(disputes: DataFrame) -> DataFrame:
    """What each organisation got back, in its home currency and by month; disputes without a rate are counted apart.

    ``disputes``: org_id, status, recovered_home (null: no rate), recovered, recovered_on.
    """
    rows = disputes.filter(F.col("status").isin("credit_received", "resolved") & (F.col("recovered") > 0))
    return rows.groupBy("org_id", F.trunc("recovered_on", "month").alias("month")).agg(
        F.coalesce(F.sum("recovered_home"), F.lit(0)).cast(money.MONEY).alias("recovered"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("recovered_home").isNull()).alias("unconverted")
    )
