"""What month-end expects and hasn't received: open charge groups of shipments, the vendors likely to bill them, parts of invoices by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import money

from .close import EXPECTABLE

#: Why a vendor is thought to bill a group, best first.
WHY = ["on_shipment", "usual_here", "usual", "quotes"]


def not_invoiced(facts: DataFrame, billed: DataFrame, expected: DataFrame, adjustments: DataFrame, period_end: str, lookback: int = 365) -> DataFrame:
    """Charge groups that a shipment should carry and that nobody billed, with what becomes of each.

    ``facts``: org_id, shipment_id, destination, ship_date, rejected. ``billed``: org_id, shipment_id, group. ``expected``: org_id,
    destination, group. ``adjustments``: org_id, shipment_id, group, action (exclude, amount), amount. Returns state: estimate,
    manual (a person's amount), excluded, and those left out: rejected (shipped within the look-back), no_ship_date, too_old;
    shipments that left after the period aren't listed. ``billed_groups`` names what was billed so far.
    """
    end = F.lit(period_end).cast("date")
    oldest = F.date_sub(end, lookback)
    where = F.coalesce("destination", F.lit(""))
    wanted = expected.select("org_id", where.alias("_where"), "group").distinct()
    rows = facts.withColumn("_where", where).join(wanted, ["org_id", "_where"]).drop("_where")
    rows = rows.join(billed.select("org_id", "shipment_id", "group").distinct(), ["org_id", "shipment_id", "group"], "left_anti")
    named = billed.filter(F.col("group").isin(EXPECTABLE)).groupBy("org_id", "shipment_id").agg(F.array_join(F.array_sort(F.collect_set("group")), ",").alias("billed_groups"))
    rows = rows.join(named, ["org_id", "shipment_id"], "left").join(adjustments, ["org_id", "shipment_id", "group"], "left")
    state = (
        F.when(F.col("rejected"), F.when(F.col("ship_date").between(oldest, end), "rejected"))
        .when(F.col("ship_date").isNull(), "no_ship_date").when(F.col("ship_date") > end, None).when(F.col("ship_date") < oldest, "too_old")
        .when(F.col("action") == "exclude", "excluded").when((F.col("action") == "amount") & F.col("amount").isNotNull(), "manual").otherwise("estimate")
    )
    rows = rows.withColumn("state", state).filter("state is not null")
    return rows.select("org_id", "shipment_id", "group", "state", F.coalesce("billed_groups", F.lit("")).alias("billed_groups"), F.when(F.col("state") == "manual", F.col("amount")).alias("amount"))


def vendor_frequency(past: DataFrame, by: list[str]) -> DataFrame:
    """Vendors that billed a charge group, most frequent first. ``past``: the rows of close.history; ``by`` adds keys such as the port."""
    keys = ["org_id", "group", *by]
    n = past.groupBy(*keys, "vendor_key").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "vendor_key")))


def usual_group(past: DataFrame, order: list[str] = [*EXPECTABLE, "other"]) -> DataFrame:  # noqa: B006
    """The charge group that a vendor bills most; equal counts go by ``order``."""
    n = past.groupBy("org_id", "vendor_key", "group").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("group"))
    return n.groupBy("org_id", "vendor_key").agg(F.max(F.struct("n", (-place).alias("p"), "group"))["group"].alias("group"))


def first_candidates(missing: DataFrame, on_shipment: DataFrame, past: DataFrame, quotes: DataFrame) -> DataFrame:
    """The likeliest vendor of each missing group and why: one on the shipment that bills the group elsewhere (the earliest
    document's first), the most frequent at its port, the most frequent of all, or one with a quote.

    ``missing``: org_id, shipment_id, group, destination. ``on_shipment``: org_id, shipment_id, vendor_key, doc_id. ``quotes``: org_id,
    group, vendor_key. Each way gives one vendor for a key, so no shipment is paired with all vendors.
    """
    bills = past.select("org_id", "group", "vendor_key").distinct()
    here = on_shipment.join(bills, ["org_id", "vendor_key"]).groupBy("org_id", "shipment_id", "group").agg(F.min(F.struct("doc_id", "vendor_key"))["vendor_key"].alias("on_shipment"))
    port = vendor_frequency(past, ["destination"]).filter("place = 1").select("org_id", "group", "destination", F.col("vendor_key").alias("usual_here"))
    usual = vendor_frequency(past, []).filter("place = 1").select("org_id", "group", F.col("vendor_key").alias("usual"))
    offers = quotes.groupBy("org_id", "group").agg(F.min("vendor_key").alias("quotes"))
    rows = missing.join(here, ["org_id", "shipment_id", "group"], "left").join(port, ["org_id", "group", "destination"], "left")
    rows = rows.join(usual, ["org_id", "group"], "left").join(offers, ["org_id", "group"], "left")
    why = F.coalesce(*[F.when(F.col(w).isNotNull(), F.lit(w)) for w in WHY])
    return rows.select("org_id", "shipment_id", "group", F.coalesce(*WHY).alias("vendor_key"), why.alias("why"))


def parts_by_group(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """An invoice's amount in each charge group; what its total differs by goes to the largest part, which also names its group.

    ``lines``: doc_id, group, amount. ``totals``: doc_id, total. A gap larger than the total itself is left alone.
    """
    sums = lines.groupBy("doc_id", "group").agg(F.sum("amount").cast(money.MONEY).alias("amount")).join(totals, "doc_id")
    w = Window.partitionBy("doc_id")
    gap = (F.col("total") - F.sum("amount").over(w)).cast(money.MONEY)
    place = F.row_number().over(w.orderBy(F.abs("amount").desc(), "group"))
    rows = sums.withColumns({"_gap": gap, "main": place == 1})
    taken = F.col("main") & (F.abs("_gap") <= F.abs("total"))
    return rows.select("doc_id", "group", F.when(taken, (F.col("amount") + F.col("_gap")).cast(money.MONEY)).otherwise(F.col("amount")).alias("amount"), "main")


def on_board_day(text: Column | str) -> Column:
    """The date after 'on board' in a bill of lading, on the same or the next line; null if none is printed."""
    from quaywise.functions import dates

    t = F.col(text) if isinstance(text, str) else text
    day = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[ /.-](?:\d{1,2}|[A-Za-z]{3,9})[ /.-]\d{2,4}|[A-Za-z]{3,9} \d{1,2}, \d{4}"
    return dates.parse_date(F.regexp_extract(t, r"(?i)on\s*board\b[^\n]*?\n?[^\n]*?(" + day + ")", 1))
