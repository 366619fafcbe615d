"""Reports over documents, bills and events: ageing, totals by currency, dense calendars, pair counts, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import dates, money
from quaywise.sources.scratch import materialise

#: Payable ages in days past due, and dispute ages in days open.
AP_BUCKETS = [("current", 0, 0), ("1-30", 1, 30), ("31-60", 31, 60), ("61-90", 61, 90), ("90+", 91, None)]
DISPUTE_BUCKETS = [("0-7", 0, 7), ("8-30", 8, 30), ("31-60", 31, 60), ("61+", 61, None)]


def bucket_of(days: Column, buckets: list[tuple[str, int, int | None]]) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, _, high in buckets:
        chain = chain.when(F.lit(True) if high is None else days <= high, F.lit(name))
    return chain


def ageing(bills: DataFrame, today: str, buckets=AP_BUCKETS) -> DataFrame:
    """Open bills (org_id, amount, home, due_on) by days past due: count, amount and share of the largest bucket.

    No due date counts as not due. Bills without a rate (``home`` null) are counted apart, in ``unconverted``. All buckets appear.
    """
    late = F.greatest(F.lit(0), F.coalesce(F.datediff(F.lit(today).cast("date"), "due_on"), F.lit(0)))
    rows = bills.filter("amount > 0").withColumn("bucket", bucket_of(late, buckets))
    sums = rows.groupBy("org_id", "bucket").agg(
        F.count("home").alias("n"), F.coalesce(F.sum("home"), F.lit(0)).cast(money.MONEY).alias("amount"), F.count_if(F.col("home").isNull()).alias("unconverted")
    )
    frame = bills.select("org_id").distinct().select("org_id", F.explode(F.array(*[F.lit(b[0]) for b in buckets])).alias("bucket"))
    out = frame.join(sums, ["org_id", "bucket"], "left").na.fill(0, ["n", "unconverted"]).withColumn("amount", F.coalesce("amount", F.lit(0).cast(money.MONEY)))
    top = F.max("amount").over(Window.partitionBy("org_id"))
    return out.withColumn("share", F.when(top > 0, F.bround(100 * F.col("amount") / top).cast("int")).otherwise(0))


def totals_by_currency(docs: DataFrame) -> DataFrame:
    """Per shipment: invoices less credits by currency, as a map, and in the home currency (null if any rate is missing).

    ``docs`` have org_id, shipment_id, doc_type, total, currency, rate.
    """
    signed = F.when(F.col("doc_type") == "credit_note", -F.abs("total")).otherwise(F.col("total"))
    rows = docs.filter(F.col("doc_type").isin("freight_invoice", "commercial_invoice", "credit_note") & F.col("total").isNotNull())
    by = rows.groupBy("org_id", "shipment_id", "currency").agg(F.sum(signed).cast(money.MONEY).alias("total"), F.first("rate").alias("rate"))
    home = money.half_even(F.col("total") * F.col("rate"))
    by = by.withColumn("home", F.when(F.col("currency") == "USD", F.col("total")).otherwise(home))
    entry = F.array_sort(F.collect_list(F.struct("currency", "total")))
    whole = F.when(F.count_if(F.col("home").isNull()) == 0, F.sum("home").cast(money.MONEY))
    return by.groupBy("org_id", "shipment_id").agg(F.map_from_entries(entry).alias("totals"), whole.alias("home"))


def dense_days(rows: DataFrame, day: str, first: str, last: str, measures: list[Column], fill: list[str]) -> DataFrame:
    """Measures for every day of a period, days without rows as zero."""
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    sums = rows.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(F.col(day).alias("day")).agg(*measures)
    return calendar.join(sums, "day", "left").na.fill(0, fill)


def dense_months(rows: DataFrame, day: str, first: str, last: str, measures: list[Column], fill: list[str], most: int = 61) -> DataFrame:
    """Measures for every month of a period, at most ``most`` of them."""
    start = F.trunc(F.lit(first).cast("date"), "month")
    months = F.slice(F.sequence(start, F.lit(last).cast("date"), F.expr("interval 1 month")), 1, most)
    calendar = rows.sparkSession.range(1).select(F.explode(months).alias("month"))
    inside = rows.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return calendar.join(inside.groupBy(dates.month_start(day).alias("month")).agg(*measures), "month", "left").na.fill(0, fill)


def pair_quality(groups: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision and recall of a grouping over pairs of documents, from group sizes alone (no pairs are made)."""

    sizes = materialise(groups.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n")), "sizes")  # groups may be costly to find

    def pairs(*by: str) -> DataFrame:
        n = F.col("n").cast("decimal(20,0)")
        return sizes.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("decimal(38,0)")), F.lit(0)).cast("long").alias("pairs"))

    t, f, b = pairs(truth), pairs(found), pairs(truth, found)
    one = t.select(F.col("pairs").alias("true_pairs")).crossJoin(f.select(F.col("pairs").alias("found_pairs"))).crossJoin(b.select(F.col("pairs").alias("shared_pairs")))
    return one.withColumns({"precision": F.try_divide("shared_pairs", "found_pairs"), "recall": F.try_divide("shared_pairs", "true_pairs")})


def median_by(rows: DataFrame, by: list[str], value: str, out: str = "median", ends: bool = False) -> DataFrame:
    """Exact decimal median of each group and its count; with ``ends`` also its least and greatest value (lo, hi). Values are counted first, so a hot group costs its distinct values, not its rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"_upto": upto, "_n": F.sum("n").over(w)})
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2 + 1)
    first = F.col("_upto") - F.col("n") + 1
    two = [F.max(F.when((first <= k) & (k <= F.col("_upto")), F.col(value))) for k in (low, high)]
    mid = money.half_even((two[0] + two[1]).cast("decimal(38,4)") / F.lit(2))
    more = [F.min(value).alias("lo"), F.max(value).alias("hi")] if ends else []
    return placed.groupBy(*by).agg(mid.alias(out), F.max("_n").alias("n"), *more)


def first_and_last(events: DataFrame, by: list[str], at: list[str], value: str) -> DataFrame:
    """First and last value of each key by time."""
    order = F.struct(*at, value)
    return events.groupBy(*by).agg(F.min(order)[value].alias("first"), F.max(order)[value].alias("last"), F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list; pages below one are the first, sizes other than 25, 50 and 100 are 25."""
    size = size if size in (25, 50, 100) else 25
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def roi(rows: DataFrame) -> DataFrame:
    """Yearly saving of a year's invoices. ``rows``: invoices, minutes_today, minutes_with, hourly_cost, error_share (percent),
    avg_overcharge, price (a month), all decimal. Adds hours_month, labor, overcharges, cost, net (whole units) and payback in months (null if never)."""
    d = "decimal(38,10)"
    hours = (F.col("invoices") * (F.col("minutes_today") - F.col("minutes_with"))).cast(d) / F.lit(60)
    labor = (F.col("invoices") * (F.col("minutes_today") - F.col("minutes_with")) * F.col("hourly_cost")).cast(d) / F.lit(5)
    over = (F.col("invoices") * 12 * F.col("error_share") * F.col("avg_overcharge")).cast(d) / F.lit(100)
    cost = (F.col("price") * 12).cast(d)
    gain = (labor + over).cast(d)
    return rows.withColumns({
        "hours_month": F.round(hours, 1).cast("decimal(18,1)"), "labor": F.round(labor).cast("decimal(18,0)"), "overcharges": F.round(over).cast("decimal(18,0)"), "cost": F.round(cost).cast("decimal(18,0)"),
        "net": F.round(gain - cost).cast("decimal(18,0)"), "payback": F.when(gain > 0, F.round(cost * 12 / gain, 1)).cast("decimal(18,1)"),
    })


def usage(docs: DataFrame, at: str, zone: str, allowance: int, percent: int = 110) -> DataFrame:
    """Documents of each organisation and local month, the hard limit of its allowance, and whether it is reached."""
    month = F.trunc(dates.local_day(at, F.lit(zone)), "month")
    limit = max(allowance, -(-allowance * percent // 100))
    return docs.groupBy("org_id", month.alias("month")).agg(F.count(F.lit(1)).alias("n")).withColumns({"hard_limit": F.lit(limit), "reached": F.col("n") >= limit})
