"""Month-end: what was received and not booked, what is expected and not invoiced, estimates, totals, journal, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import money

from .reports import median_by

EXPECTABLE = ["freight", "destination", "delivery"]


def received_not_booked(docs: DataFrame, shipments: DataFrame, period_end: str, lookback: int = 365) -> DataFrame:
    """Received documents that the period owes and hasn't booked, and those left out with the reason.

    ``docs``: org_id, shipment_id, doc_id, doc_type, vendor_key, total, home, bill_date, booked_on (null: not posted),
    duplicate (boolean). ``shipments``: org_id, shipment_id, ship_date, rejected. A document belongs if it is dated in
    time or its shipment had shipped by then, so late invoices fall into the period of the shipment; it is booked if it
    was posted with a date in the period. Returns the documents with ``line`` (accrue, rejected, duplicate) and the signed home amount.
    """
    end = F.lit(period_end).cast("date")
    rows = docs.join(shipments, ["org_id", "shipment_id"], "left")
    shipped = F.coalesce(F.col("ship_date") <= end, F.lit(False))
    rows = rows.filter((F.col("bill_date") <= end) | shipped).filter(~F.coalesce(F.col("booked_on") <= end, F.lit(False)))
    recent = F.col("bill_date") >= F.date_sub(end, lookback)
    line = F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(F.coalesce("duplicate", F.lit(False)), "duplicate").otherwise("accrue")
    sign = F.when(F.col("doc_type") == "credit_note", -F.abs("home")).otherwise(F.col("home")).cast(money.MONEY)
    rows = rows.withColumns({"line": line, "amount_home": sign})
    return rows.filter((F.col("line") == "accrue") | recent)


def history(parts: DataFrame) -> DataFrame:
    """Past cost per shipment, vendor and charge group: one row for however many invoices. ``parts``: org_id, shipment_id, vendor_key, group, lane, destination, boxes, home."""
    return parts.groupBy("org_id", "shipment_id", "vendor_key", "group").agg(
        F.min("destination").alias("destination"), F.min("lane").alias("lane"), F.max("boxes").alias("boxes"), F.sum("home").cast(money.MONEY).alias("home")
    )


def usual_groups(facts: DataFrame, billed: DataFrame, least: int = 3) -> DataFrame:
    """How usual each charge group is among comparable shipments: those to the same port if there are enough, else all.

    ``facts``: org_id, shipment_id, destination. ``billed``: org_id, shipment_id, destination, group. Returns org_id,
    destination, group, share and expected (share of at least a half; null if history is too short).
    """
    n_dest = facts.groupBy("org_id", "destination").agg(F.count_distinct("shipment_id").alias("n_dest"))
    n_all = facts.groupBy("org_id").agg(F.count_distinct("shipment_id").alias("n_all"))
    g_dest = billed.groupBy("org_id", "destination", "group").agg(F.count_distinct("shipment_id").alias("g_dest"))
    g_all = billed.groupBy("org_id", "group").agg(F.count_distinct("shipment_id").alias("g_all"))
    frame = n_dest.join(n_all, "org_id").withColumn("group", F.explode(F.array(*map(F.lit, EXPECTABLE))))
    rows = frame.join(g_dest, ["org_id", "destination", "group"], "left").join(g_all, ["org_id", "group"], "left").na.fill(0, ["g_dest", "g_all"])
    near = F.col("destination").isNotNull() & (F.col("n_dest") >= least)
    share = F.when(near, F.col("g_dest") / F.col("n_dest")).when(F.col("n_all") >= least, F.col("g_all") / F.col("n_all"))
    return rows.select("org_id", "destination", "group", share.alias("share"), (share >= 0.5).alias("expected"))


def estimates(missing: DataFrame, past: DataFrame, quoted: DataFrame, least: int = 3) -> DataFrame:
    """An amount for each charge group not invoiced yet: by quote, else the vendor's median on the lane, else the organisation's.

    ``missing``: org_id, shipment_id, group, vendor_key, lane, boxes (null: one assumed). ``past``: the rows of ``history``.
    ``quoted``: org_id, vendor_key, group, per_box, home. Medians are of cost per container, exact, times the containers.
    Confidence: 0.9 by quote; 0.65 or 0.55 by vendor and 0.35 or 0.30 by organisation as past costs spread little or much;
    0.1 (0.05) less if the containers are assumed.
    """
    per = past.withColumn("per_box", money.half_even(F.col("home").cast("decimal(18,2)") / F.greatest(F.col("boxes"), F.lit(1)).cast("decimal(10,0)")))

    def typical(by: list[str], rows: DataFrame, tag: str) -> DataFrame:
        mid = median_by(rows, by, "per_box", f"{tag}_typical", ends=True).filter(F.col("n") >= least)
        spread = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(99)
        return mid.select(*by, f"{tag}_typical", spread.cast("double").alias(f"{tag}_spread"))

    vendor = typical(["org_id", "group", "vendor_key", "lane"], per.filter("lane is not null"), "v")
    ships = past.groupBy("org_id", "shipment_id", "group").agg(F.sum("home").alias("home"), F.max("boxes").alias("boxes"))
    ships = ships.withColumn("per_box", money.half_even(F.col("home").cast("decimal(18,2)") / F.greatest(F.col("boxes"), F.lit(1)).cast("decimal(10,0)")))
    org = typical(["org_id", "group"], ships, "o")
    q = quoted.groupBy("org_id", "vendor_key", "group").agg(
        F.sum(F.when(F.col("per_box"), F.col("home"))).alias("q_box"), F.sum(F.when(~F.col("per_box"), F.col("home"))).alias("q_flat")
    )
    n = F.coalesce("boxes", F.lit(1))
    rows = missing.join(q, ["org_id", "vendor_key", "group"], "left").join(vendor, ["org_id", "group", "vendor_key", "lane"], "left").join(org, ["org_id", "group"], "left")
    zero = F.lit(0).cast(money.MONEY)
    by_quote = F.when(F.col("q_box").isNotNull() | F.col("q_flat").isNotNull(), money.half_even(F.coalesce("q_box", zero) * n + F.coalesce("q_flat", zero)))
    by_vendor, by_org = money.half_even(F.col("v_typical") * n), money.half_even(F.col("o_typical") * n)
    rows = rows.withColumn("amount_home", F.coalesce(by_quote, by_vendor, by_org))
    method = F.when(by_quote.isNotNull(), "quote").when(by_vendor.isNotNull(), "vendor_median").when(by_org.isNotNull(), "org_median").otherwise("none")
    guess = F.when(F.col("boxes").isNull(), 1).otherwise(0)
    trust = (
        F.when(F.col("method") == "quote", F.lit(90) - 10 * guess)
        .when(F.col("method") == "vendor_median", F.when(F.col("v_spread") <= 1.5, 65).otherwise(55) - 10 * guess)
        .when(F.col("method") == "org_median", F.when(F.col("o_spread") <= 2, 35).otherwise(30) - 5 * guess)
    )
    rows = rows.withColumn("method", method).withColumn("confidence", (trust / 100).cast("decimal(4,2)"))
    return rows.select("org_id", "shipment_id", "group", "vendor_key", "method", "amount_home", "confidence", confidence_label(F.col("confidence"), F.col("method")).alias("label"))


def confidence_label(value: Column, method: Column) -> Column:
    return (
        F.when(method == "received", "Actual").when(method == "manual", "Set by a person").when(value.isNull() | (method == "none"), "None")
        .when(value >= 0.8, "High").when(value >= 0.55, "Medium").otherwise("Low")
    )


def accrual_totals(lines: DataFrame) -> DataFrame:
    """Totals of a report overall, by vendor and by account, in one pass; lines without a home amount aren't counted.

    ``lines``: org_id, kind (received, estimate), vendor_key, account, shipment_id, amount_home.
    """
    counted = lines.filter("amount_home is not null")
    sets = counted.groupingSets([["org_id"], ["org_id", "vendor_key"], ["org_id", "account"]], "org_id", "vendor_key", "account")
    zero = F.lit(0).cast(money.MONEY)

    def part(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount_home"))), zero).cast(money.MONEY)

    out = sets.agg(part("received").alias("received"), part("estimate").alias("estimated"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "vendor").otherwise("account")
    return out.withColumns({"level": level, "total": (F.col("received") + F.col("estimated")).cast(money.MONEY)}).drop("_g")


#: An estimate below this confidence asks for a look.
SURE = 0.55
LINE_VIEWS = ["received", "estimate", "attention", "all"]


def line_view(lines: DataFrame, view: str = "all") -> DataFrame:
    """Lines of a report by view: received, estimate, those that want attention (no amount in the home currency, or an unsure estimate), or all, also for an unknown view.

    ``lines``: kind, amount_home, confidence (null where nothing is estimated).
    """
    if view in ("received", "estimate"):
        return lines.filter(F.col("kind") == view)
    return lines.filter(F.col("amount_home").isNull() | F.coalesce(F.col("confidence") < SURE, F.lit(False))) if view == "attention" else lines


def line_views(lines: DataFrame) -> DataFrame:
    """All lines in each of LINE_VIEWS that shows them, named by ``view``; the lines are read once."""
    unsure = F.col("amount_home").isNull() | F.coalesce(F.col("confidence") < SURE, F.lit(False))
    shown = {"received": F.col("kind") == "received", "estimate": F.col("kind") == "estimate", "attention": unsure, "all": F.lit(True)}
    views = F.filter(F.array(*[F.when(shown[v], F.lit(v)) for v in LINE_VIEWS]), lambda v: v.isNotNull())
    return lines.withColumn("view", F.explode(views))


def journal(lines: DataFrame, credit_account: str = "Accrued liabilities") -> DataFrame:
    """Debits per account and vendor, one credit for their sum, and the same with signs swapped for the next month.

    Lines that come to zero are left out. Both entries balance.
    """
    sums = lines.filter("amount_home is not null").groupBy("org_id", "account", "vendor_key").agg(F.sum("amount_home").cast(money.MONEY).alias("amount"))
    debits = sums.filter("amount <> 0")
    credit = debits.groupBy("org_id").agg((-F.sum("amount")).cast(money.MONEY).alias("amount"))
    entry = debits.unionByName(credit.select("org_id", F.lit(credit_account).alias("account"), F.lit("").alias("vendor_key"), "amount"))
    both = F.explode(F.array(F.struct(F.lit("accrual").alias("entry"), F.lit(1).alias("sign")), F.struct(F.lit("reversal").alias("entry"), F.lit(-1).alias("sign"))))
    return entry.withColumn("e", both).select("org_id", "e.entry", "account", "vendor_key", (F.col("amount") * F.col("e.sign")).cast(money.MONEY).alias("amount"))


def compare_versions(old: DataFrame, new: DataFrame, key: list[str], value: str = "amount_home") -> DataFrame:
    """Lines added, removed or changed between two versions of a report, with the difference."""
    a, b = old.select(*key, F.col(value).alias("old"), F.lit(1).alias("_a")), new.select(*key, F.col(value).alias("new"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    zero = F.lit(0).cast(money.MONEY)
    diff = (F.coalesce("new", zero) - F.coalesce("old", zero)).cast(money.MONEY)
    return both.withColumns({"change": change, "difference": diff}).filter("change is not null").select(*key, "change", "old", "new", "difference")


def checksum(rows: DataFrame, by: list[str]) -> DataFrame:
    """A digest of each group's rows that depends neither on their order nor on that of the columns.

    Each row is hashed with its columns in order of name, every value after its length ('-' for null). Two sums of 60-bit
    parts of the digests stand for the set of rows, so they combine before they shuffle and nothing is gathered; count and
    sums are hashed again. Repeated rows count as often as they come.
    """
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))) for c in sorted(rows.columns) if c not in by]
    body = F.sha2(F.concat_ws(";", *cells), 256)
    part = [F.sum(F.conv(F.substring("_row", at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    sums = rows.select(*by, body.alias("_row")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), part[0].alias("_a"), part[1].alias("_b"))
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", "n", "_a", "_b"), 256).alias("checksum"))


def latest_version(snapshots: DataFrame, by: list[str], version: str = "version") -> DataFrame:
    """The rows of each period's latest version."""
    top = Window.partitionBy(*by)
    return snapshots.withColumn("_top", F.max(version).over(top)).filter(F.col(version) == F.col("_top")).drop("_top")
