"""Validation rules. Each takes tables and returns issues of one schema, so that rules are unioned and new ones added.

Documents have org_id, shipment_id, doc_id, doc_type, vendor_name, number, currency, total (decimal), invoice_date,
received_on, boxes, container. Issues have org_id, shipment_id, doc_id, code, severity, key, amount_at_risk, currency and
fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import containers, keys, money
from quaywise.sources.scratch import materialise

from .order import placed

ERROR, WARNING = "error", "warning"
COLUMNS = ["org_id", "shipment_id", "doc_id", "code", "severity", "key", "amount_at_risk", "currency", "fingerprint"]
PAYABLE = ["freight_invoice", "commercial_invoice"]
#: Sums may differ from the printed total by this much.
TOTAL_TOLERANCE = "0.02"


def issue(rows: DataFrame, code: Column | str, severity: Column | str, key: Column, at_risk: Column | None = None) -> DataFrame:
    """Rows of documents or shipments as issues."""
    code = F.lit(code) if isinstance(code, str) else code
    severity = F.lit(severity) if isinstance(severity, str) else severity
    doc = F.col("doc_id") if "doc_id" in rows.columns else F.lit(None).cast("long")
    currency = F.col("currency") if "currency" in rows.columns else F.lit(None).cast("string")
    amount = (F.lit(None) if at_risk is None else at_risk).cast(money.MONEY)
    return rows.select(
        "org_id", "shipment_id", doc.alias("doc_id"), code.alias("code"), severity.alias("severity"),
        F.coalesce(key.cast("string"), F.lit("")).alias("key"), amount.alias("amount_at_risk"), currency.alias("currency"),
        keys.fingerprint(code, doc, key).alias("fingerprint"),
    )


def overstated(docs: DataFrame, lines: DataFrame, *more: Column) -> DataFrame:
    """Documents whose lines don't add up to the printed total, with ``over``, total less lines, and ``more`` aggregates of the lines."""
    sums = lines.groupBy("doc_id").agg(F.sum(F.coalesce("amount", F.lit(0).cast(money.MONEY))).cast(money.MONEY).alias("line_sum"), *more)
    off = docs.filter("total is not null").join(sums, "doc_id").withColumn("over", (F.col("total") - F.col("line_sum")).cast(money.MONEY))
    return off.filter(F.abs("over") > F.lit(TOTAL_TOLERANCE).cast(money.MONEY))


def total_mismatch(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that don't add up to the printed total; an overstated total is at risk."""
    return issue(overstated(docs, lines), "total_mismatch", ERROR, F.lit(""), F.when(F.col("over") > 0, F.col("over")))


def _earlier_copy(docs: DataFrame, by: list[str]) -> DataFrame:
    """Documents with an earlier one (smaller id, received no later) of the same keys, and the least such id as ``copy_of``.

    Each day of a group is met as one row, so a group of any size is a window over its days; a document's least id received no later
    is its copy if it isn't its own. Documents without a value in a key, or a day, are never copies.
    """
    on = ["org_id", "doc_type", *by]
    days = docs.groupBy(*on, "received_on").agg(F.min("doc_id").alias("_least")).filter("received_on is not null")
    upto = Window.partitionBy(*on).orderBy("received_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = days.select(*on, "received_on", F.min("_least").over(upto).alias("copy_of"))
    return docs.join(first, [*on, "received_on"]).filter("copy_of < doc_id")


def vendor_keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``_vendor``, the key of their vendor; each distinct name is normalised once."""
    names = docs.select("vendor_name").distinct().withColumn("_vendor", keys.vendor_key("vendor_name"))
    return docs.join(names, "vendor_name", "left").withColumn("_vendor", F.coalesce("_vendor", F.lit("")))


def duplicates(docs: DataFrame, types: list[str] | None = None, code: str = "duplicate_invoice") -> DataFrame:
    """Same vendor, number and amount as an earlier document of its type; the amount is at risk.

    Keys that more than one document has are counted first and their documents written; only those are compared by day.
    """
    named = vendor_keyed(docs.filter(F.col("doc_type").isin(types or PAYABLE))).withColumn("_number", keys.norm_ref("number")).filter("_number <> ''")
    on = ["org_id", "doc_type", "_vendor", "_number", "total"]
    often = named.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*on)
    few = materialise(named.join(often, on, "left_semi"), "copies")
    return issue(_earlier_copy(few, on[2:]), code, ERROR, F.col("copy_of"), F.col("total"))


def changed_copies(entries: DataFrame) -> DataFrame:
    """Customs entries that repeat an earlier one's number: duplicate if the total is the same, else changed.

    ``entries`` are documents whose ``number`` is the entry number.
    """
    w = Window.partitionBy("org_id", "_number").orderBy("received_on", "doc_id")
    rows = entries.withColumn("_number", keys.norm_ref("number")).filter("_number <> ''")
    rows = rows.withColumns({"_first": F.first("doc_id").over(w), "_total": F.first(F.struct("total")).over(w)["total"]})
    late = rows.filter("doc_id <> _first")
    same = F.col("total").eqNullSafe(F.col("_total"))
    return issue(
        late, F.when(same, F.lit("duplicate_customs_entry")).otherwise(F.lit("customs_entry_changed")),
        F.when(same, F.lit(ERROR)).otherwise(F.lit(WARNING)), F.col("_first"), F.when(same, F.col("total")),
    )


def outliers(docs: DataFrame, high: str = "2.5", low: str = "0.4", least: int = 3) -> DataFrame:
    """Freight invoices whose cost per container is far from the median of the vendor's other ones.

    Leaving a value out of a sorted history shifts those behind it by one, so the medians of all invoices of a vendor need
    only the three values around its middle. Those come from counts of distinct values, whose places are summed over ranges of
    values (``order.placed``), so a vendor of a third of all invoices is dealt over a third of the tasks; they join the invoices back.
    """
    d10 = "decimal(38,10)"
    rows = vendor_keyed(docs.filter("doc_type = 'freight_invoice' and total is not null"))
    boxes = F.greatest(F.lit(1), F.coalesce(F.col("boxes"), F.lit(1)))
    rows = rows.withColumn("per_box", (F.col("total").cast("decimal(18,2)") / boxes.cast("decimal(10,0)")).cast(d10))
    by = ["org_id", "_vendor"]
    counts = placed(rows.filter("total <> 0").groupBy(*by, "per_box").agg(F.count(F.lit(1)).alias("_c")), by, [F.col("per_box")], "_c")
    counts = counts.withColumnRenamed("upto", "_upto").join(counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    half = F.floor(F.col("_n") / 2)
    holds = [(F.col("_upto") - F.col("_c") < half + i) & (half + i <= F.col("_upto")) for i in range(3)]
    middle = counts.groupBy(*by).agg(F.max("_n").alias("_n"), *[F.max(F.when(h, F.col("per_box"))).alias(f"_m{i}") for i, h in enumerate(holds)])
    rows = rows.join(middle, by)
    counts_self = F.col("total") != 0

    def kept(place: Column) -> Column:  # the value at a place of the history without the row itself
        here = F.when(place == half, F.col("_m0")).otherwise(F.col("_m1"))
        after = F.when(place == half, F.col("_m1")).otherwise(F.col("_m2"))
        return F.when(counts_self & ((place < 1) | (F.col("per_box") <= here)), after).otherwise(here)

    n = F.col("_n") - F.when(counts_self, 1).otherwise(0)
    typical = money.half_even((kept(F.floor((n + 1) / 2)) + kept(F.floor(n / 2) + 1)).cast("decimal(38,10)") / F.lit(2))
    rows = rows.filter(n >= least).withColumn("typical", typical)
    far = (F.col("per_box") > F.col("typical") * F.lit(high).cast("decimal(4,2)")) | (F.col("per_box") < F.col("typical") * F.lit(low).cast("decimal(4,2)"))
    over = money.half_even((F.col("per_box") - F.col("typical")) * boxes)
    return issue(rows.filter(far), "amount_outlier", WARNING, F.lit(""), F.when(F.col("per_box") > F.col("typical"), over))


def missing_documents(docs: DataFrame) -> DataFrame:
    """Shipments without a bill of lading or a commercial invoice."""
    have = docs.groupBy("org_id", "shipment_id").agg(
        F.max(F.col("doc_type") == "bill_of_lading").alias("bl"), F.max(F.col("doc_type") == "commercial_invoice").alias("ci")
    )
    lacks = F.array_compact(F.array(F.when(~F.col("bl"), F.lit("missing_bl")), F.when(~F.col("ci"), F.lit("missing_commercial_invoice"))))
    return issue(have.select("org_id", "shipment_id", F.explode(lacks).alias("what")), F.col("what"), WARNING, F.lit(""))


def container_rules(docs: DataFrame) -> DataFrame:
    """Containers that fail their check digit, and valid ones that the shipment's bills of lading don't list."""
    rows = docs.filter("container is not null").withColumns({"_c": keys.norm_ref("container"), "_ok": containers.is_valid("container")})
    bad = issue(rows.filter("not _ok"), "invalid_container", ERROR, F.col("_c"))
    listed = rows.filter("doc_type = 'bill_of_lading'").select("org_id", "shipment_id", "_c").distinct()
    billed = rows.filter("doc_type <> 'bill_of_lading' and _ok").join(listed.select("org_id", "shipment_id").distinct(), ["org_id", "shipment_id"], "left_semi")
    stray = billed.join(listed, ["org_id", "shipment_id", "_c"], "left_anti")
    return bad.unionByName(issue(stray, "container_not_on_bl", ERROR, F.col("_c")))


def credit_notes(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """Credit notes without, or larger than, the invoice that they name (``original``), or for one in another shipment.

    The invoice has the number named; if both vendors are known they must agree; the earliest counts.
    """
    inv = invoices.filter(F.col("doc_type").isin(PAYABLE)).select(
        F.col("org_id"), keys.norm_ref("number").alias("_o"), keys.vendor_key("vendor_name").alias("_iv"), F.col("doc_id").alias("inv_id"),
        F.col("shipment_id").alias("inv_shipment"), F.col("total").alias("inv_total"), F.col("currency").alias("inv_currency"), F.col("received_on").alias("inv_on"),
    )
    named = credits.withColumns({"_o": keys.norm_ref("original"), "_v": keys.vendor_key("vendor_name")})
    vendors = (F.col("_v") == "") | F.col("_iv").isNull() | (F.col("_iv") == "") | (F.col("_v") == F.col("_iv"))
    pairs = named.join(inv, ["org_id", "_o"], "left").withColumn("_fits", F.col("inv_id").isNotNull() & vendors & (F.col("_o") != ""))
    best = F.min(F.when(F.col("_fits"), F.struct("inv_on", "inv_id", "inv_shipment", "inv_total", "inv_currency")))
    keep = ["org_id", "shipment_id", "doc_id", "currency", "total", "_o"]
    got = pairs.groupBy(*keep).agg(best.alias("i"))
    code = (
        F.when(F.col("_o") == "", "credit_no_original")
        .when(F.col("i").isNull(), "credit_original_not_found")
        .when(~F.col("i.inv_shipment").eqNullSafe(F.col("shipment_id")), "credit_original_elsewhere")
        .when((F.col("i.inv_currency") == F.col("currency")) & (F.abs("total") > F.col("i.inv_total")), "credit_exceeds_invoice")
    )
    return issue(got.withColumn("what", code).filter("what is not null"), F.col("what"), WARNING, F.col("_o"))


def field_rules(fields: DataFrame, required: dict[str, list[str]], threshold: float = 0.85) -> DataFrame:
    """Missing required fields, and fields read with low confidence that nobody confirmed.

    ``fields`` are entity-attribute-value rows: org_id, shipment_id, doc_id, doc_type, name, value, confidence, source. The
    key lists the names in the order of ``required`` (missing) or of the alphabet (doubtful).
    """
    ids = ["org_id", "shipment_id", "doc_id", "doc_type"]
    names = sorted({n for v in required.values() for n in v})
    wide = fields.groupBy(*ids).pivot("name", names).agg(F.first("value", ignorenulls=True))
    chain = F.when(F.lit(False), F.array().cast("array<string>"))
    for kind, wanted in required.items():
        empty = [F.when(F.coalesce(F.trim(n), F.lit("")).isin("", "[]"), F.lit(n)) for n in wanted]
        chain = chain.when(F.col("doc_type") == kind, F.array_compact(F.array(*empty)))
    lacking = wide.select(*ids, chain.alias("_lack")).filter("size(_lack) > 0")
    low = fields.filter((F.col("confidence") < threshold) & ~F.col("source").eqNullSafe("human"))
    low = low.groupBy(*ids).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("_low"))
    return issue(lacking, "missing_field", ERROR, F.array_join("_lack", ",")).unionByName(issue(low, "low_confidence", WARNING, F.col("_low")))


Rule = Callable[[dict[str, DataFrame]], DataFrame]
#: Rules over named tables; register more with ``register``.
RULES: dict[str, Rule] = {
    "total_mismatch": lambda t: total_mismatch(t["documents"], t["lines"]),
    "duplicates": lambda t: duplicates(t["documents"]),
    "duplicate_credit_notes": lambda t: duplicates(t["documents"], ["credit_note"], "duplicate_credit_note"),
    "outliers": lambda t: outliers(t["documents"]),
    "missing_documents": lambda t: missing_documents(t["documents"]),
    "containers": lambda t: container_rules(t["documents"]),
}


def register(name: str, rule: Rule) -> None:
    RULES.setdefault(name, rule)


def validate(tables: dict[str, DataFrame], resolved: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """Issues of all rules; those whose fingerprint a person resolved before don't come again."""
    found = reduce(DataFrame.unionByName, [RULES[n](tables) for n in only or RULES])
    return found if resolved is None else found.join(resolved.select("org_id", "fingerprint"), ["org_id", "fingerprint"], "left_anti").select(COLUMNS)


def status_of(issues: DataFrame, shipments: DataFrame) -> DataFrame:
    """Each shipment's status by its open issues: needs_review if it has any error, else ready."""
    errors = issues.groupBy("org_id", "shipment_id").agg(F.count_if(F.col("severity") == ERROR).alias("n_errors"), F.count_if(F.col("severity") == WARNING).alias("n_warnings"))
    out = shipments.select("org_id", "shipment_id").distinct().join(errors, ["org_id", "shipment_id"], "left").na.fill(0, ["n_errors", "n_warnings"])
    return out.withColumn("status", F.when(F.col("n_errors") > 0, "needs_review").otherwise("ready"))
