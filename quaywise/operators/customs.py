"""Customs entries and free time: duty of each line, user fees, entered value, last free days and their stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaywise.functions import dates, keys, money

from .rates import as_of

#: First entry date, least and largest merchandise processing fee in dollars; the rate is 0.3464 percent.
MPF_STEPS = [
    ("0001-01-01", "25.00", "485.00"), ("2018-01-01", "25.67", "497.99"), ("2018-10-01", "26.22", "508.70"), ("2019-10-01", "26.79", "519.76"),
    ("2020-10-01", "27.23", "528.33"), ("2021-10-01", "27.75", "538.40"), ("2022-10-01", "29.66", "575.35"), ("2023-10-01", "31.67", "614.35"),
    ("2024-10-01", "32.71", "634.62"), ("2025-10-01", "33.58", "651.50"), ("2026-10-01", "34.58", "670.86"),
]
MPF_PERCENT, HMF_PERCENT = "0.3464", "0.125"


def parse_rate(x: Column | str) -> Column:
    """An ad valorem rate in percent: '4.9%' is 4.9, 'Free' is 0; null for specific and compound rates."""
    t = F.lower(F.trim(F.col(x) if isinstance(x, str) else x))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*%?$", 1).try_cast("decimal(18,6)")
    return F.when(t.isin("free", "0", "0%", "0.0%", "nil", "exempt"), F.lit(0).cast("decimal(18,6)")).otherwise(number)


def line_duty(lines: DataFrame, tolerance: str = "1.00") -> DataFrame:
    """Duty of each entry line: value times rate, half-up, and whether the stated duty is off by more than the tolerance.

    ``lines``: doc_id, position, hts, value, rate (text), stated. An additional-duty line (chapter 99) without a value takes
    that of the line above it, which a window over each entry's lines carries down.
    """
    digits = F.regexp_replace(F.coalesce("hts", F.lit("")), "[^0-9]", "")
    extra = digits.startswith("99")
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(~extra & F.col("value").isNotNull(), F.col("value")), ignorenulls=True).over(w)
    rows = lines.withColumn("used_value", F.coalesce("value", F.when(extra, above)).cast(money.MONEY))
    expected = money.half_up(F.col("used_value").cast("decimal(18,2)") * parse_rate("rate") / F.lit(100))
    rows = rows.withColumn("expected", expected).withColumn("difference", (F.col("stated") - F.col("expected")).cast(money.MONEY))
    return rows.withColumn("mismatch", F.coalesce(F.abs("difference") > F.lit(tolerance).cast(money.MONEY), F.lit(False)))


def user_fees(entries: DataFrame) -> DataFrame:
    """Expected processing fee (kept within the bounds of its date) and harbour fee of entries (doc_id, entry_date, value)."""
    spark: SparkSession = entries.sparkSession
    steps = spark.createDataFrame(MPF_STEPS, "start string, least string, most string")
    steps = steps.select(F.col("start").cast("date").alias("start"), F.col("least").cast(money.MONEY).alias("least"), F.col("most").cast(money.MONEY).alias("most"))
    rows = as_of(entries, steps, "entry_date", "start")
    raw = money.half_up(F.col("value") * F.lit(MPF_PERCENT).cast("decimal(8,4)") / F.lit(100))
    hmf = money.half_up(F.col("value") * F.lit(HMF_PERCENT).cast("decimal(8,4)") / F.lit(100))
    return rows.withColumns({"mpf": F.least(F.greatest(raw, "least"), "most"), "hmf": hmf}).drop("start", "least", "most")


def value_check(entries: DataFrame, invoiced: DataFrame, percent: str = "1.0") -> DataFrame:
    """Entered value against the invoices of the shipment: low or high beyond ``percent`` of the invoiced value.

    Only shipments invoiced in one currency, the entry's, are compared. ``entries``: shipment_id, doc_id, currency, value.
    ``invoiced``: shipment_id, currency, total.
    """
    sums = invoiced.groupBy("shipment_id").agg(F.count_distinct("currency").alias("n"), F.max("currency").alias("_cur"), F.sum("total").cast(money.MONEY).alias("invoiced"))
    rows = entries.join(sums.filter("n = 1"), "shipment_id").filter("currency = _cur and invoiced > 0")
    gap = F.col("value") - F.col("invoiced")
    allowed = F.col("invoiced") * F.lit(percent).cast("decimal(6,3)") / F.lit(100)
    code = F.when(gap < -allowed, "entered_value_low").when(gap > allowed, "entered_value_high")
    return rows.withColumns({"code": code, "gap": gap.cast(money.MONEY)}).filter("code is not null").select("shipment_id", "doc_id", "code", "gap")


def latest_notice(notices: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """For each key the last non-null value of every field in order of arrival: a later notice wins, what it leaves out stays."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_v"))))["_v"].alias(f) for f in fields]
    return notices.groupBy(*by).agg(*last)


def free_time_status(rows: DataFrame, today: Column, lead_days: int = 2) -> DataFrame:
    """Stage and urgency of each container.

    ``rows``: start (discharge), free_days, weekends (boolean), picked_up, returned, detention_days, daily (null: no rate).
    Demurrage runs until pick-up, detention from then until the empty is returned. Adds stage, last_free, days_left, tone (ok,
    soon, today, late, unknown, closed) and accrued cost.
    """
    stage = F.when(F.col("returned").isNotNull(), "closed").when(F.col("picked_up").isNotNull(), "detention").otherwise("demurrage")
    last = F.when(stage == "demurrage", dates.last_free_day("start", "free_days", "weekends")).when(stage == "detention", dates.last_free_day("picked_up", "detention_days", "weekends"))
    rows = rows.withColumns({"stage": stage, "last_free": last}).withColumn("days_left", F.datediff("last_free", today))
    left = F.col("days_left")
    tone = F.when(F.col("stage") == "closed", "closed").when(left.isNull(), "unknown").when(left > lead_days, "ok").when(left > 0, "soon").when(left == 0, "today").otherwise("late")
    cost = F.when(left < 0, money.half_even(F.col("daily") * -left))
    return rows.withColumns({"tone": tone, "accrued": cost})


def hts_format(lines: DataFrame) -> DataFrame:
    """Lines whose tariff number has the wrong form: for US entries ten digits, or eight in chapter 99; elsewhere six to ten.

    ``lines``: hts, us (boolean) and more. Anything but digits, dots and blanks is wrong, and so are chapters 00 and 77.
    """
    digits = F.regexp_replace("hts", "[^0-9]", "")
    n = F.length(digits)
    ok = F.when(F.col("us"), (n == 10) | (digits.startswith("99") & (n == 8))).otherwise(n.between(6, 10))
    ok = ok & ~F.col("hts").rlike(r"[^\d.\s]") & ~F.substring(digits, 1, 2).isin("00", "77")
    return lines.filter((F.trim("hts") != "") & ~ok)


def entry_arithmetic(entries: DataFrame, lines: DataFrame, tolerance: str = "1.00") -> DataFrame:
    """Entries whose printed sums don't add up: doc_id, code, expected, stated and what is overcharged.

    ``entries``: doc_id, total_duty, total_value, fees, grand_total (null where not printed). ``lines``: doc_id, stated (duty), value (own,
    null for a line that takes the value above). Checked are the lines' duties against total_duty, their values
    against total_value, and duty (printed, else the lines') plus fees against grand_total; only sums with both sides.
    """
    sums = lines.groupBy("doc_id").agg(F.sum("stated").cast(money.MONEY).alias("_duty"), F.sum("value").cast(money.MONEY).alias("_value"))
    rows = entries.join(sums, "doc_id", "left")
    due = (F.coalesce("total_duty", "_duty") + F.coalesce("fees", F.lit(0).cast(money.MONEY))).cast(money.MONEY)
    checks = [("duty_total_mismatch", F.col("_duty"), F.col("total_duty")), ("entered_value_total_mismatch", F.col("_value"), F.col("total_value")), ("duty_fees_total_mismatch", due, F.col("grand_total"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), e.alias("expected"), s.cast(money.MONEY).alias("stated")) for c, e, s in checks])).alias("x")
    off = rows.select("doc_id", each).select("doc_id", "x.*").filter(F.abs(F.col("stated") - F.col("expected")) > F.lit(tolerance).cast(money.MONEY))
    over = F.when((F.col("code") != "entered_value_total_mismatch") & (F.col("stated") > F.col("expected")), (F.col("stated") - F.col("expected")).cast(money.MONEY))
    return off.withColumn("at_risk", over)


def entry_number(x: Column | str) -> Column:
    """An entry number as filer, serial and check digit, without punctuation: 'ABC-1234567-8' -> 'ABC12345678'; null if it isn't one."""
    bare = F.upper(F.regexp_replace(F.col(x) if isinstance(x, str) else x, "[^A-Za-z0-9]", ""))
    return F.when(bare.rlike("^[A-Z0-9]{3}[0-9]{8}$"), bare)


def entry_numbers_in(text: Column | str) -> Column:
    """Distinct entry numbers that a text prints."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\b[A-Z0-9]{3}[- ]?[0-9]{7}[- ]?[0-9]\b"), F.lit(0)), entry_number)))


def by_entry(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents without a shipment that name a customs entry of one, by their own entry number or by printing one: doc_id, shipment_id.

    ``docs``: org_id, doc_id, text, entry (null: none). ``entries``: org_id, shipment_id, entry. The own number comes first, then the
    shipment of least id.
    """
    known = entries.select("org_id", "shipment_id", entry_number("entry").alias("number")).filter("number is not null").distinct()
    met = _entries_named(docs).join(known, ["org_id", "number"])
    return met.groupBy("org_id", "doc_id").agg(F.min(F.struct("way", "shipment_id"))["shipment_id"].alias("shipment_id"))


def _entries_named(docs: DataFrame) -> DataFrame:
    """org_id, doc_id, way (0: the document's own number, 1: one that it prints), number."""
    own = F.array_compact(F.array(entry_number("entry")))
    ways = [F.transform(own, lambda n: F.struct(F.lit(0).alias("way"), n.alias("number"))), F.transform(entry_numbers_in("text"), lambda n: F.struct(F.lit(1).alias("way"), n.alias("number")))]
    return docs.select("org_id", "doc_id", F.explode(F.array_distinct(F.concat(*ways))).alias("n")).select("org_id", "doc_id", "n.way", "n.number")


def beside_entry(docs: DataFrame, known: DataFrame) -> DataFrame:
    """A fallback of ``grouping``: documents join the shipment of the customs entry that they name, by their own number first, then the least document.

    Both have org_id, doc_id, text and entry (null: none). Returns org_id, doc_id, beside, beside_method.
    """
    entries = known.select("org_id", F.col("doc_id").alias("beside"), entry_number("entry").alias("number")).filter("number is not null")
    met = _entries_named(docs).join(entries, ["org_id", "number"]).filter("beside <> doc_id")
    return met.groupBy("org_id", "doc_id").agg(F.min(F.struct("way", "beside"))["beside"].alias("beside")).withColumn("beside_method", F.lit("customs_entry"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """The last copy received of each entry number, so that a corrected entry's duty counts once. ``entries``: org_id, number, received_on, doc_id."""
    w = Window.partitionBy("org_id", F.coalesce(entry_number("number"), F.col("doc_id").cast("string"))).orderBy(F.col("received_on").desc(), F.col("doc_id").desc())
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Names of countries of origin by code.
COUNTRIES = {
    "CN": ["china", "peoples republic of china", "prc", "p r china"], "VN": ["vietnam", "viet nam"], "TR": ["turkey", "turkiye", "türkiye"],
    "IN": ["india"], "MX": ["mexico"], "CA": ["canada"], "US": ["united states", "usa", "us", "united states of america"], "DE": ["germany"],
    "IT": ["italy"], "FR": ["france"], "ES": ["spain"], "NL": ["netherlands", "the netherlands", "holland"],
    "GB": ["united kingdom", "uk", "great britain", "england"], "JP": ["japan"], "KR": ["korea", "south korea", "republic of korea"], "TW": ["taiwan"],
    "TH": ["thailand"], "MY": ["malaysia"], "ID": ["indonesia"], "BD": ["bangladesh"], "PK": ["pakistan"], "KH": ["cambodia"], "HK": ["hong kong"],
    "SG": ["singapore"], "PH": ["philippines"], "BR": ["brazil"], "LK": ["sri lanka"], "PL": ["poland"], "PT": ["portugal"], "BE": ["belgium"],
}


def country_code(x: Column | str) -> Column:
    """The code of a country's name or code; a name that isn't known stays, in capitals, so that two of them still compare; '' for none."""
    bare = F.replace(F.replace(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), F.lit("'"), F.lit("")), F.lit("’"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-zà-ÿ ]", " "), " +", " "))
    names = F.create_map(*[F.lit(v) for code, own in COUNTRIES.items() for n in own for v in (n, code)])
    return F.when(F.upper(plain).isin(list(COUNTRIES)), F.upper(plain)).otherwise(F.coalesce(F.try_element_at(names, plain), F.upper(plain)))


def printed_origin(text: Column | str) -> Column:
    """The country after 'country of origin' or 'made in' in a text, as a code; null if none is printed or its name isn't known."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.regexp_extract(t, r"(?i)(?:country of origin|origin country|country of manufacture|made in)\s*[:-]?\s*([A-Za-z][A-Za-z .']{1,60})", 1)
    words = F.split(F.trim(F.regexp_replace(F.lower(found), "[^a-z ]", "")), " +")
    tries = F.transform(F.sequence(F.lit(5), F.lit(1), F.lit(-1)), lambda n: country_code(F.array_join(F.slice(words, F.lit(1), n), " ")))
    return F.try_element_at(F.filter(tries, lambda c: c.isin(list(COUNTRIES))), F.lit(1))


def sync_free_time(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """Free-time rows brought in line with the arrival notices: org_id, container, action (new, updated, kept, removed) and the dates.

    ``rows``: org_id, container, manual (a person entered dates), last_free. ``notices``: org_id, container, discharge, free_days, weekends,
    printed (a last free day that the notice prints), one a container (see latest_notice). A printed day counts as it is, else it is
    computed; a row without a notice stays if a person entered its dates.
    """
    plan = notices.withColumn("_plan", F.coalesce("printed", dates.last_free_day("discharge", "free_days", "weekends")))
    both = rows.withColumn("_row", F.lit(True)).join(plan.withColumn("_notice", F.lit(True)), ["org_id", "container"], "full_outer")
    action = F.when(F.col("_row").isNull(), "new").when(F.col("_notice"), "updated").when(F.col("manual"), "kept").otherwise("removed")
    return both.select("org_id", "container", action.alias("action"), F.when(F.col("_notice"), F.col("_plan")).otherwise(F.col("last_free")).alias("last_free"))


def daily_rates(rows: DataFrame, approvals: DataFrame, quoted: DataFrame) -> DataFrame:
    """The daily rate of a container's free-time charge: the cap of an approval for each day, else the vendor's quoted charge for a day.

    ``rows``: org_id, container, vendor_key, code. ``approvals``: org_id, code, max_per_unit, unit. ``quoted``: org_id, vendor_key, code, amount, basis.
    """
    cap = approvals.filter("unit = 'day' and max_per_unit is not null").groupBy("org_id", "code").agg(F.min("max_per_unit").alias("_cap"))
    quote = quoted.filter("basis = 'day'").groupBy("org_id", "vendor_key", "code").agg(F.min("amount").alias("_quote"))
    out = rows.join(cap, ["org_id", "code"], "left").join(quote, ["org_id", "vendor_key", "code"], "left")
    source = F.when(F.col("_cap").isNotNull(), "approval").when(F.col("_quote").isNotNull(), "quote")
    return out.withColumns({"daily": F.coalesce("_cap", "_quote").cast(money.MONEY), "daily_source": source}).drop("_cap", "_quote")


#: Tabs of the free-time page, and the urgency of each tone, most urgent first; what has no date comes last.
FREE_TIME_TABS = {"action": ["late", "today", "soon"], "open": ["late", "today", "soon", "ok", "unknown"], "closed": ["closed"]}


def most_urgent(rows: DataFrame, tab: str, limit: int | None = None) -> DataFrame:
    """Rows of a tab (with tone and days_left), the most urgent first, those without a last free day last."""
    if tab not in FREE_TIME_TABS:
        raise ValueError(f"{tab!r} is none of {', '.join(FREE_TIME_TABS)}")
    out = rows.filter(F.col("tone").isin(FREE_TIME_TABS[tab])).orderBy(F.col("days_left").asc_nulls_last(), "container")
    return out if limit is None else out.limit(limit)


def tariff_pairs(lines: DataFrame) -> DataFrame:
    """Distinct org_id, hts (digits) and description (lower case, single blanks) of entry lines, which a review judges; lines without either, and additional duties (chapter 99), aren't."""
    digits = F.regexp_replace(F.coalesce("hts", F.lit("")), "[^0-9]", "")
    words = keys.squeeze(F.lower(F.coalesce("description", F.lit(""))))
    rows = lines.select("org_id", digits.alias("hts"), words.alias("description"))
    return rows.filter("hts <> '' and description <> '' and not startswith(hts, '99')").distinct()
