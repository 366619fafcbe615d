"""Rate audit and savings: quotes for an invoice, what they allow, extra charges, outcomes of caught money."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import charges, money
from quaywise.sources.scratch import materialise

from . import intervals


def choose_quote(invoices: DataFrame, quotes: DataFrame) -> DataFrame:
    """The most specific quote that fits each invoice, or why there is none.

    ``invoices``: org_id, doc_id, vendor_key, ship_date, origin, destination, equipment (null: unknown).
    ``quotes``: org_id, quote_id, vendor_key, valid_from, valid_to, origin, destination, equipment (null: any), places as
    resolved keys, and ``*_area`` for ports that may stand for each other. Returns doc_id, outcome (matched, none_on_file,
    no_match, ambiguous), quote_id (the best one, also if ambiguous) and n_fit.

    A place scores 0.5 for any, 0.6 if the invoice doesn't say, 1.0 for the same, 0.8 for the same area; equipment 0.5, 0.6 or
    1.0. The highest sum wins, then the latest start, then the largest id. Where the best quote speaks on something that the
    invoice leaves open, the others that fit must agree with it.

    Lanes meet first, each distinct one of a vendor's invoices with each of its quotes: by equal keys on every dimension, which are what
    a quote says (an area stands for its ports), or that it takes any; an invoice's lane that doesn't say meets all by a key of
    its own. Invoices and quotes never meet one by one: quotes are summed up for each lane and bucket of days, and a vendor's lane and day asks
    its buckets, so the work grows with quotes plus days asked.
    """
    dims = {"origin": "origin_area", "destination": "destination_area", "equipment": None}
    vendor, areas = ["org_id", "vendor_key"], list(filter(None, dims.values()))

    def said(c: str, area: str | None) -> Column:
        return F.concat(F.lit("="), F.coalesce(*map(F.col, filter(None, (area, c)))))

    def laned(df: DataFrame, own: list[Column]) -> DataFrame:
        for d, ways in zip(dims, own, strict=True):
            df = df.withColumn(f"_k_{d}", F.explode(ways))
        return df

    any_, open_ = F.lit("any"), F.lit("open")
    quoted = quotes.select(*vendor, *[F.col(c).alias(f"q_{c}") for c in (*dims, *areas)]).distinct()
    q_keys = [F.array(F.when(F.col(f"q_{d}").isNull(), any_).otherwise(said(f"q_{d}", a and f"q_{a}")), open_) for d, a in dims.items()]
    asked = invoices.select(*vendor, *dims, *areas).distinct()
    i_keys = [F.when(F.col(d).isNull(), F.array(open_)).otherwise(F.array(said(d, a), any_)) for d, a in dims.items()]
    lanes = laned(asked, i_keys).join(laned(quoted, q_keys), [*vendor, *[f"_k_{d}" for d in dims]])

    def place(c: str) -> Column:
        want, have = F.col(f"q_{c}"), F.col(c)
        area = F.col(f"q_{c}_area").isNotNull() & (F.col(f"q_{c}_area") == F.col(f"{c}_area"))
        return F.when(want.isNull(), 5).when(have.isNull(), 6).when(want == have, 10).when(area, 8)

    gear = F.when(F.col("q_equipment").isNull(), 5).when(F.col("equipment").isNull(), 6).when(F.col("q_equipment") == F.col("equipment"), 10)
    lanes = lanes.withColumn("_score", place("origin") + place("destination") + gear).filter("_score is not null")
    def named(columns: list[str]) -> Column:
        """A lane's name: its fields, each after its length, '-' for null."""
        return F.concat_ws("", *[F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-")) for c in columns])

    q_fields = [f"q_{c}" for c in (*dims, *areas)]
    lanes = lanes.select(*vendor, "_score", named([*dims, *areas]).alias("_lane"), named(q_fields).alias("_q_lane"), *[f"q_{d}" for d in dims])
    offered = quotes.select(*vendor, "quote_id", "valid_from", "valid_to", *[F.col(c).alias(f"q_{c}") for c in (*dims, *areas)]).withColumn("_q_lane", named(q_fields))
    ends = {f"_{c}": intervals.day_number(F.col(c)) for c in ("valid_from", "valid_to")}
    dated = offered.withColumns(ends).withColumn("_bucket", F.explode(intervals.buckets_within(F.col("_valid_from"), F.col("_valid_to"))))
    parts = dated.groupBy(*vendor, "_q_lane", "_bucket").agg(F.count(F.lit(1)).alias("n_fit"), F.max(F.struct("valid_from", "quote_id")).alias("_last"))

    def summed(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n_fit").alias("n_fit"), F.max("b").alias("b"), *[f(c).alias(c) for d in dims for f, c in ((F.min, f"lo_{d}"), (F.max, f"hi_{d}"))])

    ends = {f"{k}_{d}": F.coalesce(F.col(f"q_{d}"), F.lit("")) for d in dims for k in ("lo", "hi")}
    best = F.struct("_score", "_last.valid_from", "_last.quote_id", *[f"q_{d}" for d in dims])
    parts = summed(parts.join(lanes, [*vendor, "_q_lane"]).withColumns({"b": best, **ends}), [*vendor, "_lane", "_bucket"])
    keys = ["org_id", "doc_id", *dims]
    met = [*vendor, "_lane", "_day"]
    rows = invoices.select(*keys, "vendor_key", named([*dims, *areas]).alias("_lane"), intervals.day_number(F.col("ship_date")).alias("_day"))
    days = rows.select(*met).distinct().withColumn("_bucket", F.explode(intervals.buckets_at(F.col("_day"))))
    fits = summed(days.join(parts, [*vendor, "_lane", "_bucket"]), met)
    on_file = quotes.select("org_id", "vendor_key").distinct().withColumn("_file", F.lit(True))
    rows = rows.join(on_file, vendor, "left").join(fits, met, "left")
    unsaid = F.lit(False)
    for d in dims:
        unsaid = unsaid | (F.col(d).isNull() & F.col(f"b.q_{d}").isNotNull() & (F.col(f"lo_{d}") < F.col(f"hi_{d}")))
    outcome = F.when(F.col("_file").isNull(), "none_on_file").when(F.col("b").isNull(), "no_match").when(unsaid, "ambiguous").otherwise("matched")
    return rows.select("org_id", "doc_id", outcome.alias("outcome"), F.col("b.quote_id").alias("quote_id"), F.coalesce("n_fit", F.lit(0)).alias("n_fit"))


def latest_rule(rows: DataFrame, rules: DataFrame, on: list[str], day: str, row_key: list[str], rule_id: str = "rule_id") -> DataFrame:
    """The rule in force on a row's day: the latest start wins, one without a start comes last, ties go to the larger id.

    Each distinct key and day is resolved once against the periods of its key, then joined back; ``row_key`` columns are kept, and
    ``rule`` is null where none is in force or the row has no day.
    """
    r = rules.select(*on, *[F.col(c).alias(f"r_{c}") for c in rules.columns if c not in on])
    met = intervals.meet(rows.select(*on, day).filter(F.col(day).isNotNull()).distinct(), r, on, day, "r_valid_from", "r_valid_to")
    cols = [f"r_{c}" for c in rules.columns if c not in [*on, "valid_from", rule_id]]
    pick = F.max(F.struct(F.col("r_valid_from").isNotNull().alias("_has"), "r_valid_from", f"r_{rule_id}", *cols))
    # keys and days are few beside the rows; written, their size is known, and rows aren't shuffled by them
    found = materialise(met.groupBy(*on, day).agg(pick.alias("rule")), "rules")
    return rows.select(*dict.fromkeys([*row_key, *on, day])).distinct().join(found, [*on, day], "left").select(*row_key, "rule")


def as_of(rows: DataFrame, steps: DataFrame, day: str, start: str) -> DataFrame:
    """Each row with the step in force on its day: the last one that began no later.

    ``steps`` is a dated table of parameters (a few rows, one a change); each step gets the day before the next one's start as its end.
    Days before the first step take the first; rows without a day take none and are left out. Each distinct day is resolved once.
    """
    w = Window.orderBy(start)  # a handful of rows
    spans = steps.withColumns({"_until": F.date_sub(F.lead(start).over(w), 1), "_from": F.when(F.row_number().over(w) > 1, F.col(start))})
    days = rows.select(day).filter(F.col(day).isNotNull()).distinct()
    return rows.join(intervals.meet(days, spans, [], day, "_from", "_until").drop("_from", "_until"), day)


def over_quote(lines: DataFrame, quoted: DataFrame, percent: float = 2.0, fixed: float = 5.0) -> DataFrame:
    """Base charges above what the quote allows.

    ``lines``: doc_id, code, amount, all_in, boxes, rate (of the invoice's currency). ``quoted``: doc_id, code, allowed (for
    one container), per_box, quote_rate, same_currency. An all-in quote takes charges that it doesn't list as ocean
    freight. A charge that isn't quoted is allowed nothing. Only an excess beyond the tolerance counts.
    """
    listed = quoted.groupBy("doc_id").agg(F.collect_set("code").alias("_codes"))
    rows = lines.join(listed, "doc_id")
    folds = F.col("all_in") & ~F.array_contains("_codes", F.col("code")) & F.array_contains("_codes", F.lit("ocean_freight"))
    rows = rows.withColumn("code", F.when(folds, "ocean_freight").otherwise(F.col("code")))
    sums = rows.groupBy("doc_id", "code").agg(F.sum("amount").cast(money.MONEY).alias("actual"), F.max("boxes").alias("boxes"), F.max("rate").alias("rate"))
    count = F.when(F.col("per_box"), F.greatest(F.col("boxes"), F.lit(1))).otherwise(1)
    got = sums.join(quoted, ["doc_id", "code"], "left")
    asked = money.half_even(F.col("allowed") * count)
    there = money.convert(asked, F.col("quote_rate"), F.col("rate"))
    total = F.when(F.col("allowed").isNull(), F.lit(0).cast(money.MONEY)).when(F.col("same_currency"), asked).otherwise(there)
    got = got.withColumn("allowed_total", total).filter("allowed_total is not null")
    got = got.withColumn("excess", (F.col("actual") - F.col("allowed_total")).cast(money.MONEY))
    tol = money.tolerance(F.col("allowed_total"), percent, fixed)
    return got.withColumn("tolerance", tol).filter(F.col("excess") > F.col("tolerance")).select("doc_id", "code", "actual", "allowed_total", "excess", "tolerance")


def allowed_by_approval(lines: DataFrame) -> DataFrame:
    """What the approval in force allows for each document's lines of an extra charge, and how.

    ``lines``: doc_id, code, description, quantity, amount, rule (struct of latest_rule: r_unit, r_free_units,
    r_max_per_unit, r_max_amount; null if none). Units are read from the line; free units come off unless the line says that
    they have. Returns doc_id, code, actual, verdict (unapproved, no_cap, capped, unreadable), allowed and excess.
    """
    printed = {"_d": F.col("description"), "_q": F.col("quantity").cast("string"), "_unit": F.col("rule.r_unit")}
    units = {u: charges.units_on_line("_d", F.col("_q"), u) for u in ("day", "hour", "each")}
    read = F.when(F.col("_unit") == "day", units["day"]).when(F.col("_unit") == "hour", units["hour"]).otherwise(units["each"])
    # what lines print is read once a distinct print, and written, so that it isn't read again a line
    once = materialise(lines.select(*[c.alias(n) for n, c in printed.items()]).distinct().withColumn("_u", read), "units")
    rows = lines.join(once, reduce(Column.__and__, [c.eqNullSafe(F.col(n)) for n, c in printed.items()]), "left")
    n = F.col("_u.units").cast("decimal(18,4)")
    free = F.coalesce(F.col("rule.r_free_units").cast("decimal(18,4)"), F.lit(0))
    billable = F.when(F.col("_u.chargeable"), n).otherwise(F.greatest(F.lit(0).cast("decimal(18,4)"), n - free))
    rows = rows.withColumn("_part", money.half_even(billable * F.col("rule.r_max_per_unit")))
    g = rows.groupBy("doc_id", "code").agg(
        F.sum("amount").cast(money.MONEY).alias("actual"), F.sum("_part").cast(money.MONEY).alias("_sum"), F.count_if(F.col("_part").isNull()).alias("_unread"),
        F.max("rule.r_max_per_unit").alias("_per"), F.max("rule.r_max_amount").alias("_most"), F.bool_or(F.col("rule").isNotNull()).alias("_has"),
    )
    summed = F.when(F.col("_per").isNotNull() & (F.col("_unread") == 0), F.least("_sum", F.coalesce("_most", "_sum")))
    verdict = (
        F.when(~F.col("_has"), "unapproved")
        .when(F.col("_per").isNull() & F.col("_most").isNull(), "no_cap")
        .when(F.col("_per").isNotNull() & (F.col("_unread") > 0) & F.col("_most").isNull(), "unreadable")
        .otherwise("capped")
    )
    allowed = (
        F.when(F.col("verdict") == "unapproved", F.lit(0).cast(money.MONEY))
        .when(F.col("verdict") == "no_cap", F.col("actual"))
        .when(F.col("verdict") == "capped", F.coalesce(summed, F.col("_most").cast(money.MONEY)))
    )
    g = g.withColumn("verdict", verdict).withColumn("allowed", allowed)
    return g.select("doc_id", "code", "actual", "verdict", "allowed", (F.col("actual") - F.col("allowed")).cast(money.MONEY).alias("excess"))


# --- savings ---------------------------------------------------------------------------------------------------------

#: Checks that flag a whole invoice, single lines, or estimate the whole.
WHOLE_INVOICE = ["duplicate_invoice"]
LINE_LEVEL = ["over_quote", "unapproved_accessorial"]
ESTIMATES = ["amount_outlier"]


def outcomes(catches: DataFrame) -> DataFrame:
    """Split each catch over outcomes: prevented, at_risk, accepted, withdrawn.

    ``catches``: caught, latest, shipment_status, issue_open (null: the issue is gone), issue_resolved, cleared_reason.
    """
    zero = F.lit(0).cast(money.MONEY)
    caught, latest = F.col("caught"), F.least("latest", "caught")
    less = (caught - latest).cast(money.MONEY)
    rejected = F.coalesce(F.col("shipment_status") == "rejected", F.lit(False))
    gone = F.col("issue_open").isNull()
    rates = gone & (F.col("cleared_reason") == "rates")
    paid = F.coalesce(F.col("shipment_status").isin("approved", "posted"), F.lit(False)) | F.coalesce("issue_resolved", F.lit(False))
    rest = F.when(paid, "accepted").otherwise("at_risk")
    main = F.when(rejected, "prevented").when(rates, "withdrawn").when(gone, "prevented").when(latest > 0, rest).otherwise("prevented")
    prevented = F.when(rejected | (gone & ~F.coalesce(rates, F.lit(False))), caught).otherwise(F.greatest(less, zero))
    live = ~rejected & ~gone
    return catches.withColumns({
        "outcome": main, "prevented": prevented,
        "withdrawn": F.when(~rejected & F.coalesce(rates, F.lit(False)), latest).otherwise(zero),
        "accepted": F.when(live & paid, latest).otherwise(zero),
        "at_risk": F.when(live & ~paid, latest).otherwise(zero),
    })


def overlap_factor(catches: DataFrame) -> DataFrame:
    """Add ``factor``: the share of a catch that counts, so money flagged twice on one invoice counts once.

    Beside a whole-invoice catch others count nothing; an estimate counts what exceeds the line-level catches. Only
    document scopes ('d...') overlap, and withdrawn catches take no part. Needs org_id, scope, code, caught, outcome.
    """
    takes = F.col("scope").startswith("d") & (F.col("outcome") != "withdrawn")
    w = Window.partitionBy("org_id", "scope", takes)
    whole = F.max(F.col("code").isin(WHOLE_INVOICE)).over(w)
    lines = F.coalesce(F.sum(F.when(F.col("code").isin(LINE_LEVEL), F.col("caught"))).over(w), F.lit(0)).cast(money.MONEY)
    left = F.greatest(F.lit(0).cast(money.MONEY), F.col("caught") - lines).cast("decimal(38,18)")
    share = F.when((lines != 0) & F.col("code").isin(ESTIMATES) & (F.col("caught") > 0), left / F.col("caught"))
    one = F.lit(1).cast("decimal(38,18)")
    factor = F.when(~takes, one).when(whole, F.when(F.col("code").isin(WHOLE_INVOICE), one).otherwise(F.lit(0).cast("decimal(38,18)"))).otherwise(F.coalesce(share, one))
    return catches.withColumn("factor", factor.cast("decimal(20,10)"))


def savings_sets(catches: DataFrame) -> DataFrame:
    """Totals of all, by code, by vendor and by month in one pass. ``catches``: org_id, code, vendor, month and the outcome amounts."""
    sums = [F.sum(c).cast(money.MONEY).alias(c) for c in ("prevented", "at_risk", "accepted")]
    sets = catches.groupingSets([["org_id"], ["org_id", "code"], ["org_id", "vendor"], ["org_id", "month"]], "org_id", "code", "vendor", "month")
    out = sets.agg(*sums, F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set"))
    level = F.when(F.col("_set") == 7, "all").when(F.col("_set") == 3, "code").when(F.col("_set") == 5, "vendor").otherwise("month")
    return out.withColumns({"level": level, "caught": (F.col("prevented") + F.col("at_risk") + F.col("accepted")).cast(money.MONEY)}).drop("_set")


def fold_ledger(issue_events: DataFrame) -> DataFrame:
    """The catch of each (org_id, scope, catch_key) after its issue events in order of ``seq``.

    ``issue_events``: org_id, scope, catch_key, seq, amount (null: the issue was deleted), reason. What was caught is the
    most ever at risk; when rates change (reason 'rates') it moves by the same difference instead and never below the
    latest amount. The fold runs inside each key's ordered array, which holds one issue's history.
    """
    step_type = "struct<caught:decimal(18,2),latest:decimal(18,2),cleared:string>"
    events = F.array_sort(F.collect_list(F.struct("seq", "amount", "reason")))

    def step(a: Column, e: Column) -> Column:
        amount = e["amount"]
        moved = F.greatest(amount, (a["caught"] + amount - a["latest"]).cast(money.MONEY))
        caught = F.when(a["caught"].isNull(), amount).when(e["reason"] == "rates", moved).otherwise(F.greatest(a["caught"], amount))
        seen = F.struct(caught.alias("caught"), amount.alias("latest"), F.lit(None).cast("string").alias("cleared")).cast(step_type)
        gone = F.struct(a["caught"].alias("caught"), a["latest"].alias("latest"), F.coalesce(e["reason"], F.lit("invoice")).alias("cleared")).cast(step_type)
        return F.when(amount.isNull(), gone).when(amount <= 0, a).otherwise(seen)

    start = F.struct(F.lit(None).alias("caught"), F.lit(None).alias("latest"), F.lit(None).alias("cleared")).cast(step_type)
    out = issue_events.groupBy("org_id", "scope", "catch_key").agg(F.aggregate(events, start, step).alias("c"))
    return out.select("org_id", "scope", "catch_key", "c.*").filter("caught is not null")


def recheck(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """Issue events of a change of rates: org_id, fingerprint, seq, amount (null: the issue went) and reason 'rates', for issues that differ.

    ``before`` and ``after``: issues of the vendors whose rates changed, as rules found them with the old and the new rates. The
    ledger folds these events so that money that a change of rates explains isn't counted as prevented.
    """
    old = before.select("org_id", "fingerprint", F.col("amount_at_risk").alias("_was"), F.lit(True).alias("_had"))
    new = after.select("org_id", "fingerprint", F.coalesce("amount_at_risk", F.lit(0).cast(money.MONEY)).alias("amount"), F.lit(True).alias("_has"))
    both = old.join(new, ["org_id", "fingerprint"], "full_outer")
    same = F.col("_had") & F.col("_has") & (F.coalesce("_was", F.lit(0).cast(money.MONEY)) == F.col("amount"))
    return both.filter(~F.coalesce(same, F.lit(False))).select("org_id", "fingerprint", at.alias("seq"), "amount", F.lit("rates").alias("reason"))


def period(key: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a named period."""
    first = F.trunc(today, "month")
    return {
        "this_month": (first, today),
        "last_month": (F.add_months(first, -1), F.date_sub(first, 1)),
        "last_90": (F.date_sub(today, 89), today),
        "this_year": (F.trunc(today, "year"), today),
        "last_12": (F.add_months(first, -11), today),
    }[key]
