"""Numbers of any length and quotients near a half, against whole-number arithmetic."""

import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from quaywise.functions import money
from quaywise.operators import allocation
from quaywise.plans import close_queries
from quaywise.plans.registry import Tables


def test_numbers_longer_than_money_are_counted_and_never_an_error(spark):
    texts = ["12345678901234567 and 123456789012345678.125", "9" * 19 + " 7", "9" * 60, "1,234,567,890,123,456,789 1,234", "1 1.00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r.n for r in rows.select(money.numbers_in("t").alias("n")).collect()]
    assert got == [[Decimal("12345678901234567.00"), Decimal("123456789012345678.12")], [Decimal("7.00")], [], [Decimal("1234.00")], [Decimal("1.00")]]
    assert [r.n for r in rows.select(money.parse_money("t").alias("n")).collect()] == [None, None, None, None, Decimal("11.00")]


def test_quotients_just_below_a_half_stay_below(spark):
    pairs = [("15040.29", "31966.61", 100, 1), ("-15040.29", "31966.61", 100, 1), ("0.05", "1.00", 100, 1), ("-1.00", "8.00", 1, 2), ("123456789012.34", "0.03", 1, 4), ("1.00", "0.00", 1, 1)]
    for num, den, times, places in pairs:
        got = spark.createDataFrame([(Decimal(num), Decimal(den))], "n decimal(18,2), d decimal(18,2)").select(money.ratio(F.col("n") * times, "d", places).alias("r")).first().r
        exact = None if not Decimal(den) else Fraction(num) * times / Fraction(den)
        if exact is None:
            assert got is None
            continue
        whole = int(abs(exact) * 10**places + Fraction(1, 2))
        assert got == Decimal(whole if exact >= 0 else -whole).scaleb(-places)


def test_landed_cost_uplift_is_rounded_once(spark):
    from quaywise.operators import allocation

    goods = spark.createDataFrame([("s", "a", Decimal("31966.61"), Decimal("10"))], "s string, product string, value decimal(18,2), quantity decimal(18,2)").selectExpr("*", "cast(1 as decimal(18,3)) weight", "cast(1 as decimal(18,3)) volume")
    cost = spark.createDataFrame([("s", "c", "other", "value", Decimal("15040.29"))], "s string, charge string, category string, basis string, home decimal(18,2)")
    assert allocation.landed_cost(goods, cost, ["s"]).first().uplift == Decimal("47.0")


def test_references_are_never_broadcast(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["shipment_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_totals_of_twenty_million_edges(spark):
    from quaywise.operators import graph

    edges = spark.range(20_000_000).select((F.col("id") + 1).alias("u"), F.lit(0).alias("v"))
    n, hashes = graph.totals(edges)
    assert n == 20_000_000 and hashes > 1 << 63


def test_quotes_and_invoices_never_meet_one_by_one(spark, monkeypatch):
    import datetime as d

    from quaywise.operators import intervals, rates
    from test_index_joins import CONTEXT, QUOTES

    monkeypatch.setattr(intervals, "meet", None)  # pairs of days and periods grow with the square of a vendor's rows
    first = d.date(1, 1, 1)
    spans = [(first, d.date(9999, 12, 31)), (None, d.date(1850, 1, 1)), (d.date(2200, 1, 1), None), (d.date(2020, 1, 2), d.date(2020, 1, 1)), (d.date(2020, 1, 1), d.date(2021, 2, 3))]
    quotes = [(1, i, "v", a, b, None, None, None, None, None) for i, (a, b) in enumerate(spans)]
    days = [first, d.date(1850, 1, 1), d.date(2020, 1, 1), d.date(2021, 2, 3), d.date(2021, 2, 4), d.date(9999, 12, 31), None]
    invoices = [(1, i, "v", x, "A", "B", "C", None, None) for i, x in enumerate(days)]
    got = {r.doc_id: (r.quote_id, r.n_fit) for r in rates.choose_quote(spark.createDataFrame(invoices, CONTEXT), spark.createDataFrame(quotes, QUOTES)).collect()}
    for i, x in enumerate(days):
        fits = [(a is not None, a or d.date.min, q) for q, (a, b) in enumerate(spans) if x is None or ((a is None or a <= x) and (b is None or x <= b))]
        assert got[i] == (max(fits)[2], len(fits))


def test_charges_are_spread_as_by_hand_and_their_pairs_sorted_once(spark):
    rng = random.Random(11)
    some = lambda top, scale: None if rng.random() < 0.08 else Decimal(rng.randrange(top)).scaleb(-scale)
    products = [(g, p, some(9000, 2), some(500, 2), some(700, 3), some(3, 3)) for g in range(60) for p in range(rng.randrange(1, 6))]
    charges = [(g, c, "x", basis, some(3000, 2) if g % 7 else Decimal(-777).scaleb(-2)) for g in range(60) for c, basis in enumerate([*allocation.FALLBACKS, "unknown"])]
    p = spark.createDataFrame(products, "g int, product int, value decimal(18,2), quantity decimal(18,2), weight decimal(18,3), volume decimal(18,3)").repartition(3)
    c = spark.createDataFrame(charges, "g int, charge int, category string, basis string, home decimal(18,2)").repartition(3)
    out = allocation.spread_charges(p, c, ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.charge, r.product): (r.used, r.cents, r.part) for r in out.collect()}
    want = {}
    for g, charge, _, basis, home in charges:
        goods = [x for x in products if x[0] == g]
        weights = {"value": [int(max(x[2] or 0, 0) * 100) for x in goods], "equal": [1] * len(goods)}
        weights |= {k: [int(x[i] * 10000) for x in goods] for i, k in ((3, "quantity"), (4, "weight"), (5, "volume")) if all(x[i] is not None for x in goods)}
        used = next((b for b in allocation.FALLBACKS.get(basis, []) if sum(weights.get(b, [0]))), None)
        if home is None:
            continue
        w, cents = weights.get(used), int(home * 100)
        parts = [None] * len(goods)
        if w:
            base, rest = zip(*(divmod(abs(cents) * x, sum(w)) for x in w), strict=True)
            order = sorted(range(len(w)), key=lambda i: (-rest[i], -w[i], goods[i][1]))
            parts = [(b + (order.index(i) < abs(cents) - sum(base))) * (1 if cents > 0 else -1) for i, b in enumerate(base)] if cents else [0] * len(w)
        want |= {(g, charge, x[1]): (used, cents, part) for x, part in zip(goods, parts, strict=True)}
    assert got == want
    assert len([line for line in plan.splitlines() if "Sort [" in line and "charge#" in line]) == 1


def test_lines_are_dealt_to_tasks_by_how_many_there_are(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, close_queries.spread_charges(t).collect()))
    monkeypatch.setattr(close_queries, "_LINES_A_TASK", 200)
    tasks = -(-t.lines.count() // 200)
    assert close_queries._products(t).rdd.getNumPartitions() == tasks > spark.sparkContext.defaultParallelism
    dealt = close_queries.spread_charges(t)
    assert sorted(map(tuple, dealt.collect())) == want
