"""Operators: pinned values, invariants and edge cases."""

import datetime as d
import random
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quaywise.functions import fuzzy, money
from quaywise.operators import allocation, close, customs, grouping, rates, reports, rules, statements, workflow
from quaywise.sources import ratecards


def split(spark, total, weights):
    rows = spark.createDataFrame([(1, total, w, i) for i, w in enumerate(weights)], "g int, t long, w long, i int")
    return [r.part for r in money.split_exactly(rows, ["g"], "t", "w", ["i"]).orderBy("i").collect()]


@pytest.mark.parametrize(("total", "weights", "want"), [
    (10000, [1, 1, 1], [3334, 3333, 3333]), (100, [2, 1, 0], [67, 33, 0]), (-10000, [1, 1, 1], [-3334, -3333, -3333]), (5, [1] * 7, [1, 1, 1, 1, 1, 0, 0]), (5, [0, 0], [None, None]), (5, [-1, 2], [None, None]),
])
def test_largest_remainder(spark, total, weights, want):
    assert split(spark, total, weights) == want


def test_largest_remainder_against_exact_rationals(spark):
    rng = random.Random(2)
    groups = {g: (rng.randrange(-10**6, 10**6), [rng.randrange(0, 50) for _ in range(rng.randrange(1, 9))]) for g in range(150)}
    groups = {g: v for g, v in groups.items() if sum(v[1])}
    rows = spark.createDataFrame([(g, t, w, i) for g, (t, ws) in groups.items() for i, w in enumerate(ws)], "g int, t long, w long, i int")
    got = {}
    for r in money.split_exactly(rows, ["g"], "t", "w", ["i"]).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.part)
    for g, (t, ws) in groups.items():
        quotas = [Fraction(abs(t) * w, sum(ws)) for w in ws]
        parts = [int(q) for q in quotas]
        for i in sorted(range(len(ws)), key=lambda i: (parts[i] - quotas[i], -ws[i], i))[: abs(t) - sum(parts)]:
            parts[i] += 1
        assert got[g] == [p if t >= 0 else -p for p in parts]


def test_two_way_split_is_exact_both_ways(spark):
    cases = [([10000, 3333, 1], [5000, 8334]), ([999, 1, 1, 1], [1, 1000, 1]), ([-500, 2500], [1000, 1000]), ([5], [4])]
    lines = spark.createDataFrame([(g, i, c) for g, (cols, _) in enumerate(cases) for i, c in enumerate(cols)], "g int, line int, line_cents long")
    parties = spark.createDataFrame([(g, i, c) for g, (_, rows) in enumerate(cases) for i, c in enumerate(rows)], "g int, party int, party_cents long")
    out = allocation.split_table(lines, parties, "g").collect()
    for g, (cols, rows) in enumerate(cases[:3]):
        assert [sum(r.part for r in out if r.g == g and r.line == i) for i in range(len(cols))] == cols
        assert [sum(r.part for r in out if r.g == g and r.party == i) for i in range(len(rows))] == rows
    assert [r.part for r in out if r.g == 3] == [None]


def products(spark, rows):
    return spark.createDataFrame([(1, i, *map(D, r[:2]), *(None if x is None else D(x) for x in r[2:])) for i, r in enumerate(rows)], "s int, product int, value decimal(18,2), quantity decimal(18,2), weight decimal(18,3), volume decimal(18,3)")


@pytest.mark.parametrize(("basis", "want"), [("value", [100, 300]), ("quantity", [100, 300]), ("weight", [300, 100]), ("volume", [100, 300])])
def test_landed_cost_by_basis(spark, basis, want):
    goods = products(spark, [("1000", "10", "300", "1"), ("3000", "30", "100", "3")])
    cost = spark.createDataFrame([(1, "c", "freight", basis, D("400.00"))], "s int, charge string, category string, basis string, home decimal(18,2)")
    out = allocation.landed_cost(goods, cost, ["s"]).orderBy("product").collect()
    assert [r.allocated for r in out] == want


def test_landed_cost_rounding_fallback_and_missing_rates(spark):
    goods = products(spark, [("100.00", "3", None, None)] * 3)
    kinds = "s int, charge string, category string, basis string, home decimal(18,2)"
    cost = spark.createDataFrame([(1, "a", "freight", "weight", D("100.00")), (1, "b", "other", "value", D("0.01"))], kinds)
    out = allocation.landed_cost(goods, cost, ["s"]).orderBy("product").collect()
    assert [r.allocated for r in out] == [D("33.35"), D("33.33"), D("33.33")]
    assert (out[0].landed, out[0].per_unit, out[0].uplift) == (D("133.35"), D("44.4500"), D("33.4"))
    bad = cost.unionByName(spark.createDataFrame([(1, "c", "duty", "value", None)], kinds))
    assert {(r.complete, r.allocated) for r in allocation.landed_cost(goods, bad, ["s"]).collect()} == {(False, None)}


QUOTES = "org_id int, quote_id int, vendor_key string, valid_from date, valid_to date, origin string, destination string, equipment string, origin_area string, destination_area string"
CONTEXT = "org_id int, doc_id int, vendor_key string, ship_date date, origin string, destination string, equipment string, origin_area string, destination_area string"


def test_quote_choice(spark):
    old, new = d.date(2025, 1, 1), d.date(2026, 1, 1)
    quotes = spark.createDataFrame([(1, 1, "v", old, None, None, None, None, None, None), (1, 2, "v", old, None, "A2", "B", None, "A", "B"), (1, 3, "v", old, None, "A1", "B", None, "A", "B"), (1, 4, "v", new, None, "A1", "B", None, "A", "B")], QUOTES)
    day = d.date(2026, 3, 1)
    inv = [(1, 10, "v", day, "A1", "B", "40HC", "A", "B"), (1, 11, "v", day, None, "B", None, None, "B"), (1, 12, "w", day, "A1", "B", None, "A", "B"), (1, 13, "v", d.date(2024, 1, 1), "A1", "B", None, "A", "B"), (1, 14, "v", day, "A2", "B", None, "A", "B")]
    got = {r.doc_id: (r.outcome, r.quote_id) for r in rates.choose_quote(spark.createDataFrame(inv, CONTEXT), quotes).collect()}
    assert got == {10: ("matched", 4), 11: ("ambiguous", 4), 12: ("none_on_file", None), 13: ("no_match", None), 14: ("matched", 2)}


def catches(spark, rows):
    return spark.createDataFrame(rows, "org_id int, scope string, code string, caught decimal(18,2), latest decimal(18,2), shipment_status string, issue_open boolean, issue_resolved boolean, cleared_reason string")


def test_savings_outcomes(spark):
    rows = [
        (1, "d1", "over_quote", D(500), D(500), "needs_review", None, None, "invoice"), (1, "d2", "over_quote", D(300), D(300), "needs_review", True, False, None), (1, "d3", "over_quote", D(550), D(550), "posted", True, False, None),
        (1, "d4", "over_quote", D(150), D(50), "needs_review", None, None, "rates"), (1, "d5", "over_quote", D(90), D(90), "rejected", True, False, None), (1, "d6", "over_quote", D(90), D(0), "open", True, False, None),
    ]
    got = {r.scope: (r.outcome, r.prevented, r.at_risk, r.accepted, r.withdrawn) for r in rates.outcomes(catches(spark, rows)).collect()}
    assert got == {"d1": ("prevented", 500, 0, 0, 0), "d2": ("at_risk", 0, 300, 0, 0), "d3": ("accepted", 0, 0, 550, 0), "d4": ("withdrawn", 100, 0, 0, 50), "d5": ("prevented", 90, 0, 0, 0), "d6": ("prevented", 90, 0, 0, 0)}


def test_overlaps_count_once(spark):
    rows = [(1, "d1", c, D(a), D(a), "open", True, False, None) for c, a in (("over_quote", 200), ("amount_outlier", 260))]
    rows += [(1, "d2", c, D(a), D(a), "open", True, False, None) for c, a in (("over_quote", 200), ("duplicate_invoice", 5000))]
    got = rates.overlap_factor(rates.outcomes(catches(spark, rows))).withColumn("n", F.round(F.col("caught") * F.col("factor"), 2)).groupBy("scope").agg(F.sum("n").alias("n"))
    assert {r.scope: r.n for r in got.collect()} == {"d1": 260, "d2": 5000}


EVENTS = [(1, "100.00", None), (2, "150.00", None), (3, "50.00", "rates"), (4, None, None)]


def test_ledger_fold_batch_equals_stream(spark, tmp_path):
    from quaywise.streaming import events

    rows = [(1, "d1", "k", s, None if a is None else D(a), r) for s, a, r in EVENTS] + [(1, "d2", "k", 1, D("-1.00"), None), (1, "d3", "k", 1, D("7.00"), None)]
    schema = "org_id long, scope string, catch_key string, seq long, amount decimal(18,2), reason string"
    got = {r.scope: (r.caught, r.latest, r.cleared) for r in rates.fold_ledger(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"d1": (D("50.00"), D("50.00"), "invoice"), "d3": (D("7.00"), D("7.00"), None)}
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.scope: (r.caught, r.latest, r.cleared) for r in spark.table("ledger").collect()}
    assert last == got


def test_event_streams(spark, tmp_path):
    from quaywise.streaming import events

    at = d.datetime(2026, 1, 1, 8, 0)
    rows = [(1, at, 5, "purchase", D("1.00"), 9), (1, at, 5, "purchase", D("1.00"), 9), (2, at, 5, "view", D("2.00"), 9), (3, at, 6, "error", D("3.00"), 8)]
    schema = "event_id long, seen_at timestamp, actor_id long, action string, amount decimal(18,2), object_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.type for r in run(events.published(events.distinct_within(source, ["event_id"])), "published")) == ["document.failed", "shipment.posted"]
    assert {(r.actor_id, r.n) for r in run(events.minute_counts(source, "actor_id"), "counts", "complete")} == {(5, 3), (6, 1)}
    assert {(r.actor_id, r.alerted) for r in run(events.alert_once(source.select("actor_id", "action"), ["actor_id"], "action"), "alerts")} >= {(6, "error")}


def test_mpf_and_hmf(spark):
    cases = [("2026-04-02", "500000", "651.50"), ("2026-10-01", "500000", "670.86"), ("2026-04-02", "20000", "69.28"), ("2026-04-02", "2000", "33.58"), ("1999-01-01", "10", "25.00")]
    rows = spark.createDataFrame([(i, d.date.fromisoformat(a), D(v)) for i, (a, v, _) in enumerate(cases)], "doc_id int, entry_date date, value decimal(18,2)")
    assert [str(r.mpf) for r in customs.user_fees(rows).orderBy("doc_id").collect()] == [c[2] for c in cases]


def test_line_duty_and_rates(spark):
    rows = [(1, 1, "8471.30", D("1000.00"), "4.9%", D("50.50")), (1, 2, "9903.88", None, "7.5%", D("75.00")), (1, 3, "9903.89", None, "2.4c/kg", D("1.00")), (2, 1, "9903.88", None, "Free", D("2.00")), (2, 2, "0101", D("10.00"), "Free", D("1.01"))]
    out = customs.line_duty(spark.createDataFrame(rows, "doc_id int, position int, hts string, value decimal(18,2), rate string, stated decimal(18,2)")).orderBy("doc_id", "position").collect()
    assert [(r.expected, r.mismatch) for r in out] == [(D("49.00"), True), (D("75.00"), False), (None, False), (None, False), (D("0.00"), True)]


def statement(spark, lines, items):
    a = spark.createDataFrame([(1, i, k, n, r, day, D(x)) for i, (k, n, r, day, x) in enumerate(lines)], "statement_id int, position long, kind string, number string, reference string, day date, amount decimal(18,2)")
    b = spark.createDataFrame([(1, i, k, n, bl, day, D(x), D(x) if k == "invoice" else -D(x)) for i, (k, n, bl, day, x) in enumerate(items)], "statement_id int, item_id long, kind string, number string, bl string, day date, amount decimal(18,2), owed decimal(18,2)")
    return statements.reconcile(a, b).collect()


def test_reconciliation(spark):
    day = d.date(2026, 5, 1)
    lines = [
        ("invoice", "HA-101", "", day, "525.00"), ("invoice", "HA-990417", "", day, "485.00"), ("invoice", "INV/12345", "", day, "80.00"), ("invoice", "X", "BL OSLN77", day, "60.00"), ("invoice", "HA-101", "", day, "525.00"),
        ("payment", "", "", d.date(2026, 5, 8), "-300.00"), ("opening", "", "", day, "0.00"),
    ]
    items = [("invoice", "HA 101", "", day, "500.00"), ("invoice", "12345", "", day, "80.00"), ("invoice", "Q1", "OSLN77", day, "60.00"), ("payment", "", "", day, "300.00"), ("credit", "CN-1", "", day, "120.00")]
    out = statement(spark, lines, items)
    assert {(r.bucket, r.position, r.item_id, r.how) for r in out} == {
        ("amount_differs", 0, 0, "number"), ("missing", 1, None, ""), ("matched", 2, 1, "digits"), ("matched", 3, 2, "bl"), ("duplicate", 4, None, ""), ("matched", 5, 3, "amount"), ("credit_not_applied", None, 4, ""),
    }
    difference = sum(D(x[4]) for x in lines) - (D("640.00") - 300 - 120)
    assert sum(r.effect for r in out) == difference


def test_statement_amounts(spark):
    shown = ["(1,234.50)", "1,234.50 CR", "-12", "99.10", "2026-01-02", "none", None, "USD 5.00"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(shown)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(statements.amount_of("x")).collect()]
    assert got == [D("-1234.50"), D("-1234.50"), D("-12.00"), D("99.10"), None, None, None, D("5.00")]


def test_journal_balances(spark):
    rows = spark.createDataFrame([(1, "a", "v", D("10.00")), (1, "a", "v", D("-3.00")), (1, "b", "w", D("0.00")), (1, "b", "x", None), (2, "a", "v", D("5.00"))], "org_id int, account string, vendor_key string, amount_home decimal(18,2)")
    out = close.journal(rows).collect()
    for org in (1, 2):
        for entry in ("accrual", "reversal"):
            assert sum(r.amount for r in out if r.org_id == org and r.entry == entry) == 0
    assert {(r.account, r.vendor_key) for r in out if r.org_id == 1} == {("a", "v"), ("Accrued liabilities", "")}


def test_late_invoice_belongs_to_the_period_of_its_shipment(spark):
    docs = spark.createDataFrame([(1, 1, 1, "freight_invoice", "v", D(10), D(10), d.date(2026, 7, 9), None, False), (1, 2, 2, "freight_invoice", "v", D(10), D(10), d.date(2026, 7, 9), None, False), (1, 1, 3, "credit_note", "v", D(4), D(4), d.date(2026, 6, 9), None, False), (1, 1, 4, "freight_invoice", "v", D(4), D(4), d.date(2026, 6, 9), d.date(2026, 6, 20), False)],
                                 "org_id int, shipment_id int, doc_id int, doc_type string, vendor_key string, total decimal(18,2), home decimal(18,2), bill_date date, booked_on date, duplicate boolean")
    ships = spark.createDataFrame([(1, 1, d.date(2026, 6, 15), False), (1, 2, d.date(2026, 7, 2), False)], "org_id int, shipment_id int, ship_date date, rejected boolean")
    got = {r.doc_id: r.amount_home for r in close.received_not_booked(docs, ships, "2026-06-30").collect()}
    assert got == {1: 10, 3: -4}


def test_checksum_ignores_order(spark):
    rows = [(1, "a", 2), (1, None, 3), (2, "b", 1)]
    a = close.checksum(spark.createDataFrame(rows, "g int, x string, y int"), ["g"]).orderBy("g").collect()
    b = close.checksum(spark.createDataFrame([(r[2], r[1], r[0]) for r in reversed(rows)], "y int, x string, g int").repartition(3), ["g"]).orderBy("g").collect()
    assert [r.checksum for r in a] == [r.checksum for r in b] and a[0].n == 2


DOCS = "org_id int, doc_id long, received_on date, is_bl boolean, bl string, boxes array<string>, pos array<string>"


def test_grouping_fold(spark):
    day = [d.date(2026, 1, i) for i in range(1, 9)]
    rows = [
        (1, 1, day[0], False, "", [], ["PO1"]), (1, 2, day[1], True, "B1", ["CSQU3054383"], []), (1, 3, day[2], False, "B1", [], ["PO1"]), (1, 4, day[3], False, "", ["CSQU3054383"], []), (1, 5, day[4], False, "", [], []), (1, 6, day[5], False, "B2", [], []), (2, 7, day[6], False, "B1", [], []),
    ]
    got = {r.doc_id: (r.shipment, r.method) for r in grouping.group_by_arrival(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (2, "new"), 2: (2, "new"), 3: (2, "exact_bl"), 4: (2, "exact_container"), 5: (None, "unmatched"), 6: (6, "new"), 7: (7, "new")}


def brute_places(rows, near_bl, near_box):
    """The fold over a whole organisation, every shipment scanned for every document."""
    ships, placed, clock = {}, {}, 0

    def refs(docs):
        bills = [x for x in docs if x[3]]
        bl = next((x[4] for x in [*bills, *docs] if x[4]), "")
        boxes = {c for x in bills for c in x[5]} if bills else {c for x in docs for c in x[5] if valid_box(c)}
        return bl, boxes, {p for x in docs for p in x[6]}

    for d in sorted(rows, key=lambda r: (r[2], r[1])):
        found = {}
        for s, (docs, _) in ships.items():
            bl, boxes, pos = refs(docs)
            if d[4] and d[4] == bl:
                found[s] = "exact_bl"
            elif boxes & set(d[5]):
                found[s] = "exact_container"
            elif pos & set(d[6]):
                found[s] = "exact_po"
            elif (d[4] and bl and near_bl(d[4], bl)) or any(near_box(a, b) for a in d[5] if not valid_box(a) for b in boxes):
                found[s] = "fuzzy"
        ranked = sorted(found, key=lambda s: (-grouping.SCORES[found[s]], -ships[s][1]))
        clock += 1
        if ranked:
            s, how = ranked[0], found[ranked[0]]
        elif d[7] in placed and placed[d[7]][0] in ships:
            s, how = placed[d[7]][0], "original_invoice"
        elif len(d) > 8 and d[8] in placed and placed[d[8]][0] in ships:
            s, how = placed[d[8]][0], "customs_entry"
        elif d[4] or d[5] or d[6]:
            s, how = d[1], "new"
            ships[s] = ([], 0)
        else:
            placed[d[1]] = (None, "unmatched")
            continue
        placed[d[1]] = (s, how)
        if how in ("exact_bl", "exact_container"):
            for o in ranked[1:]:
                if found[o] == "exact_po" and not refs(ships[o][0])[0]:
                    for x in ships.pop(o)[0]:
                        placed[x[1]] = (s, placed[x[1]][1])
                        ships[s] = ([*ships[s][0], x], clock)
        ships[s] = ([*ships[s][0], d], clock)
    return placed


def valid_box(c):
    letters = [v for v in range(10, 39) if v % 11]
    n = sum((int(x) if x.isdigit() else letters[ord(x) - 65]) << i for i, x in enumerate(c[:10]))
    return len(c) == 11 and c[3] in "UJZ" and n % 11 % 10 == int(c[10])


def test_grouping_equals_the_fold_over_the_whole_organisation(spark):
    rng = random.Random(4)
    boxes = ["CSQU3054383", "CSQU3054384", "MSKU9070323", "MSKU9070328", "OSLU1234567"]
    bills = ["OSLN1234567", "OSLN1234568", "OSLN9999999", "HLCU5551234"]
    rows = []
    for i in range(1, 90):
        bl, box, po = (rng.choice(v) if rng.random() < p else None for v, p in ((bills, 0.25), (boxes, 0.25), ([f"PO{k}" for k in range(12)], 0.3)))
        original = rng.randrange(1, i) if i > 1 and rng.random() < 0.6 else None
        rows.append((1, i, d.date(2026, 1, 1 + rng.randrange(25)), rng.random() < 0.3, bl or "", [box] if box else [], [po] if po else [], original))
    got = {r.doc_id: (r.shipment, r.method) for r in grouping.group_by_arrival(spark.createDataFrame(rows, DOCS + ", original long")).collect()}
    want = brute_places(rows, lambda a, b: fuzzy.indel_ratio(a, b) >= 90, lambda a, b: a[:4] == b[:4] and fuzzy.indel_ratio(a, b) >= 90)
    assert got == want and {m for _, m in got.values()} >= {"fuzzy", "original_invoice", "exact_bl", "exact_container", "exact_po", "new"}


def test_duplicates_of_a_large_group(spark):
    rows = [(1, 1, i, "freight_invoice", "Acme LLC", "N-1", "USD", D("5.00"), d.date(2026, 1, 1 + i * 7 % 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "org_id int, shipment_id int, doc_id long, doc_type string, vendor_name string, number string, currency string, total decimal(18,2), received_on date")
    got = {r.doc_id: int(r.key) for r in rules.duplicates(docs).collect()}
    want = {r[2]: min(o[2] for o in rows if o[8] <= r[8]) for r in rows}
    assert got == {k: v for k, v in want.items() if v < k}


def test_a_rate_card_with_an_error_is_not_taken(spark):
    blank = dict.fromkeys(ratecards.COLUMNS, "")
    good = blank | {"vendor": "A", "valid_from": "2026-01-01", "currency": "USD", "charge_code": "Ocean freight", "amount": "10", "basis": "per box"}
    schema = ", ".join(f"{c} string" for c in ratecards.COLUMNS)
    assert ratecards.accepted(spark.createDataFrame([tuple(good.values())], schema)).count() == 1
    assert ratecards.accepted(spark.createDataFrame([tuple(good.values()), tuple((good | {"amount": "x"}).values())], schema)).count() == 0


def test_pair_quality_equals_counting_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.randrange(6)) for _ in range(40)]
    got = reports.pair_quality(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i]]
    assert (got.true_pairs, got.found_pairs, got.shared_pairs) == (sum(x[0] == y[0] for x, y in pairs), sum(x[1] == y[1] for x, y in pairs), sum(x == y for x, y in pairs))


def test_groups_are_found_once_for_all_three_counts_of_pairs(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    groups = spark.range(0, 300, 1, 2).selectExpr("cast(id % 30 as int) a", "cast(id % 20 as int) b").mapInArrow(watched, "a int, b int")
    got = reports.pair_quality(groups, "a", "b").first()
    assert (got.true_pairs, got.found_pairs, got.shared_pairs) == (30 * 45, 20 * 105, 60 * 10) and seen.value == 300


def test_rules_skip_what_people_resolved_and_take_empty_tables(spark):
    kinds = "org_id int, shipment_id int, doc_id long, doc_type string, vendor_name string, number string, currency string, total decimal(18,2), invoice_date date, received_on date, boxes int, container string"
    day = d.date(2026, 1, 1)
    docs = spark.createDataFrame([(1, 1, i, "freight_invoice", v, n, "USD", D("100.00"), day, day, 1, None) for i, v, n in ((1, "A Ltd", "X-1"), (2, "A", "x1"), (3, None, None))], kinds)
    lines = spark.createDataFrame([(1, D("99.98")), (2, D("99.97"))], "doc_id long, amount decimal(18,2)")
    tables = {"documents": docs, "lines": lines}
    found = rules.validate(tables)
    assert {(r.code, r.doc_id, r.key) for r in found.collect()} == {("duplicate_invoice", 2, "1"), ("total_mismatch", 2, ""), ("missing_bl", None, ""), ("missing_commercial_invoice", None, "")}
    resolved = found.filter("code = 'duplicate_invoice'").select("org_id", "fingerprint")
    assert rules.validate(tables, resolved).filter("code = 'duplicate_invoice'").count() == 0
    assert rules.validate({"documents": docs.limit(0), "lines": lines.limit(0)}).count() == 0
    assert [r.status for r in rules.status_of(found, docs).collect()] == ["needs_review"]


def test_ageing_buckets(spark):
    today = d.date(2026, 6, 30)
    rows = [(1, D(10), D(10), None), (1, D(20), D(20), today - d.timedelta(30)), (1, D(5), None, today - d.timedelta(95)), (1, D(40), D(40), today - d.timedelta(91)), (1, D(-5), D(-5), None)]
    out = {r.bucket: (r.n, r.amount, r.unconverted, r.share) for r in reports.ageing(spark.createDataFrame(rows, "org_id int, amount decimal(18,2), home decimal(18,2), due_on date"), "2026-06-30").collect()}
    assert out == {"current": (1, 10, 0, 25), "1-30": (1, 20, 0, 50), "31-60": (0, 0, 0, 0), "61-90": (0, 0, 0, 0), "90+": (1, 40, 1, 100)}


def test_round_robin_wraps(spark):
    pool = spark.createDataFrame([(1, m) for m in (3, 5, 9)], "org_id int, member int")
    waiting = spark.createDataFrame([(1, i) for i in range(5)], "org_id int, doc_id int")
    got = {r.doc_id: r.member for r in workflow.round_robin(waiting, pool, ["org_id"], [F.col("doc_id")], last=5).collect()}
    assert got == {0: 9, 1: 3, 2: 5, 3: 9, 4: 3}


def test_rate_card_round_trip(spark, tmp_path):
    from quaywise.sources import ratecards

    rows = [("Harbor, LLC", "=Q1", "Ningbo", "Long Beach, CA", "40HQ", "2026-01-01", "", "usd", "no", "Ocean freight", "", "2,400.00", "per box", 'say "hi"'), ("B", "Q2", "", "", "", "soon", "", "USD", "", "nonsense zz", "", "x", "day", "")]
    card = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ratecards.COLUMNS))
    ratecards.write(card.coalesce(1), str(tmp_path / "card"))
    good, errors = ratecards.check(ratecards.read(spark, str(tmp_path / "card")))
    r = good.first()
    assert good.count() == 1 and (r.vendor, r.quote_reference, r.origin_key, r.destination_key, r.equipment, r.amount, r.basis, r.code, r.notes) == ("Harbor, LLC", "=Q1", "CNNGB", "USLGB", "40HC", D("2400.00"), "container", "ocean_freight", 'say "hi"')
    assert {(e.column, e.problem) for e in errors.collect()} == {("valid_from", "is not a date"), ("amount", "is not an amount"), ("charge_code", "is not a known charge")}


def test_files(spark, tmp_path):
    from quaywise.sources import files

    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("b.bin", b"%PDF-1.7 x"), ("c.xlsx", b"PK\x03\x04"), ("d.csv", b"a,b"), ("e.png", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / name).write_bytes(body)
    rows = files.read_folder(spark, str(tmp_path)).withColumn("org_id", F.lit(1))
    assert {r.name: r.type for r in rows.collect()} == {"a.pdf": "pdf", "b.bin": "pdf", "c.xlsx": "xlsx", "d.csv": "csv", "e.png": "png"}
    assert files.first_by_content(rows, ["org_id"]).count() == 4


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_classified_once_and_not_a_line(spark):
    from quaywise.functions import charges

    lines = spark.createDataFrame([(1, "Demurrage 6 days"), (2, None), (3, "Demurrage 6 days"), (4, "Ocean freight")], "doc_id int, description string")
    coded = charges.with_codes(lines)
    assert {r.doc_id: r.code for r in coded.collect()} == {1: "demurrage", 2: "other", 3: "demurrage", 4: "ocean_freight"}
    assert "RLIKE" not in _optimized(coded.filter(charges.is_accessorial("code"))).upper()


def test_prints_and_rules_are_read_once_and_not_a_line(spark):
    rule = "struct(1 AS r_rule_id, 'day' AS r_unit, 2 AS r_free_units, CAST(10 AS DECIMAL(18,2)) AS r_max_per_unit, CAST(NULL AS DECIMAL(18,2)) AS r_max_amount)"
    lines = spark.sql(f"SELECT doc_id, 'storage' AS code, d AS description, q AS quantity, CAST(100 AS DECIMAL(18,2)) AS amount, {rule} AS rule FROM VALUES (1, 'Storage 5 days', NULL), (1, 'Storage', '3'), (2, NULL, NULL), (3, 'Storage 5 days', NULL) AS v(doc_id, d, q)")
    out = rates.allowed_by_approval(lines)
    assert {r.doc_id: (r.verdict, r.allowed) for r in out.collect()} == {1: ("capped", D(40)), 2: ("capped", D(0)), 3: ("capped", D(30))}
    assert "REGEXP_EXTRACT" not in _optimized(out).upper()


def test_charge_parts_are_classified_once_and_not_an_invoice(spark):
    from quaywise.plans import close_queries
    from quaywise.plans.registry import Tables

    for made in (close_queries._parts, close_queries._charges):
        assert "ADMIN(ISTRATION" not in _optimized(made(Tables(spark, "/root/testdata/sf0.001"))).upper()


def test_words_are_found_once_a_text(spark):
    from quaywise.operators import shared

    rows = spark.createDataFrame([("Freight for OSLN-0000012 and osln 0000013.",), ("- truck\tBOX a123 / box. b",), ("",), (None,)], "t string")
    out = rows.select(shared.words_of("t").alias("w"))
    assert [r.w for r in out.collect()] == [["FREIGHT", "OSLN0000012", "0000013", "FREIGHTFOR", "FOROSLN0000012", "OSLN0000012AND", "ANDOSLN", "OSLN0000013"], ["TRUCKBOX", "BOXA123", "A123BOX"], [], []]
    assert _optimized(out).lower().count("regexp_replace") == 1


def test_shares_of_a_split_are_worked_out_once(spark):
    from quaywise.operators import shared

    lines = spark.createDataFrame([(1, 1, 100, None), (1, 2, 7, 2), (1, 3, -1, None), (2, 1, 5, 1)], "doc_id int, line long, cents long, owner int")
    parties = spark.createDataFrame([(d, p, p + 1) for d in (1, 2) for p in (1, 2)], "doc_id int, party int, w long")
    out = shared.split_shared(lines, parties)
    sums = {(r.doc_id, r.party): r.s for r in out.groupBy("doc_id", "party").agg(F.sum("part").alias("s")).collect()}
    assert sums == {(1, 1): 40, (1, 2): 66, (2, 1): 5}
    assert "Window" not in _optimized(out)


def test_line_views_read_the_lines_once_and_show_what_each_view_shows(spark):
    from quaywise.operators import close

    rows = [("received", 1.0, None), ("received", None, None), ("estimate", 2.0, 0.2), ("estimate", 3.0, 0.9), ("estimate", None, 0.9), (None, 4.0, None)]
    lines = spark.createDataFrame(rows, "kind string, amount_home double, confidence double")
    found = close.line_views(lines)
    for view in close.LINE_VIEWS:
        want = close.line_view(lines, view).collect()
        got = found.filter(F.col("view") == view).drop("view").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
