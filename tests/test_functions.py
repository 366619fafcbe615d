"""Scalar functions: pinned values and edge cases."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quaywise.functions import charges, containers, dates, fuzzy, keys, money, places, text


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(values, column, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[0] for r in rows.orderBy("i").select(column).collect()]

    return run


def test_keys(evaluate):
    assert evaluate(["oslu 123456-7", None, "ü1"], keys.norm_ref("x")) == ["OSLU1234567", "", "1"]
    assert evaluate(["Harborlink Logistics, LLC", "HARBORLINK LOGISTICS LLC.", None], keys.vendor_key("x")) == ["harborlink logistics", "harborlink logistics", ""]
    assert evaluate(["Demurrage 6 days (USD 100.00)", "THC & handling 40HC x 2"], keys.alias_key("x")) == ["demurrage", "thc and handling"]


def test_money(evaluate):
    assert evaluate(["2.345", "2.355", "1,234.50", "abc", None], money.cents("x")) == [Decimal("2.34"), Decimal("2.36"), None, None, None]
    assert evaluate(["1,234.50", " 7 "], money.cents("x", commas=True)) == [Decimal("1234.50"), Decimal("7.00")]
    assert evaluate(["USD 1 234.50", "-12", "none", "1,234,567.891"], money.parse_money("x")) == [Decimal("1234.50"), Decimal("-12.00"), None, Decimal("1234567.89")]
    assert evaluate([["1.01", "1.02"], ["3"], []], money.exact_median(F.col("x").cast("array<decimal(18,2)>")), "array<string>") == [Decimal("1.02"), Decimal("3.00"), None]
    rate = F.when(F.col("x") == "EUR", F.lit("1.0837")).cast("decimal(18,8)")
    assert evaluate(["USD", "EUR", "GBP"], money.to_home(F.lit("100.00"), F.col("x"), F.lit("USD"), rate)) == [Decimal("100.00"), Decimal("108.37"), None]
    assert evaluate(["4800", "10"], money.tolerance(F.col("x").cast("decimal(18,2)"), 2, 5)) == [Decimal("96.00"), Decimal("5.00")]
    assert evaluate(["99999999999999", "-1.005"], money.clamp(F.col("x").cast("decimal(38,4)"))) == [Decimal("999999999999.99"), Decimal("-1.01")]


CODES = {
    "D&D charges": "demurrage", "Driver detention": "waiting_time", "OTHC": "thc_origin", "Chassis split": "chassis_split", "Re-delivery fee": "redelivery", "Customs exam": "exam",
    "Customs entry": "customs_clearance", "THC": "thc_destination", "Bunker (BAF)": "baf", "Delivery order": "trucking", "Telex release": "bl_fee", "Ocean freight 40HC": "ocean_freight", "Mystery": "other", "": "other",
}


def test_charge_codes(evaluate):
    assert evaluate(list(CODES), charges.classify("x")) == list(CODES.values())
    assert evaluate(["Mystery", "THC"], charges.classify("x", F.when(F.col("x") == "Mystery", "storage"))) == ["storage", "thc_destination"]
    assert evaluate(["trucking", "exam", "nope", None], charges.group_of("x")) == ["delivery", "destination", "other", "other"]
    assert evaluate(["BAF", "duty_extra", "vat", "x"], charges.category_of("x")) == ["freight", "duty", "duty", "other"]


def test_units_on_line(evaluate):
    lines = ["Storage 3 chargeable days", "Detention 6 days (4 free)", "Detention", "Chassis x 2"]
    got = evaluate(lines, charges.units_on_line("x", F.lit(None).cast("string"), "day"))
    assert [(r.units, r.free, r.chargeable) for r in got] == [(3.0, None, True), (6.0, 4, False), (None, None, False), (2.0, None, False)]
    assert evaluate(["Exam fee"], charges.units_on_line("x", F.lit(None).cast("string"), "each"))[0].units == 1.0
    assert evaluate(["Detention 6 days"], charges.units_on_line("x", F.lit("9"), "day"))[0].units == 9.0


def test_dates(evaluate):
    import datetime as d

    forms = ["2026-03-08", "8 Mar 2026", "March 8, 2026", "3/8/2026", "13/08/2026", "08.03.2026", "8-mar-26", "soon", None]
    march = d.date(2026, 3, 8)
    assert evaluate(forms, dates.parse_date("x")) == [march, march, march, march, d.date(2026, 8, 13), march, march, None, None]
    assert evaluate(["3/8/2026"], dates.parse_date("x", day_first=True)) == [d.date(2026, 8, 3)]


@pytest.mark.parametrize(("start", "days", "weekends", "want"), [
    ("2026-04-07", 4, False, "2026-04-13"), ("2026-04-07", 4, True, "2026-04-11"), ("2026-04-10", 1, False, "2026-04-13"), ("2026-04-11", 2, False, "2026-04-14"), ("2026-04-10", 0, False, "2026-04-10"),
])
def test_last_free_day(spark, start, days, weekends, want):
    got = spark.range(1).select(dates.last_free_day(F.lit(start).cast("date"), F.lit(days), F.lit(weekends))).first()[0]
    assert str(got) == want
    if start == "2026-04-10" and days == 1:
        holiday = F.array(F.lit("2026-04-13").cast("date"))
        assert str(spark.range(1).select(dates.last_free_day(F.lit(start).cast("date"), F.lit(1), F.lit(False), holiday)).first()[0]) == "2026-04-14"


def test_free_time_wording(evaluate):
    assert evaluate(["calendar days", "working days", "", None], dates.counts_weekends("x", F.lit(True))) == [True, False, True, True]


def test_containers(evaluate):
    assert evaluate(["CSQU3054383", "csqu 305438-3", "CSQU3054384", "OSLU1234564", "nonsense", None], containers.is_valid("x")) == [True, True, False, True, False, False]
    assert evaluate(["boxes CSQU3054383, csqu 305438 3 and OSLU 123456-4", None], containers.find_all("x")) == [["CSQU3054383", "OSLU1234564"], []]


def test_places_and_equipment(evaluate):
    names = ["Port of Long Beach, CA, USA", "Shenzhen (Yantian)", "nlrtm", "CN SHA", "Nowhere", "", None, "Jebel Ali"]
    assert evaluate(names, places.resolve("x")) == ["USLGB", "CNYTN", "NLRTM", "CNSHA", None, None, None, "AEJEA"]
    assert evaluate(["40HQ", "20' DV", "reefer 40", "cube", "45G1"], places.equipment("x")) == ["40HC", "20GP", "40RF", None, "40HC"]
    assert evaluate(["2 x 40HC and 1 x 20GP, 40 HQ"], places.dominant(places.equipment_in("x"))) == ["40HC"]
    assert evaluate(["40HC 20GP"], places.dominant(places.equipment_in("x"))) == [None]


def test_fuzzy_ratios():
    assert fuzzy.indel_ratio("ABCD", "ABXD") == 75.0 and fuzzy.indel_ratio("", "") == 100.0 and fuzzy.indel_ratio("a", "") == 0.0
    assert fuzzy.token_set_ratio("long beach", "port long beach") == 100.0


def test_similar_pairs_lose_no_match(spark):
    import random

    rng = random.Random(4)
    refs = {"".join(rng.choice("AB12") for _ in range(rng.randrange(7, 12))) for _ in range(150)}
    left, right = sorted(refs)[::2], sorted(refs)[1::2]
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(a, b, "a", "b", 85).collect()}
    assert got == {(x, y) for x in left for y in right if fuzzy.indel_ratio(x, y) >= 85} and got


def test_text(evaluate):
    docs = ["Commercial Invoice\nunit price qty buyer", "BILL OF LADING\nshipped on board\nport of loading\nconsignee", "Credit note for freight charges\ncredited against invoice", "hello", None]
    assert [r.label for r in evaluate(docs, text.classify("x"))] == ["commercial_invoice", "bill_of_lading", "credit_note", "other", "other"]
    assert evaluate(["STATEMENT OF ACCOUNT\nx", "Statement\nbalance forward 3", "Invoice statement\nbalance due", "Invoice", None], text.looks_like_statement("x")) == [True, True, False, False, False]
    cells = ["=1+1", "-12.5", "+cmd", "@x", "plain", "-1,234", None]
    assert evaluate(cells, text.guard_cell("x")) == ["'=1+1", "-12.5", "'+cmd", "'@x", "plain", "-1,234", None]
    assert evaluate(["'=1+1", "plain"], text.unguard_cell("x")) == ["=1+1", "plain"]
    rows = [[["a|b", "c"], [], ["d", ""]]]
    assert evaluate(rows, text.sheet_rows(text.sheet_text(F.col("x"))), "array<array<string>>") == [[["a|b", "c"], [], ["d", ""]]]
    pages = [["Invoice No: A1\npage 1 of 2", "continued\npage 2 of 2", "Invoice No: B7\nlines\nTotal 12.00", "Invoice No: B7"]]
    assert evaluate(pages, text.page_starts(F.col("x")), "array<string>") == [[0, 2]]


def test_similar_pairs_on_the_threshold_and_of_long_texts(spark):
    rng = random.Random(11)
    longs = ["mediterranean shipping services", "mediterranean shiping services", "mediterranean shipping service", "orient overseas container line limited hong kong", "orient overseas container line hong kong limited"]
    words = ["".join(rng.choice("ABCDEFGH") for _ in range(n)) for n in (9, 10, 10, 11, 20, 21, 25, 25, 40, 40) for _ in range(4)]
    swapped = [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in words for i in (0, len(w) // 2)]  # two of 20 characters lost: 90 exactly
    texts = sorted({*longs, *words, *swapped, "", "A"})
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    for threshold in (90, 92, 80):
        got = {(r.a, r.b): r.ratio for r in fuzzy.similar_pairs(rows, rows.withColumnRenamed("a", "b"), "a", "b", threshold).collect()}
        want = {(x, y): fuzzy.indel_ratio(x, y) for x in texts for y in texts if 1000 * 2 * fuzzy.lcs_length(x, y) >= 10 * threshold * (len(x) + len(y))}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(v == 90 for v in [fuzzy.indel_ratio(w, s) for w in words for s in swapped])


def test_similar_links_count_every_pair_without_making_it(spark):
    from collections import Counter

    rng = random.Random(7)
    alike = {"".join(rng.choice(letters) for _ in range(10)) for letters in ("AB", "ABC") for _ in range(120)} | {"ABABABABAB", "BABABABABA", "AAAAAAAAAA", "CCCCCCCCCC"}
    mixed = {"".join(rng.choice("AB1") for _ in range(rng.randrange(8, 13))) for _ in range(60)} | {""}
    for texts in (sorted(alike), sorted(mixed)):
        left, right = [x for x in texts if rng.random() < 0.6], [x for x in texts if rng.random() < 0.6]
        a, b = spark.createDataFrame([(x,) for x in [*left, *left[:5], None]], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
        got = {r.text: r for r in fuzzy.similar_links(a, b, "a", "b", 90).collect()}
        links = [(x, y) for x in left for y in right if fuzzy.indel_ratio(x, y) >= 90]
        of_left, of_right, root = Counter(x for x, _ in links), Counter(y for _, y in links), {x: x for x in texts}
        for _ in texts:
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        assert set(got) == {*left, *right} and len(links) > len({*left} & {*right})
        for x, r in got.items():
            assert (r.in_left, r.in_right) == (x in left, x in right)
            assert (r.n_right, r.n_left, r.class_id) == (of_left[x] if x in left else None, of_right[x] if x in right else None, root[x])
    assert all((len(set(fuzzy.shorter(x)) & set(fuzzy.shorter(y))) == 2) == (y in fuzzy.twins(x)) for x in sorted(alike)[:80] for y in alike if x != y)
