"""Joins by index: periods of validity, similar names, greedy matching and merges, each against brute force."""

import datetime as d
import random
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from quaywise.functions import fuzzy
from quaywise.operators import grouping, intervals, rates, records, search
from quaywise.sources import adapter
from quaywise.sources.scratch import shared_dir
from test_operators import DOCS, brute_places, valid_box

QUOTES = "org_id int, quote_id int, vendor_key string, valid_from date, valid_to date, origin string, destination string, equipment string, origin_area string, destination_area string"
CONTEXT = "org_id int, doc_id int, vendor_key string, ship_date date, origin string, destination string, equipment string, origin_area string, destination_area string"


def test_days_meet_the_periods_that_hold_them(spark):
    rng = random.Random(6)
    day = lambda: None if rng.random() < 0.1 else d.date(1890, 1, 1) + d.timedelta(rng.choice([rng.randrange(80_000), 40_000 + rng.randrange(300)]))
    spans = [(i, "ab"[i % 2], *((x, y) if x is None or y is None or x <= y else (y, x))) for i in range(150) for x, y in [(day(), day())]]
    spans += [(900, "a", d.date(2020, 1, 2), d.date(2020, 1, 1)), (901, "a", d.date(2020, 1, 1), d.date(2020, 1, 1)), (902, None, None, None)]
    days = [(i, "ab"[i % 2], day()) for i in range(150)] + [(700, "a", d.date(2020, 1, 1)), (701, None, d.date(2020, 1, 1))]
    periods = spark.createDataFrame(spans, "period int, k string, valid_from date, valid_to date")
    rows = spark.createDataFrame(days, "row int, k string, day date")
    want = {(i, p) for i, k, x in days for p, q, a, b in spans if k is not None and k == q and (x is None or ((a is None or a <= x) and (b is None or x <= b)))}
    got = [(r.row, r.period) for r in intervals.meet(rows, periods, ["k"], "day").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = periods.select(F.size(intervals.cover(F.col("valid_from"), F.col("valid_to"))).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 6 * intervals.LEVELS
    assert intervals.meet(rows.limit(0), periods, ["k"], "day").count() == 0


def test_quotes_equal_brute_force(spark):
    rng = random.Random(9)
    area = {"A1": "A", "A2": "A", "B": "B", "C": "C"}
    pick = lambda *x: rng.choice(x)
    day = lambda: pick(None, d.date(2020, 1, 1) + d.timedelta(rng.randrange(400)))
    quotes = [(1, i, pick("v", "w"), day(), day(), pick(None, *area), pick(None, *area), pick(None, "20GP", "40HC")) for i in range(120)]
    inv = [(1, 1000 + i, pick("v", "w", "x"), day(), pick(None, *area), pick(None, *area), pick(None, "20GP", "40HC")) for i in range(150)]
    got = {r.doc_id: (r.outcome, r.quote_id, r.n_fit) for r in rates.choose_quote(spark.createDataFrame([(*r, area.get(r[4]), area.get(r[5])) for r in inv], CONTEXT), spark.createDataFrame([(*q, area.get(q[5]), area.get(q[6])) for q in quotes], QUOTES)).collect()}

    def place(want, have):
        return 5 if want is None else 6 if have is None else 10 if want == have else 8 if area[want] == area[have] else None

    for _, doc, vendor, on, *dims in inv:
        fits = []
        for _, quote, v, a, b, *q in quotes:
            s = [place(q[0], dims[0]), place(q[1], dims[1]), 5 if q[2] is None else 6 if dims[2] is None else 10 if q[2] == dims[2] else None]
            if v == vendor and None not in s and (on is None or ((a is None or a <= on) and (b is None or on <= b))):
                fits.append((sum(s), a or d.date.min, quote, q))
        best = max(fits, default=None)
        unsaid = best and any(x is None and y is not None and len({f[3][i] for f in fits}) > 1 for i, (x, y) in enumerate(zip(dims, best[3], strict=True)))
        outcome = "none_on_file" if vendor == "x" else "no_match" if not fits else "ambiguous" if unsaid else "matched"
        assert got[doc] == (outcome, best and best[2], len(fits))


def test_arrivals_in_batches_equal_one_fold(spark):
    rng = random.Random(12)
    boxes = ["CSQU3054383", "CSQU3054384", "MSKU9070323", "MSKU9070328", "OSLU1234567"]
    bills = ["OSLN1234567", "OSLN1234568", "OSLN9999999", "HLCU5551234", "AAAA0000000", "BBBB1111111"]
    rows = []
    for i in range(1, 80):
        bl, box, po = (rng.choice(v) if rng.random() < p else None for v, p in ((bills, 0.2), (boxes, 0.15), ([f"PO{k}" for k in range(40)], 0.3)))
        original = rng.randrange(1, i) if i > 1 and rng.random() < 0.3 else None
        beside = rng.randrange(1, i) if i > 1 and rng.random() < 0.4 else None
        rows.append((1, i, d.date(2026, 1, 1 + rng.randrange(25)), rng.random() < 0.3, bl or "", [box] if box else [], [po] if po else [], original, beside))
    docs = spark.createDataFrame(rows, DOCS + ", original long, tag long").cache()
    ask = lambda new, known: new.filter("tag is not null").join(known.select(F.col("doc_id").alias("beside")), F.col("tag") == F.col("beside")).select("org_id", "doc_id", "beside", F.lit("customs_entry").alias("beside_method"))
    whole = {r.doc_id: (r.shipment, r.method, r.score) for r in grouping.group_by_arrival(docs, [ask]).collect()}
    want = brute_places(rows, lambda a, b: fuzzy.indel_ratio(a, b) >= 90, lambda a, b: a[:4] == b[:4] and fuzzy.indel_ratio(a, b) >= 90)
    assert {k: v[:2] for k, v in whole.items()} == want and "customs_entry" in {m for _, m in want.values()}
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    state = None
    for part in (order[40:60], order[:40], order[60:]):  # the second comes late
        state = grouping.add_arrivals(state, docs.join(spark.createDataFrame([(r[1],) for r in part], "doc_id long"), "doc_id", "left_semi"), [ask])
    assert {r.doc_id: (r.shipment, r.method, r.score) for r in state.collect()} == whole
    again = grouping.add_arrivals(state, docs, [ask])
    assert sorted(map(str, again.select("doc_id", "shipment", "method", "component").collect())) == sorted(map(str, state.select("doc_id", "shipment", "method", "component").collect()))


def test_late_arrivals_fold_again_only_what_they_meet(spark):
    day = [d.date(2026, 1, i) for i in range(1, 9)]
    first = spark.createDataFrame([(1, 2, day[3], False, "", [], ["PO1"]), (1, 3, day[4], False, "B2", [], []), (1, 4, day[5], False, "", [], [])], DOCS)
    late = spark.createDataFrame([(1, 1, day[1], True, "B1", ["CSQU3054383"], ["PO1"])], DOCS)
    state = grouping.add_arrivals(None, first)
    after = {r.doc_id: (r.shipment, r.method) for r in grouping.add_arrivals(state, late).collect()}
    assert after == {1: (1, "new"), 2: (1, "exact_po"), 3: (3, "new"), 4: (None, "unmatched")}
    assert grouping.add_arrivals(state, first.limit(0)).count() == 3


def near_names(rng):
    words = ["harbor", "harbour", "logistics", "logistic", "port", "metro", "drayage", "atlantic", "cargo", "cargos", "line", "of", "a", "transpacific", "intermodal"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)}
    for n in [*names][:40]:
        i = rng.randrange(len(n))
        names.add((n[:i] + rng.choice("xyz") * rng.randrange(2) + n[i + 1 :]).strip())
    return sorted(x for x in (" ".join(n.split()) for n in names) if x)


def test_best_known_vendors_equal_brute_force(spark):
    rng = random.Random(3)
    names, known = near_names(rng), near_names(rng)
    got = {r.printed: (r.vendor_key, round(r.score, 9)) for r in records.best_known(spark.createDataFrame([(1, n) for n in names], "org_id int, printed string"), spark.createDataFrame([(1, k) for k in known], "org_id int, vendor_key string")).collect()}
    want = {}
    for n in names:
        scores = [(-(100.0 if n == k else max(fuzzy.indel_ratio(n, k), fuzzy.token_set_ratio(n, k) - 4)), k) for k in known]
        if -min(scores)[0] >= 90:
            want[n] = (min(scores)[1], round(-min(scores)[0], 9))
    assert got == want and len({s for _, s in want.values()}) > 3


def test_letterheads_equal_brute_force(spark):
    rng = random.Random(5)
    names = near_names(rng)
    lines = [*(f"{n[:i]}q{n[i + rng.randrange(3):]} {rng.choice(['', 'long beach', 'inc pier'])}".strip() for n in names for i in [rng.randrange(len(n))]), *near_names(rng)[:10], *(n[1:] for n in names[:10]), "", "of"]
    names = [n for i, n in enumerate(names) if i % 3]
    texts = [(1, i, "\r\n".join(rng.sample(lines, 1 + i % 2))) for i in range(150)] + [(1, 900, None), (2, 901, names[0])]
    found = records.letterhead_vendor(spark.createDataFrame(texts, "org_id int, doc_id int, text string"), spark.createDataFrame([(1, n) for n in names], "org_id int, vendor_key string"))
    got = {r.doc_id: (r.vendor_key, round(r.score, 9)) for r in found.collect()}
    want = {}
    for org, i, text in texts:
        heads = [h for h in (text or "").split("\r\n") if len(h) >= 3]
        scores = [(-(fuzzy.indel_ratio(n, h) if len(h) < len(n) - 2 else fuzzy.partial_ratio(n, h)), n) for n in names if len(n) >= 4 for h in heads if org == 1]
        if scores and -min(scores)[0] >= 90:
            want[i] = (min(scores)[1], round(-min(scores)[0], 9))
    assert got == want and len({s for _, s in want.values()}) > 5


def test_long_texts_meet_by_rare_pieces(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcde ", k=rng.choice([11, 24, 60, 150]))).strip() for _ in range(25)]
    texts = sorted({*base, *("".join(c for c in b if rng.random() > 0.05) for b in base for _ in range(2)), *("".join(c * (1 + (rng.random() < 0.05)) for c in b) for b in base)})
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    for threshold in (75, 90):
        got = {(r.a, r.b) for r in fuzzy.similar_pairs(rows, rows.withColumnRenamed("a", "b"), "a", "b", threshold).collect()}
        assert got == {(a, b) for a in texts for b in texts if fuzzy.indel_ratio(a, b) >= threshold}


def test_search_by_index_equals_contains(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abAB 1%_", k=rng.randrange(12))) if i % 9 else None, rng.choice(["Harbor 12", "HARBOUR", "", None])) for i in range(400)] + [(900, "x" * 500, "É ÉÀ")]
    table = spark.createDataFrame(rows, "id int, number string, vendor string").repartition(3)
    postings = search.write_postings(table, ["id"], ["number", "vendor"], f"{tmp_path}/p")
    for text in ("", "a", "ab", "aba", "AB a", "r 12", "harbo", "%_1", "éà", "xxxx", "none of these"):
        want = {i for i, n, v in rows if text.lower() in (n or "").lower() or text.lower() in (v or "").lower()}
        assert {r.id for r in search.find(table, postings, ["id"], ["number", "vendor"], text).collect()} == want
    plan = search.candidates(postings, ["id"], "harbo")._sc._jvm.PythonSQLUtils.explainString(search.candidates(postings, ["id"], "harbo")._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(gram" in plan
    assert search.write_postings(table.limit(0), ["id"], ["number"], f"{tmp_path}/e").count() == 0


def test_search_by_text_posts_shared_texts_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"INV-{rng.randrange(60)}" if i % 7 else None, rng.choice(["Harbor 12 LLC", "HARBOR 12 llc", "inv-1 %_", "É ÉÀ", "aaaa", "ab", "", None])) for i in range(900)] + [(5, "INV-12", "Inv-12"), (5, "INV-12", "Inv-12")]
    table, columns = spark.createDataFrame(rows, "id int, number string, vendor string").repartition(3), ["number", "vendor"]
    postings = search.write_text_postings(table, columns, f"{tmp_path}/p")
    texts = {(t or "").lower() for _, *both in rows for t in both}
    assert postings.count() == sum(max(len(t) - 2, 0) for t in texts)
    assert postings.distinct().count() == len({(t, t[i : i + 3]) for t in texts for i in range(len(t) - 2)})
    for text in ("", "a", "b ", "INV", "nv-1", "v-12", "or 12 l", "r 1 %", "aaa", "éà", "none of these"):
        want = sorted(str(r) for r in rows if any(text.lower() in (t or "").lower() for t in r[1:]))
        assert sorted(str(tuple(r)) for r in search.find_by_text(table, postings, columns, text).collect()) == want
    assert search.write_text_postings(table.limit(0), columns, f"{tmp_path}/e").count() == 0


def test_indexed_search_posts_no_shared_vendor_again(spark):
    sf, before = "/root/testdata/sf0.001", set(Path(shared_dir(spark).removeprefix("file://")).glob("postings-*"))
    __spark_entry__.queries()["indexed_search"](spark, sf)
    (path,) = set(Path(shared_dir(spark).removeprefix("file://")).glob("postings-*")) - before
    invoices = adapter.view(spark, sf, "invoices")
    texts = invoices.selectExpr("lower(number) AS t").union(invoices.selectExpr("lower(vendor_name)")).distinct()
    assert spark.read.parquet(str(path)).count() == texts.selectExpr("sum(greatest(length(t) - 2, 0)) AS n").head().n


def test_crowded_references_are_grouped_without_pairs(spark, monkeypatch):
    rng = random.Random(23)
    for dense in (True, False):
        digits = "123" if dense else "0123456789"
        code = lambda n, ab=digits: "".join(rng.choice(ab) for _ in range(n))  # noqa: E731, B023
        rows = []
        for i in range(1, 160):
            original = rng.randrange(1, i) if i > 1 and rng.random() < 0.2 else None
            bl = "" if rng.random() < 0.2 else "OSLN00" + code(5) + ("7" if rng.random() < 0.1 else "")
            box = ["OSLU00" + code(5)] if rng.random() < 0.4 else []
            rows.append((1 + i % 2, i, d.date(2026, 1, 1 + rng.randrange(25)), rng.random() < 0.2, bl, box, [f"PO{rng.randrange(90)}"] if rng.random() < 0.2 else [], original))
        docs = spark.createDataFrame(rows, DOCS + ", original long")
        crowded = grouping.near_keys(grouping.references(docs))[1].count()
        assert (crowded > 0) == dense
        with monkeypatch.context() as m:
            m.setattr(fuzzy, "similar_pairs", None)  # near bills of a crowded organisation grow with the square of its documents
            got = {r.doc_id: (r.shipment, r.method) for r in grouping.group_by_arrival(docs).collect()}
            state = None
            for part in (1, 0, 2):
                state = grouping.add_arrivals(state, docs.filter(F.col("doc_id") % 3 == part))
            batched = {r.doc_id: (r.shipment, r.method) for r in state.collect()}
        near = lambda a, b: fuzzy.indel_ratio(a, b) >= 90
        want = {}
        for org in (1, 2):
            want |= brute_places([r for r in rows if r[0] == org], near, lambda a, b: a[:4] == b[:4] and near(a, b))
        assert got == want and batched == want and sum(m == "fuzzy" for _, m in want.values()) > (20 if dense else 0)


def test_near_texts_share_a_key_that_one_asks_by_and_the_other_holds(spark):
    rng = random.Random(29)
    texts = {"".join(rng.choice("AB") for _ in range(rng.choice([9, 10, 11, 12]))) for _ in range(160)}
    texts |= {x[:i] + "Z" + x[i + rng.randrange(2) :] for x in ["".join(rng.choice("ABCDEFGH") for _ in range(40)) for _ in range(8)] for i in (3, 17, 30)}
    rows = [(i % 2, x, i % 3 > 0, i % 5 > 0) for i, x in enumerate(sorted(texts))]
    keys = fuzzy.shared_keys(spark.createDataFrame(rows, "g int, text string, asks boolean, holds boolean").cache(), 90, ["g"]).collect()
    asked, held = ({(r.g, r.key, r.text) for r in keys if r.role & bit} for bit in (1, 2))
    by: dict = {}
    for g, k, x in held:
        by.setdefault((g, k), set()).add(x)
    got = {(g, x, y) for g, k, x in asked for y in by[g, k] if x != y and fuzzy.near(x, y, 900)}
    want = {(g, x, y) for g, x, asks, _ in rows if asks for h, y, _, holds in rows if holds and g == h and x != y and fuzzy.indel_ratio(x, y) >= 90}
    assert got == want and len({len(x) for _, x, _ in want}) > 4


def test_an_original_that_comes_after_the_first_batch_is_met(spark):
    day = [d.date(2026, 1, i) for i in range(1, 6)]
    named = DOCS + ", original long"
    first = spark.createDataFrame([(1, 5, day[4], False, "", [], [], 3)], named)
    late = spark.createDataFrame([(1, 3, day[0], True, "B1", [], [], None)], named)
    after = {r.doc_id: (r.shipment, r.method) for r in grouping.add_arrivals(grouping.add_arrivals(None, first), late).collect()}
    assert after == {3: (3, "new"), 5: (3, "original_invoice")}


def test_candidates_equal_brute_force_and_near_ones_are_no_rows_until_the_end(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "similar_pairs", None)  # its pairs went through five shuffles
    rng = random.Random(31)
    code = lambda n: "".join(rng.choice("123") for _ in range(n))
    long = ["".join(rng.choice("ABCDEFGH") for _ in range(40)) for _ in range(4)]

    def bill():
        x = rng.choice(long)
        i = rng.randrange(30)
        return rng.choice(["", "OSLN00" + code(5), "OSLN00" + code(5) + "7", x[:i] + "Z" + x[i + rng.randrange(3) :]])

    boxes = lambda: ["OSLU00" + code(5) for _ in range(rng.randrange(3))] + (["CSQU3054383"] if rng.random() < 0.2 else [])
    docs = [(1 + i % 2, i, bill(), boxes(), [f"PO{rng.randrange(30)}"]) for i in range(90)]
    ships = [(1 + i % 2, 1000 + i, bill(), boxes(), [f"PO{rng.randrange(30)}"], d.date(2026, 1, 1 + rng.randrange(5))) for i in range(90)]
    kinds = "bl string, boxes array<string>, pos array<string>"
    frames = spark.createDataFrame(docs, f"org_id int, doc_id long, {kinds}"), spark.createDataFrame(ships, f"org_id int, shipment_id long, {kinds}, updated_on date")
    got = [(r.doc_id, r.shipment_id, r.method, r.score, r["rank"]) for r in grouping.candidates(*frames).collect()]
    near = lambda a, b: fuzzy.indel_ratio(a, b) >= 90
    want = []
    for org, doc, bl, box, po in docs:
        met = []
        for o, s, ship_bl, ship_box, ship_po, on in ships:
            if o != org:
                continue
            if bl and bl == ship_bl:
                how = "exact_bl"
            elif set(box) & set(ship_box):
                how = "exact_container"
            elif set(po) & set(ship_po):
                how = "exact_po"
            elif (bl and ship_bl and near(bl, ship_bl)) or any(a[:4] == b[:4] and near(a, b) for a in box if not valid_box(a) for b in ship_box):
                how = "fuzzy"
            else:
                continue
            met.append((-grouping.SCORES[how], -on.toordinal(), s, how))
        want += [(doc, s, how, -score, i) for i, (score, _, s, how) in enumerate(sorted(met), 1)]
    assert sorted(got) == sorted(want) and {x[2] for x in want} == {"exact_bl", "exact_container", "exact_po", "fuzzy"}
    assert {40, 41, 42, 39} & {len(x[2]) for x in docs}
