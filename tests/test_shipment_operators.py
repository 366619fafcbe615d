"""Operators of open charges, shared invoices, exports, disputes, entries, free time, statements and queues: pinned values and edge cases."""

import datetime as d
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quaywise.functions import text
from quaywise.operators import accruals, allocation, customs, disputes, exports, order, shared, statements, workflow
from quaywise.sources import sheets


def test_on_board_day_is_read_from_the_same_or_the_next_line(spark):
    texts = ["Shipped on board 2026-03-08", "ON BOARD DATE:\n8 Mar 2026", "on board\n\n2026-03-08", "no date", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(accruals.on_board_day("t")).collect()]
    assert got == [d.date(2026, 3, 8), d.date(2026, 3, 8), None, None, None]


def test_gap_of_an_invoice_goes_to_its_largest_part(spark):
    lines = spark.createDataFrame([(1, "freight", D("70.00")), (1, "delivery", D("20.00")), (2, "freight", D("5.00"))], "doc_id int, group string, amount decimal(18,2)")
    totals = spark.createDataFrame([(1, D("100.00")), (2, D("1.00"))], "doc_id int, total decimal(18,2)")
    got = {(r.doc_id, r.group): (r.amount, r.main) for r in accruals.parts_by_group(lines, totals).collect()}
    assert got == {(1, "freight"): (D("80.00"), True), (1, "delivery"): (D("20.00"), False), (2, "freight"): (D("5.00"), True)}


def test_a_text_names_the_shipments_whose_references_it_prints(spark):
    texts = spark.createDataFrame([(1, 7, "freight for osln 1234567, and HLCU-99 (no)"), (1, 8, None), (2, 9, "OSLN1234567")], "org_id int, doc_id int, text string")
    refs = spark.createDataFrame([(1, 11, "OSLN1234567"), (1, 12, "HLCU9"), (1, 13, "HLCU99")], "org_id int, shipment_id int, ref string")
    got = {(r.doc_id, r.shipment_id): r.refs for r in shared.named_parties(texts, refs).collect()}
    assert got == {(7, 11): ["OSLN1234567"], (7, 13): ["HLCU99"]}


def test_shared_lines_go_whole_to_their_owner_and_the_rest_adds_up(spark):
    lines = spark.createDataFrame([(1, 1, "truck AAAAAA", 1000), (1, 2, "ocean", 1001), (1, 3, "docs AAAAAA BBBBBB", 500), (1, 4, "zero", 0)], "doc_id long, line long, description string, cents long")
    refs = spark.createDataFrame([(1, 21, "AAAAAA"), (1, 22, "BBBBBB"), (1, 21, "COMMON"), (1, 22, "COMMON")], "doc_id long, party long, ref string")
    owned = shared.line_owners(lines, refs)
    assert {r.line: r.owner for r in owned.collect()} == {1: 21, 2: None, 3: None, 4: None}
    parties = spark.createDataFrame([(1, 21, 2), (1, 22, 1)], "doc_id long, party long, w long")
    parts = shared.split_shared(owned, parties).collect()
    for line, cents in ((1, 1000), (2, 1001), (3, 500)):
        assert sum(r.part for r in parts if r.line == line) == cents
    assert sum(r.part for r in parts if r.party == 22) == 500 and sum(r.part for r in parts if r.party == 21) == 2001
    bills = shared.bill_lines(spark.createDataFrame(parts), lines).collect()
    assert sum(r.amount for r in bills) == D("25.01")


def test_exports_refuse_unknown_parameters_and_keep_spreadsheets_from_running_cells(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ready", d.date(2026, 1, 2)), (2, "posted", d.date(2026, 1, 3))], "shipment_id int, status string, created_on date")
    assert [r.shipment_id for r in exports.filter_shipments(rows, "all", "2026-01-03").collect()] == [2]
    for bad in ({"status": "nope"}, {"status": "all", "first": "03/01/2026"}):
        with pytest.raises(ValueError):
            exports.filter_shipments(rows, **bad)
    exports.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int").coalesce(1), f"{tmp_path}/out")
    body = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert body.startswith("﻿a,b".encode()) and b"'=1+1" in body


def test_a_credit_is_offered_to_the_single_waiting_dispute(spark):
    disp = spark.createDataFrame(
        [(1, 1, "acme", "INV-1", "USD", "sent", None), (1, 2, "acme", "INV-2", "USD", "sent", None), (1, 3, "acme", "inv2", "USD", "acknowledged", None), (1, 4, "acme", "INV-4", "EUR", "sent", None), (1, 5, "acme", "INV-5", "USD", "sent", 9)],
        "org_id int, dispute_id int, vendor_key string, invoice_number string, currency string, status string, credit_note int",
    )
    credits = spark.createDataFrame(
        [(1, 50 + i, "Acme LLC", n, D("-5.00"), "USD", d.date(2026, 1, i)) for i, n in enumerate(["INV 1", "INV 1", "INV 2", "INV 4", "INV 5"], 1)], "org_id int, doc_id int, vendor_name string, original string, total decimal(18,2), currency string, received_on date"
    )
    assert [tuple(r) for r in disputes.credit_suggestions(credits, disp).collect()] == [(1, 52, D("5.00"))]


def test_entry_numbers_and_origins(spark):
    rows = spark.createDataFrame([(1, "ABC-1234567-8 and ABC12345678, XYZ 7654321-0", "Made in Viet Nam.\nx"), (2, None, "Country of Origin: People's Republic of China"), (3, "none", "made in Narnia")], "i int, t string, o string")
    got = {r.i: (r.n, r.c) for r in rows.select("i", customs.entry_numbers_in("t").alias("n"), customs.printed_origin("o").alias("c")).collect()}
    assert got == {1: (["ABC12345678", "XYZ76543210"], "VN"), 2: ([], "CN"), 3: ([], None)}


def test_credits_applied_match_an_invoice_that_shows_less(spark):
    money = "decimal(18,2)"
    found = spark.createDataFrame(
        [("s", "amount_differs", 1, 10, "number", D("-30.00")), ("s", "credit_not_applied", None, 11, "", D("30.00")), ("s", "credit_not_applied", None, 12, "", D("4.00"))], f"statement_id string, bucket string, position long, item_id long, how string, effect {money}"
    )
    lines = spark.createDataFrame([("s", 1, D("70.00"))], f"statement_id string, position long, amount {money}")
    items = spark.createDataFrame([("s", 10, "INV-1", D("100.00"))], f"statement_id string, item_id long, number string, amount {money}")
    credits = spark.createDataFrame([("s", 11, "inv 1", D("30.00")), ("s", 12, "inv 1", D("4.00"))], f"statement_id string, item_id long, original string, amount {money}")
    got = {(r.item_id, r.bucket): (r.how, r.effect) for r in statements.credits_applied(found, lines, items, credits).collect()}
    assert got == {(10, "matched"): ("credit", D("0.00")), (12, "credit_not_applied"): ("", D("4.00"))}


def test_frozen_results_stand_as_a_whole(spark):
    live = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "ship int, product string, landed int")
    old = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2)], "ship int, product string, landed int, version int")
    got = sorted(tuple(r) for r in allocation.frozen_or_live(live, old, ["ship"]).collect())
    assert got == [(1, "a", 2, True), (2, "a", 7, False)]


def test_retries_double_their_pause_and_end(spark):
    at = d.datetime(2026, 1, 1)
    rows = [("a", False, at), ("a", False, at), ("b", False, at), ("b", True, at), *[("c", False, at)] * 3]
    got = {r.key: (r.state, r.next_at) for r in workflow.retry_plan(spark.createDataFrame(rows, "key string, ok boolean, at timestamp")).collect()}
    assert got == {"a": ("retry", at + d.timedelta(seconds=120)), "b": ("done", None), "c": ("error", None)}
    work = spark.createDataFrame([("x", at, 0), ("y", at, 3), ("z", at + d.timedelta(hours=1), 0)], "key string, started_at timestamp, requeues int")
    assert {r.key: r.action for r in workflow.stalled(work, F.lit(at + d.timedelta(hours=1))).collect()} == {"x": "requeue", "y": "error"}


def test_sorts_are_named_and_put_locked_rows_last(spark):
    rows = spark.createDataFrame([(1, None, False), (2, 5, False), (3, 9, True), (4, 7, False)], "k int, total int, locked boolean")
    assert [r.k for r in workflow.sort_rows(rows, "value", "k", "locked").collect()] == [4, 2, 1, 3]
    with pytest.raises(ValueError):
        workflow.sort_rows(rows, "colour", "k")


def test_places_and_sums_of_one_large_group(spark):
    rows = spark.range(1000).select(F.lit(1).alias("g"), "id", F.col("id").alias("v")).union(spark.range(3).select(F.lit(2), "id", "id"))
    got = order.placed(rows, ["g"], [F.col("id").desc()], "v").collect()
    assert {(r.g, r.id): (r.place, r.upto) for r in got} == {(g, i): (n - i, sum(range(i, n))) for g, n in ((1, 1000), (2, 3)) for i in range(n)}


def test_free_text_values(spark):
    rows = spark.createDataFrame([(1, " a;b,, a\nc ", "Hi @Ann.b, see @bob. mail x@y.z"), (2, None, None)], "i int, t string, m string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", text.listify("t").alias("a"), text.mentions("m").alias("b")).collect()}
    assert got == {1: (["a", "b", "c"], ["ann.b", "bob"]), 2: ([], [])}
    names = spark.createDataFrame([("../../etc/pass:wd",), ("C:\\x\\a?.pdf",), ("...",)], "n string")
    assert [r[0] for r in names.select(text.safe_file_name("n")).collect()] == ["passwd", "a.pdf", "file"]


def test_csv_of_any_encoding_and_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;town\n\"Müller; \"\"Söhne\"\"\";Köln\n\n".encode())
    (tmp_path / "b.csv").write_bytes("name,town\r\nMüller,\"K\nöln\"\r\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"a\tb\n\x81\t2\n")
    got = {(r.name, r.row): r.cells for r in sheets.read_rows(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.csv", 1): ["name", "town"], ("a.csv", 2): ['Müller; "Söhne"', "Köln"], ("b.csv", 1): ["name", "town"], ("b.csv", 2): ["Müller", "K\nöln"], ("c.csv", 1): ["a", "b"], ("c.csv", 2): ["\x81", "2"],
    }
