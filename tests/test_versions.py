"""Locked versions, merges by fingerprint, splits kept current, lookups asked once, claims of a sink and timers across restarts."""

import datetime as d
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quaywise.operators import customs, shared, statements, versions


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a", D("5.00")), (1, None, D("7.00"))], "org_id int, vendor string, amount decimal(18,2)")
    store = versions.Snapshots(spark, f"file://{tmp_path}/close")
    assert store.versions("2026-06-30") == []
    with pytest.raises(ValueError, match="no version"):
        store.read("2026-06-30")
    assert store.commit(rows, "2026-06-30", expected=0) == 1
    with pytest.raises(versions.VersionConflict):
        store.commit(rows, "2026-06-30", expected=0, note="late")
    with pytest.raises(ValueError, match="say why"):
        store.commit(rows, "2026-06-30", expected=1)
    # both saw version 1: the second one's look at the folder is as old as the first one's
    monkeypatch.setattr(versions.Snapshots, "versions", lambda self, period: [1])
    assert store.commit(rows.filter("vendor = 'a'"), "2026-06-30", expected=1, note="b was paid") == 2
    with pytest.raises(versions.VersionConflict):
        store.commit(rows, "2026-06-30", expected=1, note="other")
    monkeypatch.undo()
    assert store.versions("2026-06-30") == [1, 2] and store.versions("2026-07-31") == []
    assert [r.amount for r in store.read("2026-06-30").collect()] == [D("5.00")] and store.read("2026-06-30", 1).count() == 2
    assert store.about("2026-06-30", 2)["note"] == "b was paid"
    folders = {p.name.split("-")[0] for p in (tmp_path / "close" / "2026-06-30").iterdir() if not p.name.startswith(".")}
    assert folders == {"rows", "versions"} and len(list((tmp_path / "close" / "2026-06-30").glob("rows-*"))) == 2  # the loser's rows are gone
    assert store.commit(rows.limit(0), "2026-07-31", expected=0) == 1 and store.read("2026-07-31").count() == 0


def test_a_changed_snapshot_is_refused(spark, tmp_path):
    store = versions.Snapshots(spark, f"file://{tmp_path}")
    store.commit(spark.range(5), "p")
    spark.range(6).write.mode("overwrite").parquet(f"{tmp_path}/p/{store.about('p', 1)['rows']}")
    with pytest.raises(ValueError, match="changed after"):
        store.read("p")


def test_a_second_merge_changes_nothing(spark):
    schema = "k int, part string, amount int"
    stored = spark.createDataFrame([(1, "a", 5, "done"), (1, None, 6, "open"), (2, "a", 7, None), (3, "a", None, "x")], schema + ", choice string")
    fresh = spark.createDataFrame([(1, "a", 5), (1, None, 9), (3, "a", None), (4, "b", 1)], schema)
    once = versions.merged(stored, fresh, ["k", "part"], ["amount"], ["choice"])
    got = {(r.k, r.part): (r.amount, r.choice, r.action) for r in once.collect()}
    assert got == {(1, "a"): (5, "done", "kept"), (1, None): (9, "open", "changed"), (2, "a"): (7, None, "gone"), (3, "a"): (None, "x", "kept"), (4, "b"): (1, None, "added")}
    again = versions.merged(once.filter("action <> 'gone'").drop("action"), fresh, ["k", "part"], ["amount"], ["choice"]).collect()
    assert len(again) == 4 and {r.action for r in again} == {"kept"} and {r.choice for r in again} == {"done", "open", "x", None}


def test_splits_are_kept_current(spark):
    share, invoice = "doc_id int, party int, amount decimal(18,2), currency string", "doc_id int, total decimal(18,2), currency string, dismissed boolean, manual boolean, was_total decimal(18,2), was_currency string"
    stored = spark.createDataFrame([(i, p, D(5), "USD") for i in range(1, 8) for p in (10, 20)] + [(8, 10, D(5), "USD"), (8, 99, D(5), "USD")], share)
    fresh = spark.createDataFrame([(i, p, D(5), "USD") for i in range(1, 8) for p in (10, 20) if (i, p) != (7, 20)] + [(2, 30, D(4), "USD"), (9, 10, D(1), "USD"), (9, 20, D(2), "USD"), (9, 99, D(2), "USD")], share)
    fresh = fresh.withColumn("amount", F.when(F.expr("doc_id = 2 and party = 10"), D(1)).otherwise(F.col("amount")).cast("decimal(18,2)"))
    rows = [(i, D(10), "USD", i == 3, i in (4, 5), D(10) if i != 5 else D(9), "USD") for i in range(1, 10)]
    rows[5] = (6, None, "USD", False, False, None, "USD")
    inv, locked = spark.createDataFrame(rows, invoice), spark.createDataFrame([(99,)], "party int")
    first = shared.sync_splits(stored, fresh, inv, locked)
    got = {(r.doc_id, r.party): r.action for r in first.collect()}
    want = {(1, 10): "kept", (1, 20): "kept", (2, 10): "changed", (2, 20): "kept", (2, 30): "added", (4, 10): "kept", (4, 20): "kept", (5, 10): "recheck", (5, 20): "recheck", (8, 10): "kept", (8, 99): "kept", (9, 10): "added", (9, 20): "added"}
    assert got == want | {(i, p): "gone" for i in (3, 6, 7) for p in (10, 20)}
    live = first.filter("action <> 'gone'").drop("action")
    once_made = inv.withColumn("was_total", F.col("total"))
    assert {r.action for r in shared.sync_splits(live, fresh, once_made, locked).collect()} == {"kept"}


def test_resolutions_stay_with_what_is_still_found(spark):
    schema = "statement_id int, bucket string, position int, item_id int, effect decimal(18,2)"
    first = spark.createDataFrame([(1, "missing", 2, None, D(5)), (1, "amount_differs", 3, 7, D(1)), (1, "not_on_statement", None, 9, D(2))], schema)
    none = spark.createDataFrame([], "statement_id int, fingerprint string, bucket string, position int, item_id int, effect decimal(18,2), resolution string")
    before = statements.keep_resolutions(first, none).drop("action").withColumn("resolution", F.when(F.col("item_id") == 7, "accepted"))
    again = {r.fingerprint: (r.action, r.resolution) for r in statements.keep_resolutions(first, before).collect()}
    assert again == {"missing:line2": ("kept", None), "amount_differs:item7": ("kept", "accepted"), "not_on_statement:item9": ("kept", None)}
    later = first.filter("bucket <> 'missing'").withColumn("effect", F.when(F.col("item_id") == 7, D(3)).otherwise(F.col("effect")).cast("decimal(18,2)"))
    got = {r.fingerprint: (r.action, r.resolution, r.effect) for r in statements.keep_resolutions(later, before).collect()}
    assert got == {"missing:line2": ("gone", None, D(5)), "amount_differs:item7": ("changed", "accepted", D(3)), "not_on_statement:item9": ("kept", None, D(2))}


def test_a_pair_is_asked_once(spark):
    lines = spark.createDataFrame([(1, "8471.30.0100", "Laptop  PC"), (1, "8471300100", "laptop pc"), (1, "9903.88.15", "duty"), (1, None, "x"), (2, "8471.30.0100", "Laptop PC")], "org_id int, hts string, description string")
    key = ["org_id", "hts", "description"]
    pairs = customs.tariff_pairs(lines)
    cache = spark.createDataFrame([(2, "8471300100", "laptop pc", True, "known")], "org_id int, hts string, description string, plausible boolean, reason string")
    asked = versions.unseen(pairs, cache, key)
    assert [tuple(r) for r in asked.collect()] == [(1, "8471300100", "laptop pc")]
    answers = asked.withColumns({"plausible": F.lit(False), "reason": F.lit("b")}).unionByName(asked.withColumns({"plausible": F.lit(False), "reason": F.lit("a")}))
    more = versions.answered(cache, answers.unionByName(cache.withColumn("reason", F.lit("late"))), key)
    assert versions.unseen(pairs, more, key).count() == 0
    assert {(r.org_id, r.reason) for r in more.collect()} == {(1, "a"), (2, "known")}
