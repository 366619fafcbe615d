"""Streaming forms of the event operators: selection, deduplication, rate limits, alerts once, the savings ledger.

Each takes and returns streaming DataFrames (static ones work too where state isn't needed).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Audit actions that are published, and as what.
PUBLISHED = {"signup": "shipment.created", "purchase": "shipment.posted", "error": "document.failed"}


def published(audit: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Outgoing events: those of audit actions that are mapped, with a JSON payload."""
    kinds = F.create_map(*[F.lit(x) for kv in (mapping or PUBLISHED).items() for x in kv])
    rows = audit.withColumn("type", F.try_element_at(kinds, F.col("action"))).filter("type is not null")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), "type", F.col("object_id").alias("object"), "amount"))
    return rows.select("event_id", "seen_at", "type", payload.alias("payload"))


def distinct_within(events: DataFrame, key: list[str], at: str = "seen_at", delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a key that come within the delay of the first."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def minute_counts(events: DataFrame, key: str, at: str = "seen_at", delay: str = "5 minutes") -> DataFrame:
    """Events for each key and minute, closed once the watermark has passed."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("minute"), "n")


def alert_once(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """A row for a key when its value differs from the one alerted last: a changed date fires again, a repeated one doesn't."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for v in b[value].astype("string"):
                if not pd.isna(v) and v != last:
                    last = str(v)
                    out.append((*k, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[*key, "alerted"])

    schema = ", ".join([*kinds, "alerted string"])
    return rows.groupBy(*key).applyInPandasWithState(run, schema, "alerted string", "append", GroupStateTimeout.NoTimeout)


def ledger(issue_events: DataFrame) -> DataFrame:
    """The savings ledger as issue events arrive: the same rule as the batch fold, with caught and latest amount as state.

    Emits the catch after each batch that touches it (update mode).
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        caught, latest, cleared = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for amount, reason in zip(rows["amount"], rows["reason"], strict=True):
            reason = None if pd.isna(reason) else reason
            if amount is None or pd.isna(amount):
                cleared = reason or "invoice"
            elif amount > 0:
                if caught is None:
                    caught = amount
                elif reason == "rates":
                    caught = max(amount, Decimal(caught) + amount - Decimal(latest))
                else:
                    caught = max(Decimal(caught), amount)
                latest, cleared = amount, None
        if caught is not None:
            state.update((Decimal(caught), Decimal(latest), cleared))
            yield pd.DataFrame([(*k, caught, latest, cleared)], columns=["org_id", "scope", "catch_key", "caught", "latest", "cleared"])

    state = "caught decimal(18,2), latest decimal(18,2), cleared string"
    return issue_events.groupBy("org_id", "scope", "catch_key").applyInPandasWithState(
        run, f"org_id long, scope string, catch_key string, {state}", state, "update", GroupStateTimeout.NoTimeout
    )
