"""Queues, search, assignment and event-derived states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import beside, placed


def search(shipments: DataFrame, docs: DataFrame, text: str, own: list[str], theirs: list[str]) -> DataFrame:
    """Shipments whose own columns, or whose documents', contain a text in either case. A semi join keeps rows single."""
    q = text.lower()

    def hit(columns: list[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
        return out

    found = docs.filter(hit(theirs)).select("org_id", "shipment_id").union(shipments.filter(hit(own)).select("org_id", "shipment_id"))
    return shipments.join(found, ["org_id", "shipment_id"], "left_semi")


def payment_filter(shipments: DataFrame, bills: DataFrame, key: str, today: str) -> DataFrame:
    """Shipments by the state of their bills: unpaid, overdue, paid (all bills), problem or not_checked.

    ``bills``: shipment_id, state, due_on.
    """
    open_ = F.col("state").isin("unpaid", "partial")
    tests = {"unpaid": open_, "overdue": open_ & (F.col("due_on") < F.lit(today).cast("date")), "problem": F.col("state").isin("void", "missing"), "not_checked": F.coalesce("state", F.lit("")) == ""}
    if key == "paid":
        paid = shipments.join(bills.filter("state = 'paid'"), "shipment_id", "left_semi")
        return paid.join(bills.filter(~F.col("state").eqNullSafe("paid")), "shipment_id", "left_anti")
    return shipments.join(bills.filter(tests[key]), "shipment_id", "left_semi")


def neighbours(queue: DataFrame, by: list[str], order: list[Column], key: str) -> DataFrame:
    """Each row's previous and next key in its queue, which may be of any length."""
    rows = placed(queue, by, order)
    return beside(beside(rows, by, {key: "previous"}, -1), by, {key: "next"}, 1).drop("place")


def round_robin(waiting: DataFrame, pool: DataFrame, by: list[str], order: list[Column], last: int = 0) -> DataFrame:
    """Deal waiting rows to the pool's members in turn, beginning after the member ``last``, by id and wrapping.

    ``pool``: by, member. Members of each group are numbered, and rows join them by their number modulo the pool's size.
    """
    seats = placed(pool, by, [F.col("member")])
    sizes = seats.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("member") <= last).alias("_after"))
    rows = placed(waiting, by, order).join(sizes, by)
    rows = rows.withColumn("_seat", (F.col("place") - 1 + F.col("_after")) % F.col("_n") + 1)
    return rows.join(seats.select(*by, "member", F.col("place").alias("_seat")), [*by, "_seat"]).drop("_seat", "place", "_n", "_after")


def transitions(events: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Events that change a key's state, with the state before (null for the first)."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    return events.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col(state)))


def once(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first event of each key (repeats are dropped)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def over_limit(events: DataFrame, key: str, at: str, limit: int, minutes: int = 1) -> DataFrame:
    """Keys and minutes with more than ``limit`` events."""
    per = events.groupBy(F.window(at, f"{minutes} minutes").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") > limit).select(key, F.col("w.start").alias("minute"), "n")


def worst_state(bills: DataFrame, by: list[str], rank: dict[str, int], state: str = "state") -> DataFrame:
    """The worst state of each group's bills (least rank) and their number."""
    order = F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])
    return bills.groupBy(*by).agg(F.min(F.struct(order[F.col(state)].alias("r"), F.col(state).alias("s")))["s"].alias("worst"), F.count(F.lit(1)).alias("n"))


def blockers(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add ``blocked``: the names of all conditions that hold, in the order given."""
    return rows.withColumn("blocked", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()])))


def threads(comments: DataFrame) -> DataFrame:
    """Top-level comments with their replies in order. ``comments``: comment_id, parent_id, at, body."""
    replies = comments.filter("parent_id is not null").groupBy(F.col("parent_id").alias("comment_id")).agg(F.array_sort(F.collect_list(F.struct("at", "comment_id", "body"))).alias("replies"))
    return comments.filter("parent_id is null").drop("parent_id").join(replies, "comment_id", "left")


def my_work(shipments: DataFrame, members: DataFrame) -> DataFrame:
    """What waits for each member: shipments assigned to them, and those that they may approve, each once with the first reason.

    ``shipments``: org_id, shipment_id, status, assigned_to. ``members``: org_id, member, may_approve.
    """
    open_ = shipments.filter(F.col("status").isin("needs_review", "open", "ready"))
    mine = open_.join(members.select("org_id", F.col("member").alias("assigned_to")), ["org_id", "assigned_to"]).select("org_id", F.col("assigned_to").alias("member"), "shipment_id", F.lit(0).alias("_r"))
    ready = open_.filter("status = 'ready'").join(members.filter("may_approve").select("org_id", "member"), "org_id").select("org_id", "member", "shipment_id", F.lit(1).alias("_r"))
    first = mine.unionByName(ready).groupBy("org_id", "member", "shipment_id").agg(F.min("_r").alias("_r"))
    return first.select("org_id", "member", "shipment_id", F.when(F.col("_r") == 0, "assigned").otherwise("approve").alias("reason"))


def timeline(audit: DataFrame, objects: DataFrame) -> DataFrame:
    """Everything that happened to a shipment, its documents and its issues, in order.

    ``audit``: event_id, seen_at, object_type, object_id, action. ``objects``: shipment_id, object_type, object_id.
    """
    rows = audit.join(objects.distinct(), ["object_type", "object_id"])
    w = Window.partitionBy("shipment_id").orderBy("seen_at", "event_id")
    return rows.withColumn("place", F.row_number().over(w)).select("shipment_id", "place", "event_id", "object_type", "action")


def open_exceptions(issues: DataFrame) -> DataFrame:
    """Open issues by code and severity: how many, in how many shipments, and the money at risk by currency."""
    by = ["org_id", "code", "severity"]
    sums = issues.groupBy(*by, "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_at_risk").cast("decimal(18,2)").alias("at_risk"))
    ships = issues.groupBy(*by).agg(F.count_distinct("shipment_id").alias("n_shipments"))
    return sums.join(ships, by)


def model_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and cost of reading by model. ``calls``: tokens_in, tokens_out, cost (decimal)."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").cast("decimal(18,6)").alias("cost"))


def digest_due(orgs: DataFrame, now: Column, sent: DataFrame, hour: int = 7, window: int = 3) -> DataFrame:
    """Organisations whose daily digest is due: their local time is within ``window`` hours of ``hour`` and none was sent that local day.

    ``orgs``: org_id, zone. ``sent``: org_id, day. ``now`` is a UTC timestamp. Claiming is the left anti join: who is in ``sent`` isn't due again.
    """
    local = F.from_utc_timestamp(now, F.col("zone"))
    rows = orgs.withColumns({"day": F.to_date(local), "_hour": F.hour(local)}).filter((F.col("_hour") >= hour) & (F.col("_hour") < hour + window))
    return rows.drop("_hour").join(sent.select("org_id", "day"), ["org_id", "day"], "left_anti")


def digest(shipments: DataFrame, issues: DataFrame, today: str) -> DataFrame:
    """What a digest says for each organisation: shipments waiting and ready, those received today, open errors, and the oldest waiting."""
    day = F.lit(today).cast("date")
    counts = shipments.groupBy("org_id").agg(
        F.count_if(F.col("status") == "needs_review").alias("waiting"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("received_on") == day).alias("received"), F.min(F.when(F.col("status") == "needs_review", F.col("received_on"))).alias("oldest")
    )
    errors = issues.filter("severity = 'error'").groupBy("org_id").agg(F.count(F.lit(1)).alias("errors"))
    return counts.join(errors, "org_id", "left").na.fill(0, ["errors"])


def retry_plan(tries: DataFrame, most: int = 3, base_seconds: int = 60, cap_seconds: int = 3600) -> DataFrame:
    """What becomes of failed work: retry after a doubling pause, or error once ``most`` tries failed.

    ``tries``: key, ok (boolean), at (timestamp), one row a try. Returns key, n_failed, state (done, retry, error) and next_at.
    """
    w = tries.groupBy("key").agg(F.count_if(~F.col("ok")).alias("n_failed"), F.bool_or("ok").alias("_ok"), F.max("at").alias("_last"))
    pause = F.least(F.lit(cap_seconds), (F.lit(base_seconds) * F.pow(2, F.col("n_failed") - 1)).cast("int"))
    state = F.when(F.col("_ok"), "done").when(F.col("n_failed") >= most, "error").otherwise("retry")
    return w.withColumn("state", state).select("key", "n_failed", "state", F.when(F.col("state") == "retry", F.timestamp_seconds(F.unix_timestamp("_last") + pause)).alias("next_at"))


def stalled(work: DataFrame, now: Column, minutes: int = 30, most: int = 3) -> DataFrame:
    """Work in progress for too long: requeue it, up to ``most`` times, then error. ``work``: key, started_at, requeues."""
    late = work.filter(F.col("started_at") < now - F.expr(f"interval {minutes} minutes"))
    return late.select("key", F.when(F.col("requeues") < most, "requeue").otherwise("error").alias("action"))


#: Orders of the portfolio: presets by name.
PRESETS = {"attention": ["n_errors desc", "oldest asc nulls last"], "newest": ["received_on desc"], "oldest": ["received_on asc"], "value": ["total desc nulls last"]}


def sort_rows(rows: DataFrame, preset: str, key: str, locked: str | None = None) -> DataFrame:
    """Rows by a preset; locked ones come last, ties go by key."""
    if preset not in PRESETS:
        raise ValueError(f"{preset!r} is none of {', '.join(PRESETS)}")
    order = []
    for spec in PRESETS[preset]:
        c, *how = spec.split(" ", 1)
        kinds = {"desc": F.col(c).desc(), "asc": F.col(c).asc(), "desc nulls last": F.col(c).desc_nulls_last(), "asc nulls last": F.col(c).asc_nulls_last()}
        order.append(kinds[how[0]])
    return rows.orderBy(*([F.col(locked).asc()] if locked else []), *order, key)


#: What a portfolio is sorted by; those in which more comes first.
PORTFOLIO_SORTS = ["organization", "role", "needs_review", "ready", "assigned", "failed", "at_risk", "oldest"]
MORE_FIRST = ["needs_review", "ready", "assigned", "failed", "at_risk", "oldest"]


def portfolio_order(key: str | None = None, direction: str | None = None) -> list[Column]:
    """The order of a portfolio's rows (organization, role, locked, attention and the sort's own columns, where null counts as nothing).

    Without a known key by attention, most first, then by name; else by the key and name, both in the same direction. Locked rows come last.
    """
    name = F.lower("organization")
    if key not in PORTFOLIO_SORTS:
        return [F.col("locked").asc(), F.col("attention").desc(), name.asc()]
    down = (direction or ("desc" if key in MORE_FIRST else "asc")) == "desc"
    value = F.lower(key) if key in ("organization", "role") else F.coalesce(F.col(key).cast("decimal(38,6)"), F.lit(0))
    return [F.col("locked").asc(), *[c.desc() if down else c.asc() for c in (value, name)]]


def decide(rows: DataFrame) -> DataFrame:
    """The status that a decision leads to, or why it is refused. ``rows``: status, decision (approve, reject, post, reopen), n_errors, may_approve."""
    refused = (
        F.when(~F.col("may_approve"), "not allowed").when((F.col("decision") == "approve") & (F.col("status") != "ready"), "not ready").when((F.col("decision") == "approve") & (F.col("n_errors") > 0), "open errors")
        .when((F.col("decision") == "post") & (F.col("status") != "approved"), "not approved").when((F.col("decision") == "reopen") & ~F.col("status").isin("approved", "rejected"), "not closed")
        .when((F.col("decision") == "reject") & (F.col("status") == "posted"), "posted")
    )
    new = F.create_map(*[F.lit(x) for kv in (("approve", "approved"), ("reject", "rejected"), ("post", "posted"), ("reopen", "needs_review")) for x in kv])[F.col("decision")]
    return rows.withColumns({"refused": refused, "new_status": F.when(refused.isNull(), new).otherwise(F.col("status"))})
