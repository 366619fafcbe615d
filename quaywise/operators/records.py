"""Records from outside and what people taught: payments and bills read back, mail received, corrections, vendors, accounts, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import fuzzy, keys, money
from quaywise.sources.scratch import materialise

#: Outgoing event types and the audit actions that raise them; three come from changes of state.
EVENT_TYPES = {
    "document.received": ["document.received"], "document.extracted": ["document.extracted"],
    "shipment.needs_review": [], "shipment.ready": [],
    "shipment.approved": ["shipment.approved"], "shipment.rejected": ["shipment.rejected"],
    "bill.posted": ["bill.posted", "vendor_credit.posted"], "bill.failed": ["bill.failed", "vendor_credit.failed"],
    "issue.created": [],
    "dispute.sent": ["dispute.sent"], "dispute.credit_received": ["dispute.credit_received"], "dispute.resolved": ["dispute.resolved"], "dispute.closed": ["dispute.closed"], "dispute.overdue": ["dispute.overdue"],
}
#: Audit actions that raise an alert, and the alerts that each kind of channel gets unless told otherwise.
ALERTS = {
    "bill.failed": "bill.failed", "vendor_credit.failed": "bill.failed", "mailbox.needs_reconnect": "mailbox.reconnect", "qbo.needs_reconnect": "qbo.reconnect",
    "dispute.overdue": "dispute.overdue", "dispute.credit_received": "dispute.credit_received",
}
SUBSCRIPTIONS = {
    "slack": ["shipment.ready", "bill.failed", "qbo.reconnect", "mailbox.reconnect", "dispute.overdue", "dispute.credit_received"],
    "teams": ["shipment.ready", "bill.failed", "qbo.reconnect", "mailbox.reconnect", "dispute.overdue", "dispute.credit_received"],
    "email": ["qbo.reconnect", "mailbox.reconnect", "digest.daily"],
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def event_type(action: Column | str) -> Column:
    """The event that an audit action publishes; null if it publishes none."""
    table = {a: kind for kind, actions in EVENT_TYPES.items() for a in actions}
    return _lookup(table, F.col(action) if isinstance(action, str) else action)


def alerts(audit: DataFrame, channels: DataFrame) -> DataFrame:
    """Alerts for each channel of an organisation that subscribes to them: its own choice of events, else its kind's.

    ``audit``: org_id, event_id, action. ``channels``: org_id, channel_id, kind, events (array; null: the kind's).
    """
    kinds = F.create_map(*[x for k, v in SUBSCRIPTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = channels.select("org_id", "channel_id", F.explode(F.coalesce("events", F.try_element_at(kinds, F.col("kind")))).alias("alert"))
    return audit.withColumn("alert", _lookup(ALERTS, F.col("action"))).filter("alert is not null").join(wanted, ["org_id", "alert"]).select("org_id", "event_id", "channel_id", "alert")


def voided(total: Column, note: Column, posted: Column) -> Column:
    """Whether a bill was voided in accounting: its total is zero and its note says so or it was posted with an amount."""
    return F.coalesce((total == 0) & (F.lower(F.coalesce(note, F.lit(""))).startswith("voided") | F.coalesce(posted > 0, F.lit(False))), F.lit(False))


def upsert(have: DataFrame, came: DataFrame, key: list[str], at: str) -> DataFrame:
    """Records by external key with the latest copy of each, what came later winning over what is held; ``came`` may repeat a key."""
    rows = have.withColumn("_new", F.lit(0)).unionByName(came.withColumn("_new", F.lit(1)))
    fields = [c for c in have.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(at, "_new", *[c for c in fields if c != at])).alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in fields])


def resolve_bills(payments: DataFrame, bills: DataFrame) -> DataFrame:
    """The document behind each bill that a payment names: org_id, payment_id, bill_id, doc_id (null where the bill isn't ours)."""
    named = payments.select("org_id", "payment_id", F.explode(F.array_distinct("bill_ids")).alias("bill_id"))
    ours = bills.groupBy("org_id", "bill_id").agg(F.min("doc_id").alias("doc_id"))
    return named.join(ours, ["org_id", "bill_id"], "left").select("org_id", "payment_id", "bill_id", "doc_id")


def expense_accounts(rows: DataFrame, mapping: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each vendor's expense account: its own, else the organisation's default, else none, with where it comes from."""
    own, org = mapping.select("org_id", "vendor_key", F.col("account").alias("_own")), defaults.select("org_id", F.col("account").alias("_org"))
    out = rows.join(own, ["org_id", "vendor_key"], "left").join(org, "org_id", "left")
    source = F.when(F.col("_own").isNotNull(), "vendor").when(F.col("_org").isNotNull(), "default").otherwise("none")
    return out.withColumns({"account": F.coalesce("_own", "_org"), "account_source": source}).drop("_own", "_org")


def apply_moves(placed: DataFrame, moves: DataFrame) -> DataFrame:
    """Where documents are once people moved them: the latest move counts over what was found; shipments left empty are no longer named.

    ``placed``: doc_id, shipment, method. ``moves``: doc_id, shipment, at.
    """
    last = moves.groupBy("doc_id").agg(F.max(F.struct("at", "shipment"))["shipment"].alias("_to"))
    rows = placed.join(last, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("_to", "shipment").alias("shipment"), F.when(F.col("_to").isNotNull(), "manual").otherwise(F.col("method")).alias("method"))


def known_vendors(docs: DataFrame) -> DataFrame:
    """The vendors of an organisation by key, with the name that its latest document prints."""
    named = docs.withColumn("vendor_key", keys.vendor_key("vendor_name")).filter("vendor_key <> ''")
    return named.groupBy("org_id", "vendor_key").agg(F.max_by("vendor_name", F.struct("received_on", "doc_id")).alias("name"))


def best_known(names: DataFrame, known: DataFrame, threshold: float = 90) -> DataFrame:
    """For each printed name the known vendor that it most resembles, at ``threshold`` (80 or more) or above: org_id, printed, vendor_key, score.

    Equal keys score 100, others the Indel ratio, or the token set ratio less 4 if that is more. Names meet under keys that lose no such pair: the
    rarest pairs of neighbouring characters for the two ratios of whole names, and the rarest words, by weight of letters, where one
    name's words are all, or nearly all, among the other's. Ties go to the key that sorts first.
    """
    a = names.select("org_id", "printed", keys.vendor_key("printed").alias("_k")).filter("_k <> ''").distinct()
    # distinct names are few beside the documents that print them, and are read many times
    a = materialise(a, "printed")
    small = a.select("org_id", F.col("_k").alias("s")).distinct()
    large = materialise(known.filter("vendor_key <> ''").select("org_id", F.col("vendor_key").alias("l")).distinct(), "known")
    once = {c: F.array_join(F.array_distinct(F.split(c, " ")), " ") for c in "sl"}

    def by_pieces(permille: int, texts: dict[str, Column]) -> DataFrame:
        x, y = (df.withColumn(f"{c}_p", fuzzy.pieces(F.concat(F.lit(" "), texts[c], F.lit(" ")))) for df, c in ((small, "s"), (large, "l")))
        return fuzzy.meet_by_pieces(x.withColumn("_lost", 2 * fuzzy.most_lost(F.length(texts["s"]), permille)), y, "_lost", ["org_id"])

    permille, set_permille = round(threshold * 10), min(round(threshold * 10) + 40, 1000)
    met = [by_pieces(permille, {c: F.col(c) for c in "sl"}), by_pieces(set_permille, once)]

    def by_words(one: DataFrame, other: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs whose common words make up ``set_permille`` of one name: its words beyond them have few letters, so the rarest that have more meet."""
        words = other.select("org_id", y, F.explode(F.array_distinct(F.split(y, " "))).alias("w"))
        count = words.groupBy("org_id", "w").agg(F.count(F.lit(1)).alias("c"))
        own = one.select("org_id", x, F.explode(F.array_distinct(F.split(x, " "))).alias("w")).join(count, ["org_id", "w"], "left")
        before = F.coalesce(F.sum(F.length("w")).over(Window.partitionBy("org_id", x).orderBy(F.coalesce("c", F.lit(0)), "w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spare = fuzzy.most_lost(F.length(x), set_permille)
        keyed = own.withColumn("_before", before).filter(F.col("_before") <= spare).select("org_id", x, "w")
        return keyed.join(words, ["org_id", "w"]).select("org_id", "s", "l").distinct()

    met += [by_words(small, large, "s", "l"), by_words(large, small, "l", "s")]
    pairs = materialise(reduce(DataFrame.unionByName, met).distinct(), "pairs")
    lengths = F.length("s") + F.length("l")
    score = F.when(F.col("s") == F.col("l"), 100.0).otherwise(F.greatest(F.lit(200.0) * fuzzy.common("s", "l") / lengths, fuzzy.token_set("s", "l") - 4))
    best = pairs.withColumn("score", score).filter(F.col("score") >= threshold).groupBy("org_id", "s").agg(F.min(F.struct((-F.col("score")).alias("n"), F.col("l").alias("vendor_key"))).alias("b"))
    return a.join(best.withColumnRenamed("s", "_k"), ["org_id", "_k"]).select("org_id", "printed", "b.vendor_key", (-F.col("b.n")).alias("score"))


def letterhead_vendor(docs: DataFrame, profiles: DataFrame, lines: int = 25, threshold: float = 90) -> DataFrame:
    """The vendor that a document's first lines resemble most, at ``threshold`` or above: org_id, doc_id, vendor_key, score.

    ``docs``: org_id, doc_id, text. ``profiles``: org_id, vendor_key. Keys of four characters and lines of three or more count. A line that is shorter than a
    key by more than two characters scores the ratio of both, any other the best ratio of the shorter with a stretch of the longer. Distinct
    lines are scored once, met by the rarest pairs of neighbouring characters; ties go to the key that sorts first.
    """
    permille, org = round(threshold * 10), ["org_id"]
    head = F.slice(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), 1, lines)
    printed = docs.select("org_id", "doc_id", F.explode(head).alias("_line")).select("org_id", "doc_id", keys.vendor_key("_line").alias("line")).filter(F.length("line") >= 3).distinct()
    names = profiles.filter(F.length("vendor_key") >= 4).select("org_id", F.col("vendor_key").alias("name")).distinct()
    texts, names = materialise(printed.select("org_id", "line").distinct(), "lines"), materialise(names, "names")

    def side(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select("org_id", F.col(column).alias(name)).withColumn(f"{name}_p", fuzzy.pieces(F.col(name)))

    def inside(one: DataFrame, x: str, other: DataFrame, y: str) -> DataFrame:
        """Pairs where the shorter text x may resemble a stretch of y: a lost character takes two pieces at most."""
        lost = 2 * F.floor(F.length("s") * (2000 - 2 * permille) / 1000).cast("int")
        met = fuzzy.meet_by_pieces(side(one, x, "s").withColumn("_lost", lost), side(other, y, "l"), "_lost", org)
        return met.filter(F.length("s") <= F.length("l")).select("org_id", F.col("s").alias(x), F.col("l").alias(y))

    near = fuzzy.similar_pairs(names, texts, "name", "line", threshold, org).select("org_id", "name", "line")
    short = F.length("line") < F.length("name") - 2
    pairs = inside(names, "name", texts, "line").unionByName(inside(texts, "line", names, "name")).unionByName(near).distinct()
    n, m, shared = F.length("name"), F.length("line"), F.col("_shared")
    pairs = pairs.withColumn("_shared", fuzzy.common("name", "line"))
    ratio = F.lit(200.0) * shared / (n + m)
    # no stretch shares more than the whole does, and the best one has that many characters at least
    pairs = pairs.filter(F.when(short, ratio).otherwise(F.lit(200.0) * shared / (F.least(n, m) + shared)) >= threshold)
    scored = pairs.withColumn("score", F.when(short, ratio).otherwise(fuzzy.partial("name", "line"))).filter(F.col("score") >= threshold)
    best = printed.join(scored, ["org_id", "line"]).groupBy("org_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "name")).alias("b"))
    return best.select("org_id", "doc_id", F.col("b.name").alias("vendor_key"), (-F.col("b.n")).alias("score"))


def reading_accuracy(fields: DataFrame, corrections: DataFrame, by: list[str]) -> DataFrame:
    """How often a value was read right: read, wrong (a person changed it) and missed (a person filled it in), and the share right.

    ``fields``: doc_id, name, value and ``by``. ``corrections``: doc_id, name, old, seq; the first one of a value tells what was read, and a
    correction that keeps the value but for case, commas and blanks is none.
    """
    first = corrections.groupBy("doc_id", "name").agg(F.min_by("old", "seq").alias("_old"), F.lit(True).alias("_changed"))

    def plain(c: str) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s,]", "")

    rows = fields.join(first, ["doc_id", "name"], "left").filter("value is not null or _changed")
    differs = F.coalesce("_changed", F.lit(False)) & (plain("_old") != plain("value"))
    missed = differs & (plain("_old") == "")
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n"), F.count_if(differs & ~missed).alias("wrong"), F.count_if(missed).alias("missed"), F.round(F.lit(100.0) * F.count_if(~differs) / n, 1).alias("accuracy"))


def recent_examples(corrections: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The last corrections of each vendor's field, which its profile keeps as examples, and how many there were."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("seq").desc()))
    rows = corrections.withColumn("_n", last)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("seq", "new")))), lambda x: x["new"]).alias("examples"), F.count(F.lit(1)).alias("n"))


def received(messages: DataFrame, known: DataFrame, allowed: DataFrame) -> DataFrame:
    """What becomes of each message: duplicate (its key was received before, here or earlier), refused (the sender isn't allowed), no attachments, or kept.

    ``messages``: org_id, message_key, seq, sender, n_kept. ``known``: org_id, message_key. ``allowed``: org_id, domain; an organisation without any allows all.
    """
    first = F.row_number().over(Window.partitionBy("org_id", "message_key").orderBy("seq"))
    rows = messages.withColumns({"_n": first, "domain": F.lower(F.substring_index("sender", "@", -1))})
    rows = rows.join(known.distinct().withColumn("_known", F.lit(True)), ["org_id", "message_key"], "left").join(allowed.distinct().withColumn("_ok", F.lit(True)), ["org_id", "domain"], "left")
    rows = rows.join(allowed.select("org_id").distinct().withColumn("_limits", F.lit(True)), "org_id", "left")
    outcome = F.when((F.col("_n") > 1) | F.col("_known"), "duplicate").when(F.col("_limits") & F.col("_ok").isNull(), "refused").when(F.col("n_kept") == 0, "no attachments").otherwise("kept")
    return rows.select("org_id", "message_key", "seq", outcome.alias("outcome"))


def archive_summary(children: DataFrame) -> DataFrame:
    """Each archive's or batch's children by what became of them. ``children``: parent_id, status."""
    groups = {"matched": ["matched", "posted"], "waiting": ["new", "processing", "needs_review"], "loose": ["unmatched", "open"], "failed": ["error"]}
    return children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status").isin(v)).alias(f"n_{k}") for k, v in groups.items()])


def journal_lines(lines: DataFrame) -> DataFrame:
    """Journal lines by account and vendor with the shipments that they cover, and whether any or all of them are estimates; zero lines are dropped.

    ``lines``: org_id, account, vendor_key, shipment_id, kind, amount_home. Shipments are counted and named up to the size of a set on one line.
    """
    estimate = F.col("kind") == "estimate"
    out = lines.filter("amount_home is not null").groupBy("org_id", "account", "vendor_key").agg(
        F.sum("amount_home").cast(money.MONEY).alias("amount"), F.count_distinct("shipment_id").alias("n_shipments"), F.bool_or(estimate).alias("any_estimate"), F.bool_and(estimate).alias("all_estimates")
    )
    return out.filter("amount <> 0")
