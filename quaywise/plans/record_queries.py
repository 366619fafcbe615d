"""Queries of records read back, mail, corrections, vendors, accounts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.functions import keys, money, text
from quaywise.operators import allocation, close, exports, rates, records, reports, rules
from quaywise.sources import adapter

from .close_queries import _LINES, _PARTS, _parts, _report
from .registry import Tables, query
from .rule_queries import _CATCH, _OUTCOME, _VK
from .workflow_queries import _COMMON

_ACTIONS = ["document.received", "document.extracted", "shipment.approved", "shipment.rejected", "bill.posted", "vendor_credit.posted", "bill.failed", "vendor_credit.failed", "dispute.sent", "dispute.credit_received", "dispute.resolved", "dispute.closed", "dispute.overdue", "login", "mailbox.needs_reconnect", "qbo.needs_reconnect"]
_PUBLISHES = ["document.received", "document.extracted", "shipment.approved", "shipment.rejected", "bill.posted", "bill.posted", "bill.failed", "bill.failed", "dispute.sent", "dispute.credit_received", "dispute.resolved", "dispute.closed", "dispute.overdue", None, None, None]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _audit(t: Tables):
    action = F.get(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") % 16).cast("int"))
    return t.audit.select("event_id", (F.col("object_id") % 20).alias("org_id"), action.alias("action"))


@query(f"WITH e AS (SELECT event_id, {_list(_PUBLISHES)}[event_id % 16 + 1] AS type FROM audit) SELECT * FROM e WHERE type IS NOT NULL", ("audit",))
def event_types(t: Tables):
    return _audit(t).select("event_id", records.event_type("action").alias("type")).filter("type is not null")


@query(f"""WITH e AS (SELECT event_id, object_id % 20 AS org_id, CASE event_id % 16 WHEN 6 THEN 'bill.failed' WHEN 7 THEN 'bill.failed' WHEN 9 THEN 'dispute.credit_received' WHEN 12 THEN 'dispute.overdue' WHEN 14 THEN 'mailbox.reconnect' WHEN 15 THEN 'qbo.reconnect' END AS alert FROM audit),
    c AS (SELECT org_id, org_id * 10 + k AS channel_id, CASE k WHEN 0 THEN 'slack' WHEN 1 THEN 'email' ELSE 'own' END AS kind FROM (SELECT DISTINCT org_id FROM e), (SELECT unnest([0, 1, 2]) AS k)) SELECT e.org_id, event_id, channel_id, alert FROM e JOIN c USING (org_id) WHERE alert IS NOT NULL AND CASE kind WHEN 'slack' THEN true WHEN 'email' THEN alert IN ('qbo.reconnect', 'mailbox.reconnect') ELSE alert = 'bill.failed' END""", ("audit",))  # fmt: skip
def alert_channels(t: Tables):
    audit = _audit(t)
    kinds = F.explode(F.expr("array(struct(0 AS k, 'slack' AS kind, CAST(NULL AS array<string>) AS events), struct(1 AS k, 'email' AS kind, CAST(NULL AS array<string>) AS events), struct(2 AS k, 'slack' AS kind, array('bill.failed') AS events))")).alias("c")
    channels = audit.select("org_id").distinct().select("org_id", kinds).select("org_id", (F.col("org_id") * 10 + F.col("c.k")).alias("channel_id"), "c.kind", "c.events")
    return records.alerts(audit, channels)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 = 0 OR doc_id % 5 = 0 ELSE false END AS voided FROM invoices""", ("invoices",))
def voided_bills(t: Tables):
    total = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("total")).cast(money.MONEY)
    note = F.when(F.col("doc_id") % 6 == 0, "Voided - entered twice").when(F.col("doc_id") % 7 == 0, "paid")
    return t.invoices.select("doc_id", records.voided(total, note, F.when(F.col("doc_id") % 5 == 0, F.col("total"))).alias("voided"))


@query("""WITH h AS (SELECT doc_id % 400 AS ext, received_on AS paid_at, total, 0 AS n FROM invoices WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id % 400, received_on, total, 1 FROM invoices WHERE doc_id % 2 = 1) SELECT ext, arg_max(paid_at, (paid_at, n, total)) AS paid_at, arg_max(total, (paid_at, n, total)) AS total FROM h GROUP BY ext""", ("invoices",))
def payment_upsert(t: Tables):
    rows = t.invoices.select((F.col("doc_id") % 400).alias("ext"), F.col("received_on").alias("paid_at"), "total", "doc_id")
    return records.upsert(rows.filter("doc_id % 2 = 0").drop("doc_id"), rows.filter("doc_id % 2 = 1").drop("doc_id"), ["ext"], "paid_at")


@query("""WITH p AS (SELECT org_id, doc_id AS payment_id, unnest(['B' || doc_id, 'B' || (doc_id + 4), 'X']) AS bill_id FROM invoices WHERE status = 'posted'), b AS (SELECT org_id, 'B' || doc_id AS bill_id, doc_id FROM invoices WHERE doc_id % 3 <> 0) SELECT p.org_id, payment_id, p.bill_id, b.doc_id FROM p LEFT JOIN b ON b.org_id = p.org_id AND b.bill_id = p.bill_id""", ("invoices",))
def payment_bills(t: Tables):
    named = F.expr("array('B' || doc_id, 'B' || (doc_id + 4), 'X', 'X')")
    pays = t.invoices.filter("status = 'posted'").select("org_id", F.col("doc_id").alias("payment_id"), named.alias("bill_ids"))
    return records.resolve_bills(pays, t.invoices.filter("doc_id % 3 <> 0").select("org_id", F.concat(F.lit("B"), "doc_id").alias("bill_id"), "doc_id"))


@query(f"""SELECT doc_id, CASE WHEN {_VK} = 'harbor 3 logistics' THEN 'Ocean freight' WHEN org_id % 2 = 0 THEN 'Freight' END AS account, CASE WHEN {_VK} = 'harbor 3 logistics' THEN 'vendor' WHEN org_id % 2 = 0 THEN 'default' ELSE 'none' END AS account_source FROM invoices""", ("invoices",))
def expense_accounts(t: Tables):
    rows = t.invoices.select("org_id", "doc_id", keys.vendor_key("vendor_name").alias("vendor_key"))
    orgs = t.invoices.select("org_id").distinct()
    mapping = orgs.select("org_id", F.lit("harbor 3 logistics").alias("vendor_key"), F.lit("Ocean freight").alias("account"))
    return records.expense_accounts(rows, mapping, orgs.filter("org_id % 2 = 0").select("org_id", F.lit("Freight").alias("account"))).select("doc_id", "account", "account_source")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id + 2 WHEN doc_id % 9 = 0 THEN doc_id + 1 ELSE shipment_id END AS shipment, CASE WHEN doc_id % 6 = 0 OR doc_id % 9 = 0 THEN 'manual' ELSE 'exact_bl' END AS method FROM invoices""", ("invoices",))
def manual_moves(t: Tables):
    placed = t.invoices.select("doc_id", F.col("shipment_id").alias("shipment"), F.lit("exact_bl").alias("method"))
    moves = placed.filter("doc_id % 9 = 0").select("doc_id", (F.col("doc_id") + 1).alias("shipment"), F.lit(1).alias("at")).unionByName(placed.filter("doc_id % 6 = 0").select("doc_id", (F.col("doc_id") + 2).alias("shipment"), F.lit(2).alias("at")))
    return records.apply_moves(placed, moves)


@query(f"""SELECT org_id, {_VK} AS vendor_key, arg_max(vendor_name, (received_on, doc_id)) AS name FROM invoices GROUP BY ALL""", ("invoices",))
def known_vendors(t: Tables):
    return records.known_vendors(t.invoices)


#: How a known vendor is printed: with more words, with words in another order and a letter less, with a letter more, with a word less.
_AS_PRINTED = "CASE CAST({n} AS INT) % 4 WHEN 0 THEN 'Port Harbor ' || {n} || ' Logistics Ltd' WHEN 1 THEN 'LOGISTIC harbor ' || {n} WHEN 2 THEN 'Harbour ' || {n} || ' logistics' ELSE 'Logistics ' || {n} END"
_BARE = "CASE CAST({n} AS INT) % 4 WHEN 0 THEN 'port harbor ' || {n} || ' logistics' WHEN 1 THEN 'logistic harbor ' || {n} WHEN 2 THEN 'harbour ' || {n} || ' logistics' ELSE 'logistics ' || {n} END"


@query(f"""WITH k AS (SELECT DISTINCT org_id, {_VK} AS vk, regexp_extract(vendor_name, '[0-9]+') AS n FROM invoices), p AS (SELECT org_id, {_AS_PRINTED.format(n='n')} AS printed, {_BARE.format(n='n')} AS x FROM k),
    m AS (SELECT p.org_id, printed, x, vk, list_sort(list_distinct(string_split(x, ' '))) AS xs, list_sort(list_distinct(string_split(vk, ' '))) AS ys FROM p JOIN k USING (org_id)),
    w AS (SELECT *, list_filter(xs, lambda i: list_contains(ys, i)) AS c, list_filter(xs, lambda i: NOT list_contains(ys, i)) AS ox, list_filter(ys, lambda i: NOT list_contains(xs, i)) AS oy FROM m),
    s AS (SELECT org_id, printed, x, vk, len(c) > 0 AS met, len(c) > 0 AND (len(ox) = 0 OR len(oy) = 0) AS inside, array_to_string(c, ' ') AS cs, array_to_string(c || ox, ' ') AS wx, array_to_string(c || oy, ' ') AS wy FROM w),
    t AS (SELECT *, unnest([{{'a': x, 'b': vk, 'less': 0}}, {{'a': wx, 'b': wy, 'less': 4}}, {{'a': CASE WHEN met THEN cs END, 'b': wx, 'less': 4}}, {{'a': CASE WHEN met THEN cs END, 'b': wy, 'less': 4}}], recursive := true) FROM s),
    r AS (SELECT org_id, printed, vk, max(CASE WHEN x = vk THEN 100.0 WHEN inside AND less = 4 THEN 96.0 ELSE 200.0 * {_COMMON} / (length(a) + length(b)) - less END) AS score FROM t WHERE a IS NOT NULL GROUP BY ALL)
    SELECT org_id, printed, arg_min(vk, (-score, vk)) AS vendor_key, CAST(max(score) AS DOUBLE) AS score FROM r WHERE score >= 90 GROUP BY org_id, printed""", ("invoices",))  # fmt: skip
def best_known_vendors(t: Tables):
    """Vendors as statements print them, with words more, less or in another order and letters misread, among those known by their invoices."""
    known = records.known_vendors(t.invoices)
    printed = F.expr(_AS_PRINTED.format(n="regexp_extract(vendor_key, '[0-9]+', 0)"))
    return records.best_known(known.select("org_id", printed.alias("printed")), known)


@query(f"""SELECT i.org_id, doc_id, {_VK} AS vendor_key, CAST(CASE WHEN doc_id % 5 = 4 THEN 200.0 * (length({_VK}) - 1) / (2 * length({_VK})) ELSE 100 END AS DOUBLE) AS score FROM invoices i WHERE doc_id % 3 <> 0""", ("invoices",))
def letterheads(t: Tables):
    """Vendors found in first lines that hold more than their name, a fifth of them with a letter misread; other documents name none."""
    name = F.when(F.col("doc_id") % 5 == 4, F.regexp_replace("vendor_name", "(?i)harbor", "Harb0r")).otherwise(F.col("vendor_name"))
    texts = t.invoices.select("org_id", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("INVOICE\n"), name, F.lit(", Long Beach\nTotal 5"))).otherwise("INVOICE\nTotal").alias("text"))
    return records.letterhead_vendor(texts, records.known_vendors(t.invoices))


@query("""WITH f AS (SELECT doc_id, doc_type, 'total' AS name, CAST(total AS STRING) AS value FROM invoices UNION ALL SELECT doc_id, doc_type, 'number', number FROM invoices), c AS (SELECT *, CASE WHEN name = 'total' AND doc_id % 5 = 0 THEN 'w' WHEN name = 'number' AND doc_id % 7 = 0 THEN 'm' END AS how FROM f)
    SELECT doc_type, name, count(*) AS n, count(*) FILTER (how = 'w') AS wrong, count(*) FILTER (how = 'm') AS missed, CAST(round(100.0 * count(*) FILTER (how IS NULL) / count(*), 1) AS DOUBLE) AS accuracy FROM c GROUP BY doc_type, name""", ("invoices",))  # fmt: skip
def field_accuracy(t: Tables):
    pairs = F.explode(F.create_map(F.lit("total"), F.col("total").cast("string"), F.lit("number"), F.col("number"))).alias("name", "value")
    fields = t.invoices.select("doc_id", "doc_type", pairs)
    wrong = fields.filter("name = 'total' and doc_id % 5 = 0").select("doc_id", "name", F.lit("1.00").alias("old"), F.lit(1).alias("seq"))
    later = wrong.select("doc_id", "name", F.lit("2.00").alias("old"), F.lit(2).alias("seq"))
    same = fields.filter("name = 'number' and doc_id % 7 = 1").select("doc_id", "name", F.lower("value").alias("old"), F.lit(1).alias("seq"))
    missed = fields.filter("name = 'number' and doc_id % 7 = 0").select("doc_id", "name", F.lit("").alias("old"), F.lit(1).alias("seq"))
    return records.reading_accuracy(fields, wrong.unionByName(later).unionByName(same).unionByName(missed), ["doc_type", "name"])


@query(f"""WITH c AS (SELECT org_id, {_VK} AS vk, doc_id, number, row_number() OVER (PARTITION BY org_id, {_VK} ORDER BY doc_id DESC) AS i FROM invoices) SELECT org_id, vk AS vendor_key, string_agg(number, ',' ORDER BY doc_id) FILTER (i <= 10) AS examples, count(*) AS n FROM c GROUP BY org_id, vk""", ("invoices",))
def vendor_examples(t: Tables):
    rows = t.invoices.select("org_id", keys.vendor_key("vendor_name").alias("vendor_key"), F.col("doc_id").alias("seq"), F.col("number").alias("new"))
    return records.recent_examples(rows, ["org_id", "vendor_key"]).withColumn("examples", F.array_join("examples", ","))


@query("""WITH m AS (SELECT conv_id % 5 AS org_id, CAST(conv_id % 40 AS STRING) AS k, conv_id * 1000 + turn AS seq, turn % 3 AS kind FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY org_id, k ORDER BY seq) AS i FROM m)
    SELECT org_id, k AS message_key, seq, CASE WHEN i > 1 OR CAST(k AS INT) % 11 = 0 THEN 'duplicate' WHEN org_id < 2 AND kind = 1 THEN 'refused' WHEN kind = 2 THEN 'no attachments' ELSE 'kept' END AS outcome FROM r""")
def mail_received(t: Tables):
    c = t.conversations.select((F.col("conv_id") % 5).alias("org_id"), (F.col("conv_id") % 40).cast("string").alias("message_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("turn") % 3).alias("kind"))
    messages = c.select("org_id", "message_key", "seq", F.when(F.col("kind") == 1, "x@other.example").otherwise("y@Vendor.example").alias("sender"), F.when(F.col("kind") == 2, 0).otherwise(1).alias("n_kept"))
    known = messages.filter("cast(message_key as int) % 11 = 0").select("org_id", "message_key")
    allowed = messages.filter("org_id < 2").select("org_id", F.lit("vendor.example").alias("domain"))
    return records.received(messages, known, allowed)


@query("""SELECT shipment_id AS parent_id, count(*) AS n, count(*) FILTER (status = 'posted') AS n_matched, count(*) FILTER (status = 'needs_review') AS n_waiting, count(*) FILTER (status = 'open') AS n_loose, 0::BIGINT AS n_failed FROM invoices GROUP BY shipment_id""", ("invoices",))
def archive_summaries(t: Tables):
    return records.archive_summary(t.invoices.select(F.col("shipment_id").alias("parent_id"), "status"))


@query("""SELECT event_id, action FROM audit WHERE json_extract_string(data, '$.k') = '7'""", ("audit",))
def batch_read_back(t: Tables):
    return t.audit.filter(F.get_json_object("data", "$.k") == "7").select("event_id", "action")


@query("""WITH h AS (SELECT org_id, CAST(received_on - invoice_date AS INT) * 24 + CAST(doc_id % 24 AS INT) AS hours FROM invoices WHERE status = 'posted'), r AS (SELECT org_id, hours, row_number() OVER (PARTITION BY org_id ORDER BY hours) AS i, count(*) OVER (PARTITION BY org_id) AS n FROM h)
    SELECT org_id, CAST(round_even((max(hours) FILTER (i = (n + 1) // 2) + max(hours) FILTER (i = n // 2 + 1)) / 2.0, 2) AS DECIMAL(18,2)) AS hours, max(n) AS n FROM r GROUP BY org_id""", ("invoices",))  # fmt: skip
def cycle_hours(t: Tables):
    hours = (F.datediff("received_on", "invoice_date") * 24 + F.col("doc_id") % 24).cast(money.MONEY)
    return reports.median_by(t.invoices.filter("status = 'posted'").select("org_id", hours.alias("h")), ["org_id"], "h", "hours")


@query(f"""WITH {_LINES}, j AS (SELECT org_id, account, vendor_key, CAST(sum(amount_home) AS DECIMAL(18,2)) AS amount, count(DISTINCT shipment_id) AS n_shipments, bool_or(kind = 'estimate') AS any_estimate, bool_and(kind = 'estimate') AS all_estimates FROM ln WHERE amount_home IS NOT NULL GROUP BY org_id, account, vendor_key) SELECT * FROM j WHERE amount <> 0""", ("invoices",))
def journal_lines(t: Tables):
    return records.journal_lines(_report(t))


@query("""WITH p AS (SELECT l_suppkey % 20 AS org, l_partkey AS product, row_number() OVER (PARTITION BY l_suppkey % 20, l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, CAST(l_extendedprice AS DECIMAL(18,2)) DESC) AS nth, (CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT) * 20000 + CAST(CAST(l_quantity AS DECIMAL(18,2)) * 100 AS HUGEINT)) // (2 * CAST(CAST(l_quantity AS DECIMAL(18,2)) * 100 AS HUGEINT)) AS u FROM lineitem)
    SELECT org AS org_id, product, string_agg(CAST(u AS STRING), ',' ORDER BY nth DESC) AS points FROM p WHERE nth <= 12 GROUP BY org, product""")  # fmt: skip
def unit_cost_points(t: Tables):
    rows = t.lineitem.selectExpr("l_suppkey % 20 AS org_id", "l_partkey AS product", "l_shipdate AS day", "struct(l_orderkey * 10 + l_linenumber AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS v) AS landed_id", "CAST(l_quantity AS DECIMAL(18,2)) AS quantity", "CAST(l_extendedprice AS DECIMAL(18,2)) AS landed")
    points = allocation.last_points(rows, 12)
    return points.select("org_id", "product", F.array_join(F.transform("points", lambda u: (u * 10000).cast("bigint").cast("string")), ",").alias("points"))


@query(f"""WITH {_PARTS}, v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.9 WHEN 2 THEN 0.65 WHEN 3 THEN 0.3 ELSE 1.0 END AS c, CASE doc_id % 7 WHEN 0 THEN 'received' WHEN 1 THEN 'manual' WHEN 2 THEN 'none' ELSE 'quote' END AS m FROM invoices)
    SELECT doc_id, CASE WHEN m = 'received' THEN 'Actual' WHEN m = 'manual' THEN 'Set by a person' WHEN c IS NULL OR m = 'none' THEN 'None' WHEN c >= 0.8 THEN 'High' WHEN c >= 0.55 THEN 'Medium' ELSE 'Low' END AS label FROM v""", ("invoices", "lines"))  # fmt: skip
def confidence_labels(t: Tables):
    value = F.when(F.col("doc_id") % 5 == 1, 0.9).when(F.col("doc_id") % 5 == 2, 0.65).when(F.col("doc_id") % 5 == 3, 0.3).when(F.col("doc_id") % 5 == 4, 1.0)
    method = F.when(F.col("doc_id") % 7 == 0, "received").when(F.col("doc_id") % 7 == 1, "manual").when(F.col("doc_id") % 7 == 2, "none").otherwise("quote")
    return t.invoices.select("doc_id", close.confidence_label(value, method).alias("label"))


@query(f"""WITH {_OUTCOME} SELECT catch_id, code, outcome, caught, CAST(prevented + at_risk + accepted AS DECIMAL(18,2)) AS counted, CAST(date_trunc('month', month) AS DATE) AS month, CASE WHEN vendor LIKE '=%' THEN '''' || vendor ELSE vendor END AS vendor FROM outc WHERE outcome <> 'withdrawn'""", ("invoices",))
def savings_export(t: Tables):
    return exports.savings(rates.outcomes(t.invoices.selectExpr(*[f"{e} AS {c}" for c, e in _CATCH.items()])))


_LETTER = "'Harbor ' || CAST(doc_id % 5 AS STRING) || ' LLC' || chr(10) || 'Invoice No: INV-' || CAST(doc_id AS STRING) || chr(10) || 'P.O. No 45-' || CAST(doc_id % 9 AS STRING) || ', PO# 7' || chr(10) || 'Total' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'EUR 5' ELSE '$ 5' END"


@query("""SELECT doc_id, 'INV-' || doc_id AS number, CASE WHEN doc_id % 2 = 0 THEN 'EUR 5' ELSE '$ 5' END AS total, 'Harbor ' || (doc_id % 5) || ' LLC' AS company, '45' || (doc_id % 9) || ',7' AS pos, CASE WHEN doc_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM invoices""", ("invoices",))
def label_values(t: Tables):
    body = F.expr(_LETTER)
    return t.invoices.select("doc_id", text.label_value(body, "invoice no").alias("number"), text.label_value(body, "total").alias("total"), text.company_line(body).alias("company"), F.array_join(text.po_numbers(body), ",").alias("pos"), text.currency_of(body).alias("currency"))


@query(f"""WITH ls AS (SELECT doc_id, CAST(sum(amount) AS DECIMAL(18,2)) AS s FROM lines GROUP BY doc_id), i AS (SELECT org_id, 'total_mismatch:' || doc_id || ':' AS fingerprint, doc_id, CAST(total - s AS DECIMAL(18,2)) AS over FROM invoices JOIN ls USING (doc_id) WHERE abs(total - s) > 0.02)
    SELECT org_id, fingerprint, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(10 AS DECIMAL(18,2)) END AS amount, 'rates' AS reason FROM i WHERE doc_id % 3 = 0 OR doc_id % 3 = 1""", ("invoices", "lines"))  # fmt: skip
def rate_rechecks(t: Tables):
    """Of the issues before, a third is gone with the new rates, a third has another amount and a third stays."""
    before = rules.total_mismatch(t.invoices, t.lines)
    after = before.filter("doc_id % 3 <> 0").withColumn("amount_at_risk", F.when(F.col("doc_id") % 3 == 1, F.lit(10).cast(money.MONEY)).otherwise(F.col("amount_at_risk")))
    return rates.recheck(before, after, F.lit(1)).drop("seq")
