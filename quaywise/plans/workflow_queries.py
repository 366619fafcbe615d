"""Workflow, payments, intake and event queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import keys, money, places
from quaywise.operators import order, rates, reports, search, statements, workflow
from quaywise.sources import adapter, files
from quaywise.sources.scratch import scratch
from quaywise.streaming import events

from .registry import Tables, query
from .rule_queries import _VK


@query(f"""SELECT o_orderkey AS quote_id, CASE WHEN o_orderkey % 9 = 0 THEN 'archived' WHEN CAST(o_orderdate AS DATE) > DATE '2001-01-01' THEN 'upcoming' WHEN CAST(o_orderdate AS DATE) + 365 < DATE '2001-01-01' THEN 'expired' ELSE 'current' END AS status FROM orders""")
def quote_status(t: Tables):
    start, today = F.col("o_orderdate").cast("date"), F.lit("2001-01-01").cast("date")
    chain = F.when(F.col("o_orderkey") % 9 == 0, "archived").when(start > today, "upcoming").when(F.date_add(start, 365) < today, "expired").otherwise("current")
    return t.orders.select(F.col("o_orderkey").alias("quote_id"), chain.alias("status"))


@query("""SELECT org_id, CAST(date_trunc('month', CAST(timezone('America/New_York', timezone('UTC', seen_at)) AS DATE)) AS DATE) AS month, count(*) AS n, 110 AS hard_limit, count(*) >= 110 AS reached FROM (SELECT *, object_id % 20 AS org_id FROM audit) GROUP BY ALL""", ("audit",))
def usage_metering(t: Tables):
    return reports.usage(t.audit.withColumn("org_id", F.col("object_id") % 20), "seen_at", "America/New_York", 100)


@query("""WITH s AS (SELECT doc_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS assigned FROM lines GROUP BY doc_id) SELECT doc_id, n, assigned, total FROM s JOIN invoices USING (doc_id) WHERE n < 2 OR assigned <> total""", ("invoices", "lines"))
def broken_splits(t: Tables):
    sums = t.lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(money.MONEY).alias("assigned"))
    return sums.join(t.invoices.select("doc_id", "total"), "doc_id").filter("n < 2 or assigned <> total")


@query("""WITH c AS (SELECT shipment_id, equipment, count(*) AS n FROM invoices WHERE equipment IS NOT NULL GROUP BY ALL), r AS (SELECT shipment_id, max(n) AS top, count(*) FILTER (n = m) AS ties, arg_max(equipment, n) AS e FROM (SELECT *, max(n) OVER (PARTITION BY shipment_id) AS m FROM c) GROUP BY shipment_id)
    SELECT shipment_id, CASE WHEN ties = 1 THEN e END AS equipment FROM r""", ("invoices",))  # fmt: skip
def equipment_mode(t: Tables):
    rows = t.invoices.filter("equipment is not null").groupBy("shipment_id").agg(F.collect_list("equipment").alias("e"))
    return rows.select("shipment_id", places.dominant(F.col("e")).alias("equipment"))


@query("""SELECT vendor_name, CASE WHEN count(*) FILTER (day(invoice_date) > 12) > count(*) FILTER (doc_id % 3 = 0) THEN 'dmy' WHEN count(*) FILTER (day(invoice_date) > 12) < count(*) FILTER (doc_id % 3 = 0) THEN 'mdy' END AS date_order FROM invoices GROUP BY vendor_name""", ("invoices",))
def date_order_vote(t: Tables):
    first, second = F.count_if(F.day("invoice_date") > 12), F.count_if(F.col("doc_id") % 3 == 0)
    return t.invoices.groupBy("vendor_name").agg(F.when(first > second, "dmy").when(first < second, "mdy").alias("date_order"))


_BALANCE = """CASE WHEN (doc_id % 37) % 2 = 0 THEN amount ELSE CAST(sum(amount) OVER (PARTITION BY doc_id % 37, year(invoice_date), month(invoice_date) ORDER BY doc_id) AS DECIMAL(18,2)) END"""
#: A statement of a vendor and month.
_STATEMENT = "doc_id % 37 * 1000000 + year(invoice_date) * 100 + month(invoice_date)"


@query(f"""WITH i AS (SELECT {_STATEMENT} AS statement_id, invoice_date, doc_id AS position, CASE WHEN doc_type = 'credit_note' THEN 'credit' ELSE 'invoice' END AS kind, CASE WHEN doc_type = 'credit_note' THEN -total ELSE total END AS amount, doc_id FROM invoices),
    b AS (SELECT *, {_BALANCE} AS balance FROM i), f AS (SELECT *, abs(coalesce(lag(balance) OVER (PARTITION BY statement_id ORDER BY position), 0) + amount - balance) <= 0.01 AS fits FROM b),
    g AS (SELECT *, count(*) OVER w >= 2 AND count(*) FILTER (fits) OVER w < 0.6 * count(*) OVER w AS shows_open FROM f WINDOW w AS (PARTITION BY statement_id))
    SELECT statement_id, position, kind, CAST(CASE WHEN shows_open THEN CASE WHEN kind = 'invoice' THEN abs(balance) ELSE -abs(balance) END ELSE amount END AS DECIMAL(18,2)) AS amount, shows_open FROM g""", ("invoices",))  # fmt: skip
def statement_open_amounts(t: Tables):
    kind = F.when(F.col("doc_type") == "credit_note", "credit").otherwise("invoice")
    rows = t.invoices.withColumn("amount", F.when(F.col("doc_type") == "credit_note", -F.col("total")).otherwise(F.col("total")).cast(money.MONEY))
    rows = rows.select(F.expr(_STATEMENT).alias("statement_id"), F.col("doc_id").alias("position"), kind.alias("kind"), "amount", F.expr(_BALANCE).alias("balance"))
    return statements.open_amounts(rows)


@query(f"""WITH k AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d AS today, p AS period, CAST(CASE p WHEN 'this_month' THEN date_trunc('month', d) WHEN 'last_month' THEN date_trunc('month', d) - INTERVAL 1 MONTH WHEN 'last_90' THEN d - 89 WHEN 'this_year' THEN date_trunc('year', d) ELSE date_trunc('month', d) - INTERVAL 11 MONTH END AS DATE) AS first_day,
    CAST(CASE p WHEN 'last_month' THEN date_trunc('month', d) - INTERVAL 1 DAY ELSE d END AS DATE) AS last_day FROM k, (SELECT unnest(['this_month','last_month','last_90','this_year','last_12']) AS p)""")  # fmt: skip
def period_ranges(t: Tables):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("today")).distinct()
    names = ["this_month", "last_month", "last_90", "this_year", "last_12"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), rates.period(n, F.col("today"))[0].alias("first_day"), rates.period(n, F.col("today"))[1].alias("last_day")) for n in names])).alias("p")
    return days.select("today", each).select("today", "p.*")


@query("""WITH v AS (SELECT p_partkey AS k, p_size * 10 AS n, 15 AS mt, 4 AS mw, 30 AS hc, 3 AS es, CAST(p_retailprice AS DECIMAL(18,2)) AS ov, 499 AS price FROM part), g AS (SELECT *, CAST(n * 11 * 30 AS HUGEINT) AS l5, CAST(n * 12 * 3 * ov * 100 AS HUGEINT) AS o4 FROM v)
    SELECT k, CAST((n * 11 * 10 * 2 + 60) // 120 AS DECIMAL(18,0)) / 10 AS hours_month, CAST((l5 * 2 + 5) // 10 AS DECIMAL(18,0)) AS labor, CAST((o4 * 2 + 10000) // 20000 AS DECIMAL(18,0)) AS overcharges, CAST(5988 AS DECIMAL(18,0)) AS cost FROM g""")  # fmt: skip
def roi_calculator(t: Tables):
    def d(x: str):
        return F.lit(x).cast("decimal(12,2)")

    rows = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") * 10).cast("decimal(12,0)").alias("invoices"), d("15").alias("minutes_today"), d("4").alias("minutes_with"), d("30").alias("hourly_cost"), d("3").alias("error_share"), F.col("p_retailprice").cast("decimal(12,2)").alias("avg_overcharge"), d("499").alias("price"))
    return reports.roi(rows).select("k", F.col("hours_month").cast("double").alias("hours_month"), "labor", "overcharges", "cost")


@query("""WITH b AS (SELECT doc_id, total, CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN total WHEN 2 THEN total / 2 END AS DECIMAL(18,2)) AS due FROM invoices) SELECT doc_id, CASE WHEN due <= 0 AND total > 0 THEN 'paid' WHEN due > 0 AND due < total THEN 'partly_paid' ELSE 'unpaid' END AS state FROM b""", ("invoices",))
def bill_states(t: Tables):
    due = F.when(F.col("doc_id") % 4 == 0, F.lit(0)).when(F.col("doc_id") % 4 == 1, F.col("total")).when(F.col("doc_id") % 4 == 2, F.col("total") / 2).cast(money.MONEY)
    return t.invoices.select("doc_id", statements.bill_state(F.col("total"), due).alias("state"))


@query("""SELECT doc_id FROM invoices WHERE status <> 'posted' OR (invoice_date >= DATE '2001-08-01' - 90 AND received_on + CAST(doc_id % 14 AS INT) < DATE '2001-08-01' - 7)""", ("invoices",))
def payment_recheck(t: Tables):
    """Open bills always; paid ones weekly for ninety days."""
    today = F.lit(adapter.TODAY).cast("date")
    stale = F.date_add("received_on", (F.col("doc_id") % 14).cast("int")) < F.date_sub(today, 7)
    return t.invoices.filter((F.col("status") != "posted") | ((F.col("invoice_date") >= F.date_sub(today, 90)) & stale)).select("doc_id")


@query("""SELECT event_id, CASE action WHEN 'signup' THEN 'shipment.created' WHEN 'purchase' THEN 'shipment.posted' ELSE 'document.failed' END AS type, '{"id":' || event_id || ',"type":"' || CASE action WHEN 'signup' THEN 'shipment.created' WHEN 'purchase' THEN 'shipment.posted' ELSE 'document.failed' END || '","object":' || object_id || ',"amount":' || amount || '}' AS payload FROM audit WHERE action IN ('signup','purchase','error')""", ("audit",))
def events_published(t: Tables):
    return events.published(t.audit).select("event_id", "type", "payload")


@query("""SELECT conv_id, arg_min(role, turn) AS author, count(*) - 1 AS n_replies, coalesce(string_agg(CASE WHEN turn > 0 THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn), '') AS replies FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY conv_id""")
def comment_threads(t: Tables):
    c = t.conversations
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), F.col("turn").alias("at"), F.col("text").alias("body"), "conv_id", "role")
    out = workflow.threads(rows)
    replies = F.coalesce("replies", F.array().cast("array<struct<at:int,comment_id:bigint,body:string>>"))
    return out.select("conv_id", F.col("role").alias("author"), F.size(replies).cast("long").alias("n_replies"), F.array_join(F.transform(replies, lambda r: r["at"].cast("string")), ",").alias("replies"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN status = 'open' THEN 'not reviewed' END, CASE WHEN currency = 'AED' THEN 'no exchange rate' END, CASE WHEN total > 400000 THEN 'above the limit' END], lambda x: x IS NOT NULL), ',') AS blocked FROM invoices""", ("invoices",))
def approval_blockers(t: Tables):
    reasons = {"not reviewed": F.col("status") == "open", "no exchange rate": F.col("currency") == "AED", "above the limit": F.col("total") > 400_000}
    return workflow.blockers(t.invoices, reasons).select("doc_id", F.array_join("blocked", ",").alias("blocked"))


@query("""SELECT text_hash AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY ALL""")
def content_dedupe(t: Tables):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    n = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    return files.first_by_content(rows, [], "doc_id", "doc_id").join(n, "sha256").select("sha256", "doc_id", "n")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'id-' || conv_id || '-' || turn || '@x' ELSE 'sha256:' || sha256(text) END AS key FROM conversations""")
def message_keys(t: Tables):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<id-"), "conv_id", F.lit("-"), "turn", F.lit("@x>"))).when(F.col("turn") % 3 == 1, F.lit("has blanks in it"))
    return t.conversations.select("conv_id", "turn", files.message_key(raw, F.col("text")).alias("key"))


@query("""SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'not downloaded' WHEN n_chars % 5 = 0 THEN 'empty' WHEN doc_id % 2 = 0 AND n_chars * 10 <= 6144 THEN 'tiny image' WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 AND n_chars * 10 <= 102400 THEN 'inline image' END AS reason FROM documents""")
def attachment_rules(t: Tables):
    size = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("n_chars") % 5 == 0, 0).otherwise(F.col("n_chars") * 10)
    kind = F.when(F.col("doc_id") % 2 == 0, "png").otherwise("pdf")
    return t.documents.select("doc_id", files.skip_reason(F.lit("a"), kind, size, F.col("doc_id") % 4 == 0).alias("reason"))


@query("""SELECT object_id, string_agg(DISTINCT CAST(actor_id AS VARCHAR), ',' ORDER BY CAST(actor_id AS VARCHAR)) AS makers FROM audit WHERE action IN ('click', 'purchase') GROUP BY object_id""", ("audit",))
def shipment_makers(t: Tables):
    rows = t.audit.filter("action in ('click', 'purchase')").groupBy("object_id")
    return rows.agg(F.array_join(F.array_sort(F.collect_set(F.col("actor_id").cast("string"))), ",").alias("makers"))


@query("""SELECT event_id, action FROM audit WHERE (object_id < 100 OR actor_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AND starts_with(action, 'p') AND contains(data, '7')""", ("audit",))
def audit_filter(t: Tables):
    members = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("actor_id")).distinct().withColumn("member", F.lit(True))
    rows = t.audit.filter(F.startswith("action", F.lit("p")) & F.contains("data", F.lit("7"))).join(members, "actor_id", "left")
    return rows.filter((F.col("object_id") < 100) | F.coalesce("member", F.lit(False))).select("event_id", "action")


@query("""SELECT doc_id, 100 * total / max(total) OVER (PARTITION BY org_id) > 50 AS large, row_number() OVER (PARTITION BY org_id ORDER BY total DESC, doc_id) AS place FROM invoices QUALIFY place <= 12""", ("invoices",))
def largest_of_each_org(t: Tables):
    w = Window.partitionBy("org_id")
    rows = t.invoices.withColumns({"large": 2 * F.col("total") > F.max("total").over(w), "place": F.row_number().over(w.orderBy(F.col("total").desc(), "doc_id"))})
    return rows.filter("place <= 12").select("doc_id", "large", F.col("place").cast("long").alias("place"))


#: SQL: the length of the longest common subsequence of texts a and b, a row of the table for each character of b.
_COMMON = """list_extract(list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda row, y: list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]),
    lambda acc, x: list_append(acc, CASE WHEN a[x[1]] = b[y[1]] THEN row[x[1]] + 1 ELSE greatest(acc[x[1]], row[x[1] + 1]) END), [0::BIGINT]), list_resize([0::BIGINT], length(a) + 1, 0)), -1)"""


@query(f"""WITH k AS (SELECT DISTINCT {_VK} AS k FROM invoices), p AS (SELECT x.k AS a, y.k AS b FROM k x JOIN k y ON x.k < y.k), l AS (SELECT a, b, {_COMMON} AS l FROM p) SELECT a, b, CAST(200.0 * l / (length(a) + length(b)) AS DOUBLE) AS ratio FROM l WHERE 2000 * l >= 920 * (length(a) + length(b))""", ("invoices",))
def vendor_near_names(t: Tables):
    """Vendor keys that read alike (Indel ratio of 92), from distinct keys only."""
    from quaywise.functions import fuzzy

    names = t.invoices.select(keys.vendor_key("vendor_name").alias("k")).distinct()
    pairs = fuzzy.similar_pairs(names.withColumnRenamed("k", "a"), names.withColumnRenamed("k", "b"), "a", "b", 92)
    return pairs.filter("a < b")


_ORGS = """o AS (SELECT org_id, 'Org ' || chr(CAST(65 + (org_id * 7) % 26 AS INT)) AS organization, org_id % 6 = 1 AS locked, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'open') AS ready, CAST(sum(CASE WHEN org_id % 4 <> 0 THEN total END) AS DECIMAL(18,2)) AS at_risk FROM invoices GROUP BY org_id), a AS (SELECT *, needs_review + ready AS attention FROM o)"""


@query(f"""WITH {_ORGS} SELECT 'attention' AS sort, org_id, row_number() OVER (ORDER BY locked, attention DESC, lower(organization), org_id) AS place FROM a UNION ALL SELECT 'at_risk', org_id, row_number() OVER (ORDER BY locked, coalesce(at_risk, 0) DESC, lower(organization) DESC, org_id) FROM a
    UNION ALL SELECT 'organization', org_id, row_number() OVER (ORDER BY locked, lower(organization), org_id) FROM a""", ("invoices",))  # fmt: skip
def portfolio_sorts(t: Tables):
    """The portfolio by attention, by money at risk (organisations without any last) and by name; locked organisations come last in each."""
    rows = t.invoices.groupBy("org_id").agg(F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(F.col("status") == "open").alias("ready"), F.sum(F.when(F.col("org_id") % 4 != 0, F.col("total"))).cast("decimal(18,2)").alias("at_risk"))
    letter = F.char((F.lit(65) + (F.col("org_id") * 7) % 26).cast("int"))
    rows = rows.withColumns({"organization": F.concat(F.lit("Org "), letter), "locked": F.col("org_id") % 6 == 1, "attention": F.col("needs_review") + F.col("ready")})
    sorts = [order.placed(rows, [], [*workflow.portfolio_order(k), F.col("org_id").asc()]).select(F.lit(k or "attention").alias("sort"), "org_id", "place") for k in (None, "at_risk", "organization")]
    return reduce(DataFrame.unionByName, sorts)


@query("""WITH r AS (SELECT DISTINCT org_id, shipment_id FROM invoices WHERE status = 'needs_review'), u AS (SELECT DISTINCT org_id, shipment_id FROM invoices WHERE priority = '1-URGENT'), a AS (SELECT DISTINCT org_id, shipment_id FROM invoices WHERE doc_id % 5 = 0)
    SELECT 'either' AS queue, * FROM (SELECT * FROM r UNION SELECT * FROM u) UNION ALL SELECT 'both', * FROM (SELECT * FROM r INTERSECT SELECT * FROM u) UNION ALL SELECT 'unassigned', * FROM (SELECT * FROM r EXCEPT SELECT * FROM a)""", ("invoices",))  # fmt: skip
def queue_sets(t: Tables):
    """Shipments in the review or the urgent queue, in both, and in review without anybody assigned."""
    on = ["org_id", "shipment_id"]
    review, urgent, assigned = (t.invoices.filter(c).select(*on) for c in ("status = 'needs_review'", "priority = '1-URGENT'", "doc_id % 5 = 0"))
    sets = {"either": review.union(urgent).distinct(), "both": review.intersect(urgent), "unassigned": review.subtract(assigned)}
    return reduce(DataFrame.unionByName, [s.select(F.lit(k).alias("queue"), *on) for k, s in sets.items()])


@query("""SELECT doc_id, number, vendor_name FROM invoices WHERE contains(lower(number), 'v-17') OR contains(lower(vendor_name), 'v-17') UNION ALL SELECT doc_id, number, vendor_name FROM invoices WHERE contains(lower(number), 'oR 3 lOG') OR contains(lower(vendor_name), 'or 3 log')""", ("invoices",))
def indexed_search(t: Tables):
    """Documents whose number or vendor has a text, through the index: one text of numbers, one of names."""
    rows, columns = t.invoices.select("doc_id", "number", "vendor_name"), ["number", "vendor_name"]
    postings = search.write_text_postings(rows, columns, scratch(t.spark, "postings"))
    return search.find_by_text(rows, postings, columns, "V-17").unionByName(search.find_by_text(rows, postings, columns, "oR 3 lOG"))
