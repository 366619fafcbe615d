"""Report queries: counts, totals by currency, ageing, calendars, medians, queues, searches, paging, pair quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.functions import dates, money
from quaywise.operators import order, reports, workflow
from quaywise.sources import adapter

from .registry import Tables, query

_RATE = adapter.fx_sql()
_HOME = f"CASE WHEN currency = 'USD' THEN total ELSE CAST(round_even(total * {_RATE}, 2) AS DECIMAL(18,2)) END"


def _with_home(df):
    rate = adapter.fx_rate(F.col("currency"))
    return df.withColumn("rate", rate).withColumn("home", money.to_home("total", "currency", F.lit(adapter.HOME), F.col("rate")))


@query("SELECT org_id, status, count(*) AS n FROM invoices GROUP BY ALL", ("invoices",))
def status_counts(t: Tables):
    return t.invoices.groupBy("org_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT org_id, status, min(received_on) AS oldest, count(*) AS n FROM invoices WHERE status <> 'posted' GROUP BY ALL", ("invoices",))
def oldest_waiting(t: Tables):
    return t.invoices.filter("status <> 'posted'").groupBy("org_id", "status").agg(F.min("received_on").alias("oldest"), F.count(F.lit(1)).alias("n"))


@query("""SELECT shipment_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT CASE WHEN status = 'needs_review' THEN doc_id END) AS n_review,
    count(DISTINCT CASE WHEN priority = '1-URGENT' THEN vendor_name END) AS n_urgent_vendors FROM invoices GROUP BY shipment_id""", ("invoices",))  # fmt: skip
def conditional_distinct_counts(t: Tables):
    def distinct(test, c):
        return F.count_distinct(F.when(F.expr(test), F.col(c)))

    return t.invoices.groupBy("shipment_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), distinct("status = 'needs_review'", "doc_id").alias("n_review"), distinct("priority = '1-URGENT'", "vendor_name").alias("n_urgent_vendors")
    )


@query(f"""WITH s AS (SELECT org_id, shipment_id, currency, CAST(sum(CASE WHEN doc_type = 'credit_note' THEN -abs(total) ELSE total END) AS DECIMAL(18,2)) AS total
    FROM invoices WHERE doc_type IN ('freight_invoice','commercial_invoice','credit_note') GROUP BY ALL), h AS (SELECT *, {_HOME} AS home FROM s)
    SELECT org_id, shipment_id, string_agg(currency || '=' || CAST(total AS VARCHAR), ',' ORDER BY currency) AS totals,
    CASE WHEN count(home) = count(*) THEN CAST(sum(home) AS DECIMAL(18,2)) END AS home FROM h GROUP BY org_id, shipment_id""", ("invoices",))  # fmt: skip
def totals_by_currency_home(t: Tables):
    rows = reports.totals_by_currency(t.invoices.withColumn("rate", adapter.fx_rate(F.col("currency"))))
    listed = F.array_join(F.transform(F.map_entries("totals"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.withColumn("totals", listed)


@query(f"""WITH h AS (SELECT org_id, currency, total, {_HOME} AS home FROM invoices WHERE status <> 'posted')
    SELECT org_id, currency, CAST(sum(total) AS DECIMAL(18,2)) AS at_risk, CAST(sum(home) AS DECIMAL(18,2)) AS home, count(*) AS n FROM h GROUP BY org_id, currency""", ("invoices",))  # fmt: skip
def money_at_risk(t: Tables):
    rows = _with_home(t.invoices.filter("status <> 'posted'"))
    return rows.groupBy("org_id", "currency").agg(F.sum("total").cast(money.MONEY).alias("at_risk"), F.sum("home").cast(money.MONEY).alias("home"), F.count(F.lit(1)).alias("n"))


@query("""SELECT org_id, count(*) AS n, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'needs_review') AS n_review,
    min(received_on) FILTER (status <> 'posted') AS oldest, count(DISTINCT shipment_id) AS n_shipments FROM invoices GROUP BY org_id""", ("invoices",))  # fmt: skip
def portfolio(t: Tables):
    return t.invoices.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") == "needs_review").alias("n_review"),
        F.min(F.when(F.col("status") != "posted", F.col("received_on"))).alias("oldest"), F.count_distinct("shipment_id").alias("n_shipments"),
    )


@query("""WITH touched AS (SELECT DISTINCT object_id FROM audit WHERE action = 'error'), d AS (SELECT org_id, doc_id, doc_id % 500 AS o FROM invoices WHERE status = 'posted')
    SELECT org_id, count(*) AS n, CAST(round(100.0 * count(*) FILTER (o NOT IN (SELECT object_id FROM touched)) / count(*), 1) AS DOUBLE) AS straight_through FROM d GROUP BY org_id""", ("invoices", "audit"))  # fmt: skip
def straight_through(t: Tables):
    touched = t.audit.filter("action = 'error'").select("object_id").distinct().withColumn("hit", F.lit(1))
    posted = t.invoices.filter("status = 'posted'").withColumn("object_id", F.col("doc_id") % 500)
    rows = posted.join(touched, "object_id", "left")
    share = F.round(F.lit(100.0) * F.count_if(F.col("hit").isNull()) / F.count(F.lit(1)), 1)
    return rows.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), share.alias("straight_through"))


@query(f"""WITH b AS (SELECT org_id, doc_id, total, {_HOME} AS home, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE invoice_date + 30 END AS due FROM invoices WHERE status <> 'posted' AND doc_type = 'freight_invoice'),
    d AS (SELECT *, greatest(0, coalesce(DATE '{adapter.TODAY}' - due, 0)) AS late FROM b WHERE total > 0),
    k AS (SELECT *, CASE WHEN late <= 0 THEN 'current' WHEN late <= 30 THEN '1-30' WHEN late <= 60 THEN '31-60' WHEN late <= 90 THEN '61-90' ELSE '90+' END AS bucket FROM d),
    f AS (SELECT org_id, unnest(['current','1-30','31-60','61-90','90+']) AS bucket FROM (SELECT DISTINCT org_id FROM b)),
    s AS (SELECT f.org_id, f.bucket, count(home) AS n, CAST(coalesce(sum(home), 0) AS DECIMAL(18,2)) AS amount, count(*) FILTER (doc_id IS NOT NULL AND home IS NULL) AS unconverted FROM f LEFT JOIN k USING (org_id, bucket) GROUP BY ALL)
    SELECT *, CASE WHEN max(amount) OVER (PARTITION BY org_id) > 0 THEN CAST(round_even(CAST(100 * amount AS DOUBLE) / CAST(max(amount) OVER (PARTITION BY org_id) AS DOUBLE), 0) AS INT) ELSE 0 END AS share FROM s""", ("invoices",))  # fmt: skip
def ap_aging(t: Tables):
    bills = _with_home(t.invoices.filter("status <> 'posted' and doc_type = 'freight_invoice'")).withColumn("due_on", F.when(F.col("doc_id") % 17 != 0, F.date_add("invoice_date", 30)))
    return reports.ageing(bills.withColumn("amount", F.col("total")), adapter.TODAY)


@query(f"""WITH d AS (SELECT org_id, total, CAST(floor(date_diff('second', CAST(invoice_date AS TIMESTAMP), TIMESTAMP '{adapter.TODAY} 06:00:00') / 86400) AS BIGINT) AS days FROM invoices WHERE status = 'needs_review')
    SELECT org_id, CASE WHEN days <= 7 THEN '0-7' WHEN days <= 30 THEN '8-30' WHEN days <= 60 THEN '31-60' ELSE '61+' END AS bucket, count(*) AS n, CAST(sum(total) AS DECIMAL(18,2)) AS amount FROM d GROUP BY ALL""", ("invoices",))  # fmt: skip
def dispute_aging(t: Tables):
    days = dates.whole_days(F.col("invoice_date"), F.lit(f"{adapter.TODAY} 06:00:00"))
    rows = t.invoices.filter("status = 'needs_review'").withColumn("bucket", reports.bucket_of(days, reports.DISPUTE_BUCKETS))
    return rows.groupBy("org_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast(money.MONEY).alias("amount"))


_STATES = {"needs_review": 0, "open": 1, "posted": 2}


@query("""SELECT shipment_id, CASE min(CASE status WHEN 'needs_review' THEN 0 WHEN 'open' THEN 1 ELSE 2 END) WHEN 0 THEN 'needs_review' WHEN 1 THEN 'open' ELSE 'posted' END AS worst, count(*) AS n FROM invoices GROUP BY shipment_id""", ("invoices",))
def worst_state(t: Tables):
    return workflow.worst_state(t.invoices, ["shipment_id"], _STATES, "status")


@query("""SELECT d AS day, count(doc_id) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-01-14', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN invoices ON received_on = d GROUP BY d""", ("invoices",))
def dense_daily_counts(t: Tables):
    return reports.dense_days(t.invoices, "received_on", "2001-01-01", "2001-01-14", [F.count(F.lit(1)).alias("n")], ["n"])


@query(f"""WITH h AS (SELECT date_trunc('month', invoice_date) AS m, {_HOME} AS home FROM invoices WHERE invoice_date BETWEEN DATE '1996-03-15' AND DATE '2001-07-31'),
    c AS (SELECT CAST(unnest(generate_series(DATE '1996-03-01', DATE '2001-03-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT month, count(m) AS n, CAST(coalesce(sum(home), 0) AS DECIMAL(18,2)) AS home FROM c LEFT JOIN h ON m = month GROUP BY month""", ("invoices",))  # fmt: skip
def dense_monthly_savings(t: Tables):
    measures = [F.count(F.lit(1)).alias("n"), F.sum("home").cast(money.MONEY).alias("home")]
    out = reports.dense_months(_with_home(t.invoices), "invoice_date", "1996-03-15", "2001-07-31", measures, ["n"])
    return out.withColumn("home", F.coalesce("home", F.lit(0).cast(money.MONEY)))


@query("SELECT currency, CAST(sum(total) AS DECIMAL(18,2)) AS posted, count(*) AS n FROM invoices WHERE status = 'posted' GROUP BY currency", ("invoices",))
def posted_by_currency(t: Tables):
    return t.invoices.filter("status = 'posted'").groupBy("currency").agg(F.sum("total").cast(money.MONEY).alias("posted"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT vendor_name, total, row_number() OVER (PARTITION BY vendor_name ORDER BY total) AS i, count(*) OVER (PARTITION BY vendor_name) AS n FROM invoices)
    SELECT vendor_name, CAST(round_even(CAST(max(total) FILTER (i = (n + 1) // 2) + max(total) FILTER (i = n // 2 + 1) AS DECIMAL(18,2)) * 0.5, 2) AS DECIMAL(18,2)) AS median, max(n) AS n FROM r GROUP BY vendor_name""", ("invoices",))  # fmt: skip
def exact_decimal_median(t: Tables):
    return reports.median_by(t.invoices, ["vendor_name"], "total")


@query("""SELECT doc_id, status FROM invoices i WHERE contains(lower(vendor_name), ' 3 ') OR EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = i.doc_id AND contains(lower(l.description), ' 3 '))""", ("invoices", "lines"))
def search_semi(t: Tables):
    """Invoices whose vendor, or a line of which, has a text."""
    rows = t.invoices.select("org_id", F.col("doc_id").alias("shipment_id"), "vendor_name", "status")
    parts = t.lines.select(F.col("doc_id").alias("shipment_id"), "description").join(rows.select("org_id", "shipment_id"), "shipment_id")
    return workflow.search(rows, parts, " 3 ", ["vendor_name"], ["description"]).select(F.col("shipment_id").alias("doc_id"), "status")


def _bills(t: Tables):
    state = F.when(F.col("status") == "posted", "paid").when(F.col("doc_id") % 11 == 0, "partial").when(F.col("doc_id") % 13 == 0, "void").otherwise("unpaid")
    return t.invoices.select("shipment_id", state.alias("state"), F.date_add("invoice_date", 30).alias("due_on"))


@query("""WITH b AS (SELECT shipment_id, CASE WHEN status = 'posted' THEN 'paid' WHEN doc_id % 11 = 0 THEN 'partial' WHEN doc_id % 13 = 0 THEN 'void' ELSE 'unpaid' END AS state, invoice_date + 30 AS due FROM invoices), s AS (SELECT DISTINCT shipment_id FROM b)
    SELECT k AS filter, count(*) AS n FROM (
      SELECT 'unpaid' AS k, shipment_id FROM s WHERE shipment_id IN (SELECT shipment_id FROM b WHERE state IN ('unpaid','partial'))
      UNION ALL SELECT 'overdue', shipment_id FROM s WHERE shipment_id IN (SELECT shipment_id FROM b WHERE state IN ('unpaid','partial') AND due < DATE '2001-01-01')
      UNION ALL SELECT 'problem', shipment_id FROM s WHERE shipment_id IN (SELECT shipment_id FROM b WHERE state = 'void')
      UNION ALL SELECT 'paid', shipment_id FROM s WHERE shipment_id IN (SELECT shipment_id FROM b WHERE state = 'paid') AND shipment_id NOT IN (SELECT shipment_id FROM b WHERE state <> 'paid')) GROUP BY k""", ("invoices",))  # fmt: skip
def payment_filters_exists(t: Tables):
    bills, ships = _bills(t), t.invoices.select("shipment_id").distinct()
    out = None
    for key in ("unpaid", "overdue", "problem", "paid"):
        part = workflow.payment_filter(ships, bills, key, "2001-01-01").agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("filter"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM invoices WHERE status = 'needs_review' WINDOW w AS (PARTITION BY org_id ORDER BY total DESC, doc_id)""", ("invoices",))
def queue_neighbours(t: Tables):
    return workflow.neighbours(t.invoices.filter("status = 'needs_review'"), ["org_id"], [F.col("total").desc(), F.col("doc_id")], "doc_id").select("doc_id", "previous", "next")


@query("""WITH p AS (SELECT DISTINCT c_nationkey % 20 AS org_id, c_custkey AS member FROM customer),
    s AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY member) - 1 AS seat, count(*) OVER (PARTITION BY org_id) AS n, count(*) FILTER (member <= 50) OVER (PARTITION BY org_id) AS past FROM p),
    w AS (SELECT org_id, doc_id, row_number() OVER (PARTITION BY org_id ORDER BY doc_id) - 1 AS turn FROM invoices WHERE status = 'open')
    SELECT w.doc_id, s.member FROM w JOIN s ON s.org_id = w.org_id AND s.seat = (w.turn + s.past) % s.n""", ("invoices",))  # fmt: skip
def round_robin(t: Tables):
    pool = t.customer.select((F.col("c_nationkey") % 20).cast("long").alias("org_id"), F.col("c_custkey").alias("member")).distinct()
    return workflow.round_robin(t.invoices.filter("status = 'open'").select("org_id", "doc_id"), pool, ["org_id"], [F.col("doc_id")], last=50).select("doc_id", "member")


@query("""SELECT doc_id, total, received_on FROM invoices WHERE status = 'open' ORDER BY priority, total DESC, doc_id LIMIT 50 OFFSET 100""", ("invoices",))
def third_page(t: Tables):
    by = [F.col("priority"), F.col("total").desc(), F.col("doc_id")]
    return reports.page(t.invoices.filter("status = 'open'"), by, 3, 50).select("doc_id", "total", "received_on")


@query("""WITH g AS (SELECT shipment_id AS truth, doc_id % 1000000000 // 2 AS found FROM invoices), s AS (
    SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY truth)) AS t, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY found)) AS f,
           (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM g GROUP BY truth, found)) AS b)
    SELECT t::BIGINT AS true_pairs, f::BIGINT AS found_pairs, b::BIGINT AS shared_pairs, b / f AS precision, b / t AS recall FROM s""", ("invoices",))  # fmt: skip
def pair_precision_recall(t: Tables):
    groups = t.invoices.select(F.col("shipment_id").alias("truth"), F.expr("doc_id % 1000000000 div 2").alias("found"))
    return reports.pair_quality(groups, "truth", "found")


@query("""SELECT user_id AS actor_id, action, arg_min(amount, (seen_at, event_id)) AS first, arg_max(amount, (seen_at, event_id)) AS last, count(*) AS n FROM (SELECT actor_id AS user_id, * FROM audit) GROUP BY ALL""", ("audit",))
def first_last_correction(t: Tables):
    return reports.first_and_last(t.audit, ["actor_id", "action"], ["seen_at", "event_id"], "amount")


@query("""SELECT * FROM (SELECT event_id, actor_id, action, lag(action) OVER (PARTITION BY actor_id ORDER BY seen_at, event_id) AS before FROM audit) WHERE before IS DISTINCT FROM action""", ("audit",))
def status_transitions(t: Tables):
    return workflow.transitions(t.audit, ["actor_id"], ["seen_at", "event_id"], "action").select("event_id", "actor_id", "action", "before")


@query("""SELECT event_id, object_id, action FROM (SELECT *, row_number() OVER (PARTITION BY object_id, action ORDER BY seen_at, event_id) AS n FROM audit) WHERE n = 1""", ("audit",))
def event_dedupe(t: Tables):
    return workflow.once(t.audit, ["object_id", "action"], ["seen_at", "event_id"]).select("event_id", "object_id", "action")


@query("""SELECT actor_id, time_bucket(INTERVAL 60 MINUTE, seen_at) AS minute, count(*) AS n FROM audit GROUP BY ALL HAVING count(*) > 2""", ("audit",))
def rate_limit(t: Tables):
    return workflow.over_limit(t.audit, "actor_id", "seen_at", 2, 60)


@query("""SELECT CAST(json_extract_string(data, '$.k') AS INT) AS k, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM audit WHERE json_extract_string(data, '$.k') IS NOT NULL GROUP BY ALL""", ("audit",))
def json_props_access(t: Tables):
    k = F.get_json_object("data", "$.k").try_cast("int")
    return t.audit.withColumn("k", k).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(money.MONEY).alias("amount"))


@query("""SELECT CAST(timezone('America/New_York', timezone('UTC', seen_at)) AS DATE) AS day, action, count(*) AS n FROM audit GROUP BY ALL""", ("audit",))
def local_day_counts(t: Tables):
    return t.audit.groupBy(dates.local_day("seen_at", F.lit("America/New_York")).alias("day"), "action").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT e.*, l.quality AS human FROM (SELECT doc_id, lang, n_chars FROM documents) e JOIN labels l USING (doc_id))
    SELECT lang, count(*) AS n, count(*) FILTER ((n_chars >= 300) <> (human = 1)) AS wrong, CAST(round(100.0 * count(*) FILTER ((n_chars >= 300) = (human = 1)) / count(*), 1) AS DOUBLE) AS accuracy FROM e GROUP BY lang""")  # fmt: skip
def reading_accuracy(t: Tables):
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    right = (F.col("n_chars") >= 300) == (F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~right).alias("wrong"), F.round(F.lit(100.0) * F.count_if(right) / F.count(F.lit(1)), 1).alias("accuracy"))


@query("""SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, arg_min(text, turn) AS opening, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def mail_threads(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"), F.min_by("text", "turn").alias("opening"), F.max("turn").alias("last_turn"))


@query("""WITH r AS (SELECT vendor_name, currency, CAST(sum(total) AS DECIMAL(18,2)) AS caught FROM invoices WHERE status = 'needs_review' GROUP BY ALL) SELECT * FROM r ORDER BY caught DESC, vendor_name LIMIT 5""", ("invoices",))
def top_vendors(t: Tables):
    rows = t.invoices.filter("status = 'needs_review'").groupBy("vendor_name", "currency").agg(F.sum("total").cast(money.MONEY).alias("caught"))
    return rows.orderBy(F.col("caught").desc(), "vendor_name").limit(5)


@query("""WITH r AS (SELECT doc_id, total - lag(total) OVER (PARTITION BY vendor_name ORDER BY invoice_date, doc_id) AS change, sum(total) OVER (PARTITION BY vendor_name ORDER BY invoice_date, doc_id ROWS UNBOUNDED PRECEDING) AS balance FROM invoices)
    SELECT doc_id, CAST(change AS DECIMAL(18,2)) AS change, CAST(balance AS DECIMAL(18,2)) AS balance FROM r""", ("invoices",))  # fmt: skip
def running_balance(t: Tables):
    rows = order.placed(t.invoices.select("vendor_name", "invoice_date", "doc_id", "total"), ["vendor_name"], [F.col("invoice_date"), F.col("doc_id")], "total")
    rows = order.beside(rows, ["vendor_name"], {"total": "before"}, -1)
    return rows.select("doc_id", (F.col("total") - F.col("before")).cast(money.MONEY).alias("change"), F.col("upto").cast(money.MONEY).alias("balance"))
