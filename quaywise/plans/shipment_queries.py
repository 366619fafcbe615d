"""Queries of open charge groups, shared invoices, exports, disputes, entries, free time, statements, landed inputs and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.functions import charges, keys, money, text
from quaywise.operators import accruals, allocation, close, customs, disputes, exports, grouping, rules, shared, statements, versions, workflow
from quaywise.sources import adapter
from quaywise.sources.scratch import materialise

from .close_queries import _END, _EXPECTED, _PARTS, _SHIP, _parts, _statement
from .registry import Tables, query
from .rule_queries import _CHECK, _CODE_SQL, _REF, _VK, _issue_sql

_RATE = adapter.fx_sql()
_ISSUES = f"""ls AS (SELECT doc_id, CAST(sum(amount) AS DECIMAL(18,2)) AS line_sum FROM lines GROUP BY doc_id), off AS (SELECT i.*, total - line_sum AS over FROM invoices i JOIN ls USING (doc_id) WHERE abs(total - line_sum) > 0.02),
    iss AS (SELECT {_issue_sql('total_mismatch', 'error', risk='CASE WHEN over > 0 THEN over END')} FROM off)"""
_STATUS = "CASE WHEN bool_or(status = 'needs_review') THEN 'needs_review' WHEN bool_and(status = 'posted') THEN 'posted' WHEN shipment_id % 3 = 0 THEN 'ready' ELSE 'open' END"
_ASSIGNED = "CASE WHEN shipment_id % 5 < 2 THEN CAST(shipment_id % 7 AS BIGINT) END"
_SHIPMENTS = f"sh AS (SELECT org_id, shipment_id, {_STATUS} AS status, min(received_on) AS received_on, {_ASSIGNED} AS assigned_to FROM invoices GROUP BY org_id, shipment_id)"


def _shipment_rows(t: Tables):
    return t.invoices.groupBy("org_id", "shipment_id").agg(F.expr(_STATUS).alias("status"), F.min("received_on").alias("received_on")).withColumn("assigned_to", F.expr(_ASSIGNED))


def _home(t: Tables, df):
    return money.to_home("total", "currency", F.lit("USD"), adapter.fx_rate(F.col("currency")))


# --- month end -------------------------------------------------------------------------------------------------------

_FACTS = f"fc AS (SELECT org_id, shipment_id, min(destination) AS destination, {_SHIP} AS ship_date, min(doc_id) % 23 = 0 AS rejected FROM invoices GROUP BY org_id, shipment_id)"


def _facts(t: Tables):
    return t.invoices.groupBy("org_id", "shipment_id").agg(F.min("destination").alias("destination"), F.expr(_SHIP).alias("ship_date"), F.expr("min(doc_id) % 23 = 0").alias("rejected"))


_TWO = ["freight", "delivery"]


@query(f"""WITH {_PARTS}, {_FACTS}, {_EXPECTED}, ex AS (SELECT DISTINCT org_id, coalesce(destination, '') AS w, grp FROM y WHERE share >= 0.5 OR grp = 'freight'), g AS (SELECT fc.*, ex.grp FROM fc JOIN ex ON ex.org_id = fc.org_id AND ex.w = coalesce(fc.destination, '')), b AS (SELECT DISTINCT org_id, shipment_id, grp FROM pt), nb AS (SELECT org_id, shipment_id, string_agg(grp, ',' ORDER BY grp) AS billed FROM b WHERE grp <> 'other' GROUP BY org_id, shipment_id),
    x AS (SELECT g.*, coalesce(nb.billed, '') AS billed_groups, CASE WHEN rejected THEN CASE WHEN ship_date BETWEEN DATE '{_END}' - 365 AND DATE '{_END}' THEN 'rejected' END WHEN ship_date IS NULL THEN 'no_ship_date' WHEN ship_date > DATE '{_END}' THEN NULL WHEN ship_date < DATE '{_END}' - 365 THEN 'too_old'
      WHEN shipment_id % 17 = 0 AND grp = 'freight' THEN 'excluded' WHEN shipment_id % 19 = 0 AND grp = 'delivery' THEN 'manual' ELSE 'estimate' END AS state FROM g LEFT JOIN nb USING (org_id, shipment_id) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.org_id = g.org_id AND b.shipment_id = g.shipment_id AND b.grp = g.grp))
    SELECT org_id, shipment_id, grp AS "group", state, billed_groups, CASE WHEN state = 'manual' THEN CAST(150 AS DECIMAL(18,2)) END AS amount FROM x WHERE state IS NOT NULL""", ("invoices", "lines"))  # fmt: skip
def not_invoiced_groups(t: Tables):
    """What shipments should carry and nobody billed: freight always, other groups where at least half of comparable shipments have them."""
    facts, parts = _facts(t), _parts(t)
    freight = t.invoices.filter("doc_type = 'freight_invoice'").select("org_id", "shipment_id", "destination").distinct()
    usual = close.usual_groups(freight, parts.select("org_id", "shipment_id", "destination", "group").distinct())
    expected = usual.filter("expected or group = 'freight'").select("org_id", "destination", "group")
    ids = facts.select("org_id", "shipment_id")
    excluded = ids.filter("shipment_id % 17 = 0").select("*", F.lit("freight").alias("group"), F.lit("exclude").alias("action"), F.lit(None).cast(money.MONEY).alias("amount"))
    manual = ids.filter("shipment_id % 19 = 0").select("*", F.lit("delivery").alias("group"), F.lit("amount").alias("action"), F.lit(150).cast(money.MONEY).alias("amount"))
    return accruals.not_invoiced(facts, parts.select("org_id", "shipment_id", "group"), expected, excluded.unionByName(manual), _END)


_HISTORY = f"{_PARTS}, h AS (SELECT org_id, shipment_id, vendor_key, grp, min(destination) AS destination FROM pt GROUP BY org_id, shipment_id, vendor_key, grp)"


@query(f"""WITH {_HISTORY} SELECT org_id, grp AS "group", destination, vendor_key, count(*) AS n, row_number() OVER (PARTITION BY org_id, grp, destination ORDER BY count(*) DESC, vendor_key) AS place FROM h GROUP BY org_id, grp, destination, vendor_key""", ("invoices", "lines"))
def vendor_frequency(t: Tables):
    return accruals.vendor_frequency(close.history(_parts(t)), ["destination"])


@query(f"""WITH {_HISTORY}, c AS (SELECT org_id, vendor_key, grp, count(*) AS n FROM h GROUP BY ALL) SELECT org_id, vendor_key, arg_max(grp, (n, -list_position(['freight','destination','delivery','other'], grp))) AS "group" FROM c GROUP BY org_id, vendor_key""", ("invoices", "lines"))
def usual_vendor_group(t: Tables):
    return accruals.usual_group(close.history(_parts(t)))


@query(f"""WITH {_HISTORY}, {_FACTS}, g AS (SELECT fc.*, unnest(['freight','delivery']) AS grp FROM fc), os AS (SELECT org_id, shipment_id, {_VK} AS vendor_key, doc_id FROM invoices WHERE doc_type = 'freight_invoice'),
    w0 AS (SELECT os.org_id, os.shipment_id, b.grp, arg_min(os.vendor_key, os.doc_id) AS v FROM os JOIN (SELECT DISTINCT org_id, grp, vendor_key FROM h) b ON b.org_id = os.org_id AND b.vendor_key = os.vendor_key GROUP BY ALL),
    p AS (SELECT org_id, grp, destination, vendor_key, row_number() OVER (PARTITION BY org_id, grp, destination ORDER BY count(*) DESC, vendor_key) AS i FROM h GROUP BY org_id, grp, destination, vendor_key), u AS (SELECT org_id, grp, vendor_key, row_number() OVER (PARTITION BY org_id, grp ORDER BY count(*) DESC, vendor_key) AS i FROM h GROUP BY org_id, grp, vendor_key),
    j AS (SELECT g.org_id, g.shipment_id, g.grp, w0.v AS a, p.vendor_key AS b, u.vendor_key AS c, CASE WHEN g.org_id % 2 = 0 THEN 'harbor 3 logistics' END AS d FROM g LEFT JOIN w0 USING (org_id, shipment_id, grp) LEFT JOIN p ON p.org_id = g.org_id AND p.grp = g.grp AND p.destination = g.destination AND p.i = 1 LEFT JOIN u ON u.org_id = g.org_id AND u.grp = g.grp AND u.i = 1)
    SELECT org_id, shipment_id, grp AS "group", coalesce(a, b, c, d) AS vendor_key, CASE WHEN a IS NOT NULL THEN 'on_shipment' WHEN b IS NOT NULL THEN 'usual_here' WHEN c IS NOT NULL THEN 'usual' WHEN d IS NOT NULL THEN 'quotes' END AS why FROM j""", ("invoices", "lines"))  # fmt: skip
def likely_vendors(t: Tables):
    missing = _facts(t).select("org_id", "shipment_id", "destination", F.explode(F.array(*map(F.lit, _TWO))).alias("group"))
    own = t.invoices.filter("doc_type = 'freight_invoice'").select("org_id", "shipment_id", keys.vendor_key("vendor_name").alias("vendor_key"), "doc_id")
    quotes = t.invoices.select("org_id").distinct().filter("org_id % 2 = 0").select("org_id", F.explode(F.array(*map(F.lit, _TWO))).alias("group"), F.lit("harbor 3 logistics").alias("vendor_key"))
    return accruals.first_candidates(missing, own, close.history(_parts(t)), quotes)


@query(f"""WITH g AS (SELECT doc_id, CASE WHEN code IN ('ocean_freight','baf','thc_origin','documentation') THEN 'freight' WHEN code IN ('thc_destination','customs_clearance','exam','demurrage','storage') THEN 'destination' WHEN code = 'other' THEN 'other' ELSE 'delivery' END AS grp, amount FROM (SELECT *, {_CODE_SQL} AS code FROM lines)),
    s AS (SELECT doc_id, grp, CAST(sum(amount) AS DECIMAL(18,2)) AS a FROM g GROUP BY ALL), r AS (SELECT s.*, total, CAST(total - sum(a) OVER (PARTITION BY doc_id) AS DECIMAL(18,2)) AS gap, row_number() OVER (PARTITION BY doc_id ORDER BY abs(a) DESC, grp) = 1 AS main FROM s JOIN invoices USING (doc_id))
    SELECT doc_id, grp AS "group", CASE WHEN main AND abs(gap) <= abs(total) THEN CAST(a + gap AS DECIMAL(18,2)) ELSE a END AS amount, main FROM r""", ("invoices", "lines"))  # fmt: skip
def invoice_parts(t: Tables):
    lines = charges.with_codes(t.lines.select("doc_id", "description", "amount"))
    return accruals.parts_by_group(lines.select("doc_id", charges.group_of("code").alias("group"), "amount"), t.invoices.select("doc_id", "total"))


@query("""WITH v AS (SELECT org_id, shipment_id, CAST(doc_id % 3 AS INT) AS version, doc_id, total FROM invoices), m AS (SELECT *, max(version) OVER (PARTITION BY org_id, shipment_id) AS top FROM v) SELECT org_id, shipment_id, version, doc_id, total FROM m WHERE version = top""", ("invoices",))
def latest_versions(t: Tables):
    return close.latest_version(t.invoices.select("org_id", "shipment_id", (F.col("doc_id") % 3).cast("int").alias("version"), "doc_id", "total"), ["org_id", "shipment_id"])


# --- shared invoices -------------------------------------------------------------------------------------------------

_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'Freight for OSLN' || lpad(CAST(shipment_id AS STRING), 7, '0') || ' and osln ' || lpad(CAST(shipment_id + 1 AS STRING), 7, '0') || '.' WHEN 1 THEN 'B/L: OSLN' || lpad(CAST(shipment_id + 2 AS STRING), 7, '0') ELSE 'Freight' END"
_PARTIES = "np AS (SELECT org_id, doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN [shipment_id, shipment_id + 1] WHEN 1 THEN [shipment_id + 2] END) AS s FROM invoices WHERE doc_type = 'freight_invoice'), party AS (SELECT DISTINCT np.org_id, np.doc_id, np.s AS shipment_id FROM np JOIN (SELECT DISTINCT org_id, shipment_id FROM invoices) o ON o.org_id = np.org_id AND o.shipment_id = np.s)"


def _named(t: Tables):
    texts = t.invoices.filter("doc_type = 'freight_invoice'").select("org_id", "doc_id", F.expr(_NAMES).alias("text"))
    refs = t.invoices.select("org_id", "shipment_id", F.concat(F.lit("OSLN"), F.lpad(F.col("shipment_id").cast("string"), 7, "0")).alias("ref")).distinct()
    return shared.named_parties(texts, refs)


@query(f"WITH {_PARTIES} SELECT org_id, doc_id, shipment_id, 'OSLN' || lpad(CAST(shipment_id AS STRING), 7, '0') AS refs FROM party", ("invoices",))
def named_parties(t: Tables):
    return _named(t).withColumn("refs", F.array_join("refs", ","))


#: Two parties of every invoice; lines of some parts name one of them, or both.
_LINE_NAMES = "CASE part_id % 8 WHEN 0 THEN 'Truck BOXA' || CAST(doc_id AS STRING) WHEN 1 THEN 'truck boxb-' || CAST(doc_id AS STRING) WHEN 2 THEN 'BOXA' || CAST(doc_id AS STRING) || ' / BOXB' || CAST(doc_id AS STRING) ELSE 'Ocean freight' END"
_OWNED = "lo AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position, part_id, supplier_id, amount) AS line, CAST(amount * 100 AS BIGINT) AS cents, CASE WHEN doc_id < 10 THEN NULL ELSE CASE part_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 END END AS owner FROM lines)"


def _owned(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("position", "part_id", "supplier_id", "amount")
    lines = t.lines.select("doc_id", F.row_number().over(w).cast("long").alias("line"), F.expr(_LINE_NAMES).alias("description"), (F.col("amount") * 100).cast("long").alias("cents"))
    refs = t.lines.select("doc_id").distinct().select("doc_id", F.explode(F.expr("array(struct(CAST(1 AS INT) AS party, 'BOXA' || CAST(doc_id AS STRING) AS ref), struct(CAST(2 AS INT) AS party, 'BOXB' || CAST(doc_id AS STRING) AS ref))")).alias("p")).select("doc_id", "p.*")
    return materialise(shared.line_owners(lines, refs.filter(F.length("ref") >= shared.LEAST)), "owned"), refs


@query(f"WITH {_OWNED} SELECT doc_id, line, CAST(CASE WHEN length(CAST(doc_id AS STRING)) >= 2 THEN owner END AS INT) AS owner FROM lo", ("lines",))
def line_owners(t: Tables):
    return _owned(t)[0].select("doc_id", "line", "owner")


@query(f"""WITH {_OWNED}, w AS (SELECT doc_id, unnest([1, 2]) AS party, unnest([2, 3]) AS w FROM (SELECT DISTINCT doc_id FROM lines)), r AS (SELECT doc_id, sum(cents) AS t FROM lo WHERE owner IS NULL GROUP BY doc_id), q AS (SELECT w.doc_id, party, w.w, t, t * w.w // 5 AS base, t * w.w % 5 AS rem FROM w JOIN r USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rem DESC, w DESC, party) AS nth, t - sum(base) OVER (PARTITION BY doc_id) AS spare FROM q), a AS (SELECT doc_id, party, base + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS part FROM k UNION ALL SELECT doc_id, owner, cents FROM lo WHERE owner IS NOT NULL)
    SELECT doc_id, CAST(party AS INT) AS party, CAST(sum(part) AS BIGINT) AS cents FROM a GROUP BY doc_id, party""", ("lines",))  # fmt: skip
def shared_split(t: Tables):
    """What each of two parties pays of every invoice: its own lines, and its share of the rest."""
    lines, refs = _owned(t)
    parties = refs.select("doc_id", "party", (F.col("party") + 1).cast("long").alias("w"))
    parts = shared.split_shared(lines, parties)
    return parts.groupBy("doc_id", "party").agg(F.sum("part").alias("cents"))


@query(f"""WITH {_OWNED} SELECT doc_id, CAST(line AS BIGINT) AS line, cents, true AS exact FROM lo WHERE cents <> 0""", ("lines",))
def shared_bill_lines(t: Tables):
    """Bill lines of the parties add up to every line of the invoice."""
    lines, refs = _owned(t)
    bills = shared.bill_lines(shared.split_shared(lines, refs.select("doc_id", "party", (F.col("party") + 1).cast("long").alias("w"))), lines)
    sums = bills.groupBy("doc_id", "line").agg((F.sum("amount") * 100).cast("long").alias("sum"))
    return sums.join(lines, ["doc_id", "line"]).select("doc_id", "line", "cents", (F.col("sum") == F.col("cents")).alias("exact"))


@query("""WITH s AS (SELECT doc_id, position AS party, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, min(CASE WHEN doc_id % 13 = 0 AND part_id % 2 = 0 THEN 'EUR' ELSE 'USD' END) AS c FROM lines GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS s, string_agg(party || ':' || amount || ':' || c, '|' ORDER BY party || ':' || amount || ':' || c) AS k, bool_or(party = 7) AS fr, min(c) AS lo, max(c) AS hi FROM s GROUP BY doc_id),
    t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(sum(amount) AS DECIMAL(18,2)) ELSE CAST(1 AS DECIMAL(18,2)) END AS total FROM lines GROUP BY doc_id) SELECT doc_id, n >= 2 AS active, s = total AND lo = 'USD' AND hi = 'USD' AS adds_up, fr AS frozen, sha256(k || '#' || total || 'USD') AS digest FROM g JOIN t USING (doc_id)""", ("lines",))  # fmt: skip
def split_states(t: Tables):
    currency = F.expr("CASE WHEN doc_id % 13 = 0 AND part_id % 2 = 0 THEN 'EUR' ELSE 'USD' END")
    splits = t.lines.groupBy("doc_id", F.col("position").alias("party")).agg(F.sum("amount").cast(money.MONEY).alias("amount"), F.min(currency).alias("currency"))
    totals = t.lines.groupBy("doc_id").agg(F.sum("amount").cast(money.MONEY).alias("s")).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("s")).otherwise(F.lit(1).cast(money.MONEY)).alias("total"), F.lit("USD").alias("currency"))
    return shared.split_state(splits, totals, splits.select("party").filter("party = 7").distinct())


_SPLITS = f"""st AS (SELECT doc_id, position AS party, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, 'USD' AS currency FROM lines WHERE doc_id % 4 <> 3 GROUP BY ALL), fr AS (SELECT doc_id, position AS party, CAST(sum(amount) + max(CASE WHEN doc_id % 5 = 0 AND position = 2 THEN 1 ELSE 0 END) AS DECIMAL(18,2)) AS amount, 'USD' AS currency FROM lines WHERE NOT (doc_id % 3 = 0 AND position = 3) GROUP BY ALL)"""


@query(f"""WITH {_SPLITS}, i AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE total END AS total, currency, doc_id % 11 = 0 AS dismissed, doc_id % 7 = 0 AS manual, CASE WHEN doc_id % 14 = 0 THEN total + 1 ELSE total END AS was FROM invoices WHERE doc_id < 1000000000),
    o AS (SELECT doc_id, count(*) AS n, bool_or(party = 7) AS frozen FROM st GROUP BY doc_id), a AS (SELECT * FROM fr WHERE party <> 7), p AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id),
    r AS (SELECT i.doc_id, CASE WHEN o.frozen THEN 'frozen' WHEN total IS NULL OR total <= 0 OR dismissed THEN 'drop' WHEN manual AND o.n >= 2 THEN CASE WHEN was = total THEN 'own' ELSE 'recheck' END WHEN coalesce(p.n, 0) < 2 THEN 'drop' ELSE 'fresh' END AS rule FROM i LEFT JOIN o USING (doc_id) LEFT JOIN p USING (doc_id)),
    k AS (SELECT st.*, CASE WHEN rule = 'recheck' THEN 'recheck' ELSE 'kept' END AS action FROM st JOIN r USING (doc_id) WHERE rule IN ('frozen', 'own', 'recheck')),
    s2 AS (SELECT st.* FROM st LEFT JOIN r USING (doc_id) WHERE coalesce(rule, '') NOT IN ('frozen', 'own', 'recheck')), w AS (SELECT a.* FROM a JOIN r USING (doc_id) WHERE rule = 'fresh')
    SELECT * FROM k UNION ALL SELECT coalesce(w.doc_id, s2.doc_id), coalesce(w.party, s2.party), coalesce(w.amount, s2.amount), 'USD', CASE WHEN s2.doc_id IS NULL THEN 'added' WHEN w.doc_id IS NULL THEN 'gone' WHEN w.amount = s2.amount THEN 'kept' ELSE 'changed' END FROM s2 FULL JOIN w ON w.doc_id = s2.doc_id AND w.party = s2.party""", ("invoices", "lines"))  # fmt: skip
def split_sync(t: Tables):
    """Shares of invoices detected again: frozen, dismissed, a person's own and refreshed splits."""
    shares = t.lines.groupBy("doc_id", F.col("position").alias("party")).agg(F.sum("amount").cast(money.MONEY).alias("amount")).withColumn("currency", F.lit("USD"))
    more = F.when((F.col("doc_id") % 5 == 0) & (F.col("party") == 2), 1).otherwise(0)
    fresh = shares.filter("not (doc_id % 3 = 0 and party = 3)").withColumn("amount", (F.col("amount") + more).cast(money.MONEY))
    inv = t.invoices.filter("doc_id < 1000000000").select(
        "doc_id", F.expr("CASE WHEN doc_id % 29 = 0 THEN NULL ELSE total END").alias("total"), "currency", (F.col("doc_id") % 11 == 0).alias("dismissed"), (F.col("doc_id") % 7 == 0).alias("manual"),
        F.expr("CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 14 = 0 THEN CAST(total + 1 AS DECIMAL(18,2)) ELSE total END").alias("was_total"), F.col("currency").alias("was_currency"),
    )
    return shared.sync_splits(shares.filter("doc_id % 4 <> 3"), fresh, inv, shares.select("party").filter("party = 7").distinct())


@query("""WITH p AS (SELECT i.org_id, regexp_replace(CASE WHEN l.part_id % 7 = 0 THEN '9903.88.15' ELSE '8471.30.' || lpad(CAST(l.part_id % 90 AS STRING), 4, '0') END, '[^0-9]', '', 'g') AS hts, lower(l.description) AS description FROM lines l JOIN invoices i USING (doc_id)),
    d AS (SELECT DISTINCT * FROM p WHERE hts NOT LIKE '99%') SELECT * FROM d WHERE right(hts, 1) <> '3'""", ("invoices", "lines"))  # fmt: skip
def tariff_unseen(t: Tables):
    """Pairs of tariff number and description that no review has judged yet; those whose number ends in 3 were judged before."""
    hts = F.when(F.col("part_id") % 7 == 0, "9903.88.15").otherwise(F.concat(F.lit("8471.30."), F.lpad((F.col("part_id") % 90).cast("string"), 4, "0")))
    pairs = customs.tariff_pairs(t.lines.join(t.invoices.select("doc_id", "org_id"), "doc_id").select("org_id", hts.alias("hts"), "description"))
    return versions.unseen(pairs, pairs.filter("endswith(hts, '3')"), ["org_id", "hts", "description"])


# --- exports ---------------------------------------------------------------------------------------------------------

_MONEY_TEXT = "string_agg(currency || ' ' || format('{{:,.2f}}', CAST({a} AS DOUBLE)), '; ' ORDER BY currency)"


@query(f"""WITH {_ISSUES}, {_SHIPMENTS}, p AS (SELECT org_id, shipment_id, currency, CAST(sum(CASE WHEN doc_type = 'credit_note' THEN -abs(total) ELSE total END) AS DECIMAL(18,2)) AS t, CAST(sum(CASE WHEN doc_type = 'credit_note' THEN abs(total) END) AS DECIMAL(18,2)) AS c FROM invoices WHERE doc_type IN ('freight_invoice','commercial_invoice','credit_note') GROUP BY ALL),
    ph AS (SELECT *, CAST(round_even(t * {_RATE}, 2) AS DECIMAL(18,2)) AS home FROM p), pt AS (SELECT org_id, shipment_id, {_MONEY_TEXT.format(a='t')} AS totals, CASE WHEN count(home) = count(*) THEN CAST(sum(home) AS DECIMAL(18,2)) END AS total_home, {_MONEY_TEXT.format(a='c').replace(" ORDER BY currency)", " ORDER BY currency) FILTER (c IS NOT NULL)")} AS credits FROM ph GROUP BY org_id, shipment_id),
    d AS (SELECT org_id, shipment_id, count(*) AS n_docs, count(*) FILTER (doc_type = 'credit_note') AS n_credits, count(*) FILTER (doc_type IN ('freight_invoice','commercial_invoice')) AS n_invoices FROM invoices GROUP BY org_id, shipment_id), i AS (SELECT org_id, shipment_id, count(*) AS n_errors FROM iss GROUP BY org_id, shipment_id),
    rk AS (SELECT org_id, shipment_id, currency, CAST(sum(amount_at_risk) AS DECIMAL(18,2)) AS a FROM iss WHERE amount_at_risk > 0 GROUP BY ALL), rt AS (SELECT org_id, shipment_id, {_MONEY_TEXT.format(a='a')} AS at_risk FROM rk GROUP BY org_id, shipment_id)
    SELECT org_id, shipment_id, status, n_docs, n_credits, n_invoices, coalesce(totals, '') AS totals, total_home, coalesce(credits, '') AS credits, coalesce(n_errors, 0) AS n_errors, 0::BIGINT AS n_warnings, CASE WHEN n_errors > 0 THEN 'total_mismatch' ELSE '' END AS open_issues, coalesce(at_risk, '') AS at_risk
    FROM sh JOIN d USING (org_id, shipment_id) LEFT JOIN pt USING (org_id, shipment_id) LEFT JOIN i USING (org_id, shipment_id) LEFT JOIN rt USING (org_id, shipment_id) WHERE status = 'needs_review'""", ("invoices", "lines"))  # fmt: skip
def shipments_export(t: Tables):
    rows = exports.filter_shipments(_shipment_rows(t).withColumnRenamed("received_on", "created_on"), "needs_review").select("org_id", "shipment_id", "status")
    return exports.shipments(rows, t.invoices, rules.total_mismatch(t.invoices, t.lines), adapter.fx_rate(F.col("currency")))


_DOC_STATUS = "CASE WHEN status = 'posted' THEN CASE WHEN doc_id % 9 = 0 THEN 'archive' ELSE 'matched' END WHEN status = 'open' THEN 'unmatched' ELSE status END"


@query(f"""WITH d AS (SELECT doc_id, vendor_name, number, received_on, doc_type, {_DOC_STATUS} AS status, shipment_id, CAST(total AS STRING) AS total, currency FROM invoices WHERE doc_type = 'freight_invoice')
    SELECT doc_id, status, CASE WHEN doc_id % 23 = 0 THEN '' ELSE vendor_name END AS value_vendor_name, total AS value_total, CASE WHEN doc_id % 31 = 5 AND doc_id % 7 <> 0 THEN 'total' ELSE '' END AS to_check, CASE WHEN doc_id % 7 = 0 THEN 'total, vendor_name' ELSE '' END AS corrected, CASE WHEN status = 'matched' THEN shipment_id END AS shipment_id
    FROM d WHERE status = 'matched' AND (contains(lower(number), '7') OR contains(lower(vendor_name), '7')) AND received_on BETWEEN DATE '1994-01-01' AND DATE '2000-12-31'""", ("invoices",))  # fmt: skip
def documents_export(t: Tables):
    docs = t.invoices.withColumn("status", F.expr(_DOC_STATUS)).select("doc_id", "vendor_name", "number", "received_on", "doc_type", "status", "shipment_id", "total")
    chosen = exports.filter_documents(docs, "matched", "freight_invoice", "7", "1994-01-01", "2000-12-31")
    value = F.expr("CASE WHEN doc_id % 23 = 0 THEN '' ELSE vendor_name END")
    pairs = F.explode(F.create_map(F.lit("vendor_name"), value, F.lit("total"), F.col("total").cast("string"))).alias("name", "value")
    fields = docs.select("doc_id", pairs).withColumns({"confidence": F.expr("CASE WHEN doc_id % 31 = 5 AND name = 'total' THEN 0.7 ELSE 0.95 END"), "source": F.when(F.col("doc_id") % 7 == 0, "human").otherwise("machine")})
    links = docs.filter("status = 'matched'").select("doc_id", "shipment_id")
    return exports.documents(chosen.select("doc_id", "status"), fields, links, ["vendor_name", "total"])


@query(f"WITH {_ISSUES}, {_SHIPMENTS} SELECT iss.shipment_id, iss.doc_id, severity, code, amount_at_risk, iss.currency, NOT (doc_id % 4 = 0) AS open FROM iss JOIN sh ON sh.org_id = iss.org_id AND sh.shipment_id = iss.shipment_id WHERE sh.status = 'ready' AND NOT (doc_id % 4 = 0)", ("invoices", "lines"))
def issues_export(t: Tables):
    chosen = exports.filter_shipments(_shipment_rows(t).withColumnRenamed("received_on", "created_on"), "ready").select("org_id", "shipment_id")
    found = rules.total_mismatch(t.invoices, t.lines).withColumn("resolved", F.col("doc_id") % 4 == 0).join(chosen, ["org_id", "shipment_id"], "left_semi")
    return exports.filter_issues(found, open_only=True, severity="error").select("shipment_id", "doc_id", "severity", "code", "amount_at_risk", "currency", (~F.col("resolved")).alias("open"))


# --- disputes --------------------------------------------------------------------------------------------------------

_DISPUTE = {
    "org_id": "org_id", "dispute_id": "doc_id + 5", "invoice_id": "doc_id", "invoice_number": "number", "currency": "currency",
    "status": "CASE doc_id % 5 WHEN 1 THEN 'draft' WHEN 2 THEN 'sent' WHEN 3 THEN 'acknowledged' WHEN 4 THEN 'credit_received' ELSE 'resolved' END",
    "disputed": "CAST(floor(total / 4) AS DECIMAL(18,2))", "invoice_total": "total", "recovered_on": "received_on",
}
_DISPUTES = f"disp AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _DISPUTE.items())}, {_VK} AS vendor_key FROM invoices WHERE status = 'needs_review' AND doc_type = 'freight_invoice')"


def _disputes(t: Tables):
    rows = t.invoices.filter("status = 'needs_review' and doc_type = 'freight_invoice'")
    return rows.select(*[F.expr(e).alias(c) for c, e in _DISPUTE.items()], keys.vendor_key("vendor_name").alias("vendor_key"), F.lit(None).cast("long").alias("credit_note"))


@query(f"""WITH {_ISSUES}, {_DISPUTES} SELECT org_id, shipment_id, doc_id, currency, 'total_mismatch' AS codes, amount_at_risk AS amount FROM iss WHERE amount_at_risk > 0 AND NOT EXISTS (SELECT 1 FROM disp WHERE disp.org_id = iss.org_id AND disp.invoice_id = iss.doc_id AND disp.status <> 'resolved')""", ("invoices", "lines"))
def disputable_invoices(t: Tables):
    return disputes.disputable(rules.total_mismatch(t.invoices, t.lines), _disputes(t))


@query(f"""WITH {_DISPUTES}, it AS (SELECT doc_id + 5 AS dispute_id, amount, CASE part_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'USD' ELSE 'EUR' END AS c FROM lines) SELECT dispute_id, CAST(coalesce(sum(amount) FILTER (c = '' OR c = currency), 0) AS DECIMAL(18,2)) AS amount FROM disp LEFT JOIN it USING (dispute_id) GROUP BY dispute_id""", ("invoices", "lines"))
def dispute_amounts(t: Tables):
    items = t.lines.select((F.col("doc_id") + 5).alias("dispute_id"), "amount", F.expr("CASE part_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'USD' ELSE 'EUR' END").alias("currency"))
    return disputes.default_amounts(_disputes(t), items)


_CREDITED = "'inv ' || CAST(doc_id + CASE WHEN doc_id % 20 = 0 THEN 3 ELSE 7 END AS STRING)"


@query(f"""WITH {_DISPUTES}, w AS (SELECT org_id, regexp_replace(upper(invoice_number), '[^A-Z0-9]', '', 'g') AS no, min(dispute_id) AS dispute_id, min(currency) AS c, count(*) AS n FROM disp WHERE status IN ('sent', 'acknowledged') GROUP BY org_id, vendor_key, no),
    k AS (SELECT org_id, doc_id, regexp_replace(upper({_CREDITED}), '[^A-Z0-9]', '', 'g') AS no, total, currency, received_on FROM invoices WHERE doc_type = 'credit_note')
    SELECT dispute_id, arg_max(doc_id, (received_on, doc_id)) AS doc_id, CAST(abs(arg_max(total, (received_on, doc_id))) AS DECIMAL(18,2)) AS amount FROM w JOIN k ON k.org_id = w.org_id AND k.no = w.no WHERE n = 1 AND k.currency = w.c GROUP BY dispute_id""", ("invoices",))  # fmt: skip
def credit_matches(t: Tables):
    """Credits are of the invoice's own vendor here: the number decides."""
    own = _disputes(t).withColumn("vendor_key", F.lit("x"))
    credits = t.invoices.filter("doc_type = 'credit_note'").select("org_id", "doc_id", F.lit("x").alias("vendor_name"), F.expr(_CREDITED).alias("original"), "total", "currency", "received_on")
    return disputes.credit_suggestions(credits, own)


_ASKED = "CAST(CASE invoice_id % 4 WHEN 0 THEN 0 WHEN 1 THEN disputed WHEN 2 THEN disputed * 2 ELSE invoice_total * 2 END AS DECIMAL(18,2))"


@query(f"""WITH {_DISPUTES}, c AS (SELECT dispute_id, status, {_ASKED} AS amount, disputed, invoice_total, invoice_id % 3 = 0 AS confirmed FROM disp), o AS (SELECT *, CASE WHEN status NOT IN ('sent', 'acknowledged', 'credit_received') THEN 'not waiting' WHEN amount <= 0 THEN 'no amount' WHEN amount > invoice_total THEN 'above the invoice' WHEN disputed > 0 AND amount > disputed AND NOT confirmed THEN 'above the dispute' ELSE 'ok' END AS outcome FROM c)
    SELECT dispute_id, amount, outcome, CASE WHEN outcome = 'ok' THEN CAST(greatest(0, disputed - amount) AS DECIMAL(18,2)) END AS outstanding FROM o""", ("invoices",))  # fmt: skip
def credit_records(t: Tables):
    rows = _disputes(t).select("dispute_id", "status", F.expr(_ASKED).alias("amount"), "disputed", "invoice_total", (F.col("invoice_id") % 3 == 0).alias("confirmed"))
    return disputes.recorded(rows).select("dispute_id", "amount", "outcome", "outstanding")


@query(f"""WITH {_DISPUTES}, r AS (SELECT org_id, CAST(date_trunc('month', recovered_on) AS DATE) AS month, CAST(round_even(disputed * {_RATE}, 2) AS DECIMAL(18,2)) AS home FROM disp WHERE status IN ('credit_received', 'resolved') AND disputed > 0) SELECT org_id, month, CAST(coalesce(sum(home), 0) AS DECIMAL(18,2)) AS recovered, count(*) AS n, count(*) FILTER (home IS NULL) AS unconverted FROM r GROUP BY org_id, month""", ("invoices",))
def dispute_recoveries(t: Tables):
    rows = _disputes(t).withColumn("recovered", F.col("disputed")).withColumn("recovered_home", money.half_even(F.col("disputed") * adapter.fx_rate(F.col("currency"))))
    return disputes.recoveries(rows)


# --- customs ---------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, CAST(amount * 0.05 AS DECIMAL(18,2)) AS stated, CASE WHEN part_id % 7 = 0 THEN NULL ELSE amount END AS value FROM lines), s AS (SELECT doc_id, CAST(sum(stated) AS DECIMAL(18,2)) AS d, CAST(sum(value) AS DECIMAL(18,2)) AS v FROM l GROUP BY doc_id),
    e AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN d ELSE d + 2 END AS total_duty, CASE WHEN doc_id % 5 = 0 THEN v - 10 ELSE v END AS total_value, CAST(100 AS DECIMAL(18,2)) AS fees, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN d + 100 ELSE d + 103 END AS grand FROM s),
    x AS (SELECT doc_id, 'duty_total_mismatch' AS code, d AS expected, total_duty AS stated FROM e UNION ALL SELECT doc_id, 'entered_value_total_mismatch', v, total_value FROM e UNION ALL SELECT doc_id, 'duty_fees_total_mismatch', coalesce(total_duty, d) + fees, grand FROM e)
    SELECT doc_id, code, CAST(expected AS DECIMAL(18,2)) AS expected, CAST(stated AS DECIMAL(18,2)) AS stated, CASE WHEN code <> 'entered_value_total_mismatch' AND stated > expected THEN CAST(stated - expected AS DECIMAL(18,2)) END AS at_risk FROM x WHERE abs(stated - expected) > 1""", ("lines",))  # fmt: skip
def entry_arithmetic(t: Tables):
    lines = t.lines.select("doc_id", (F.col("amount") * F.lit("0.05").cast("decimal(4,2)")).cast(money.MONEY).alias("stated"), F.when(F.col("part_id") % 7 != 0, F.col("amount")).alias("value"))
    s = lines.groupBy("doc_id").agg(F.sum("stated").cast(money.MONEY).alias("d"), F.sum("value").cast(money.MONEY).alias("v"))
    printed = {
        "total_duty": "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN d ELSE d + 2 END", "total_value": "CASE WHEN doc_id % 5 = 0 THEN v - 10 ELSE v END",
        "fees": "100", "grand_total": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN d + 100 ELSE d + 103 END",
    }
    return customs.entry_arithmetic(s.select("doc_id", *[F.expr(e).cast(money.MONEY).alias(c) for c, e in printed.items()]), lines)


_HTS = "CASE part_id % 9 WHEN 0 THEN '9903.88.15' WHEN 1 THEN '8471.30.0100' WHEN 2 THEN '8471.30' WHEN 3 THEN '84713' WHEN 4 THEN '0071.30.0100' WHEN 5 THEN '8471-30-0100' WHEN 6 THEN '' ELSE '8471300100' END"


@query(f"""WITH l AS (SELECT doc_id, position, part_id, {_HTS} AS hts, doc_id % 2 = 0 AS us FROM lines), d AS (SELECT *, regexp_replace(hts, '[^0-9]', '', 'g') AS g FROM l) SELECT doc_id, position, part_id, hts FROM d WHERE hts <> '' AND NOT (CASE WHEN us THEN length(g) = 10 OR (g LIKE '99%' AND length(g) = 8) ELSE length(g) BETWEEN 6 AND 10 END AND NOT regexp_matches(hts, '[^\\d.\\s]') AND substr(g, 1, 2) NOT IN ('00', '77'))""", ("lines",))
def tariff_formats(t: Tables):
    return customs.hts_format(t.lines.select("doc_id", "position", "part_id", F.expr(_HTS).alias("hts"), (F.col("doc_id") % 2 == 0).alias("us"))).drop("us")


_ENTRY_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'Entry ABC-' || lpad(CAST(shipment_id % 10000000 AS STRING), 7, '0') || '-1 cleared' WHEN 1 THEN 'see abc' ELSE NULL END"


@query("""WITH e AS (SELECT DISTINCT org_id, shipment_id, 'ABC' || lpad(CAST(shipment_id % 10000000 AS STRING), 7, '0') || '1' AS n FROM invoices), d AS (SELECT org_id, doc_id, CASE WHEN doc_id % 8 = 5 THEN 'ABC' || lpad(CAST((shipment_id + 1) % 10000000 AS STRING), 7, '0') || '1' WHEN doc_id % 4 = 0 THEN 'ABC' || lpad(CAST(shipment_id % 10000000 AS STRING), 7, '0') || '1' END AS n FROM invoices)
    SELECT d.org_id, doc_id, min(shipment_id) AS shipment_id FROM d JOIN e ON e.org_id = d.org_id AND e.n = d.n GROUP BY d.org_id, doc_id""", ("invoices",))  # fmt: skip
def entry_fallback(t: Tables):
    number = F.concat(F.lit("ABC-"), F.lpad((F.col("shipment_id") % 10_000_000).cast("string"), 7, "0"), F.lit("-1"))
    other = F.concat(F.lit("abc "), F.lpad(((F.col("shipment_id") + 1) % 10_000_000).cast("string"), 7, "0"), F.lit(" 1"))
    docs = t.invoices.select("org_id", "doc_id", F.expr(_ENTRY_TEXT).alias("text"), F.when(F.col("doc_id") % 8 == 5, other).alias("entry"))
    return customs.by_entry(docs, t.invoices.select("org_id", "shipment_id", number.alias("entry")).distinct())


@query(f"""WITH e AS (SELECT org_id, doc_id, {_REF} AS number, received_on, total FROM invoices WHERE doc_type = 'freight_invoice'), r AS (SELECT *, row_number() OVER (PARTITION BY org_id, substr(number, 4) ORDER BY received_on DESC, doc_id DESC) AS i FROM e) SELECT org_id, count(*) AS n, CAST(sum(total) AS DECIMAL(18,2)) AS duty FROM r WHERE i = 1 GROUP BY org_id""", ("invoices",))
def duty_of_latest_entries(t: Tables):
    """Each entry's duty once, by the last copy received; entry numbers are made from invoice numbers."""
    digits = F.regexp_extract(keys.norm_ref("number"), "[0-9]+", 0)
    rows = t.invoices.filter("doc_type = 'freight_invoice'").select("org_id", "doc_id", "received_on", "total", F.concat(F.lit("ABC"), F.lpad(digits, 8, "0")).alias("number"))
    return customs.latest_entries(rows).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast(money.MONEY).alias("duty"))


_COUNTRY_NAMES = ["China", "PRC", "People's Republic of China", "vn", "Viet Nam", "Narnia", "", "the Netherlands", "U.S.A"]
_COUNTRY_CODES = ["CN", "CN", "CN", "VN", "VN", "NARNIA", "", "NL", "U S A"]


@query(f"SELECT c_custkey % 9 AS k, count(*) AS n, {_COUNTRY_CODES!r}[c_custkey % 9 + 1] AS code FROM customer GROUP BY ALL")
def country_codes(t: Tables):
    counts = t.customer.groupBy((F.col("c_custkey") % 9).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("k", "n", customs.country_code(F.get(F.array(*map(F.lit, _COUNTRY_NAMES)), F.col("k").cast("int"))).alias("code"))


# --- free time -------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT org_id, doc_id AS container, doc_id % 7 = 0 AS manual, received_on AS last_free FROM invoices WHERE doc_id % 3 <> 1), n AS (SELECT org_id, doc_id AS container, CASE WHEN doc_id % 5 = 0 THEN received_on + 9 ELSE received_on + CAST(doc_id % 6 AS INT) END AS plan FROM invoices WHERE doc_id % 4 <> 2)
    SELECT coalesce(r.org_id, n.org_id) AS org_id, coalesce(r.container, n.container) AS container, CASE WHEN r.container IS NULL THEN 'new' WHEN n.container IS NOT NULL THEN 'updated' WHEN manual THEN 'kept' ELSE 'removed' END AS action, CASE WHEN n.container IS NOT NULL THEN plan ELSE last_free END AS last_free FROM r FULL JOIN n ON r.org_id = n.org_id AND r.container = n.container""", ("invoices",))  # fmt: skip
def free_time_sync(t: Tables):
    rows = t.invoices.filter("doc_id % 3 <> 1").select("org_id", F.col("doc_id").alias("container"), (F.col("doc_id") % 7 == 0).alias("manual"), F.col("received_on").alias("last_free"))
    notices = t.invoices.filter("doc_id % 4 <> 2").select(
        "org_id", F.col("doc_id").alias("container"), F.col("received_on").alias("discharge"), (F.col("doc_id") % 6).cast("int").alias("free_days"), F.lit(True).alias("weekends"), F.when(F.col("doc_id") % 5 == 0, F.date_add("received_on", 9)).alias("printed")
    )
    return customs.sync_free_time(rows, notices)


@query(f"""WITH r AS (SELECT org_id, doc_id AS container, {_VK} AS v, CASE WHEN doc_id % 2 = 0 THEN 'demurrage' ELSE 'detention' END AS code FROM invoices) SELECT org_id, container, CAST(CASE WHEN org_id % 4 = 0 AND code = 'demurrage' THEN 90 WHEN v = 'harbor 3 logistics' THEN 75 END AS DECIMAL(18,2)) AS daily, CASE WHEN org_id % 4 = 0 AND code = 'demurrage' THEN 'approval' WHEN v = 'harbor 3 logistics' THEN 'quote' END AS daily_source FROM r""", ("invoices",))
def free_time_rates(t: Tables):
    rows = t.invoices.select("org_id", F.col("doc_id").alias("container"), keys.vendor_key("vendor_name").alias("vendor_key"), F.when(F.col("doc_id") % 2 == 0, "demurrage").otherwise("detention").alias("code"))
    orgs = t.invoices.select("org_id").distinct()
    caps = orgs.filter("org_id % 4 = 0").select("org_id", F.lit("demurrage").alias("code"), F.lit(90).cast(money.MONEY).alias("max_per_unit"), F.lit("day").alias("unit"))
    quoted = orgs.select("org_id", F.lit("harbor 3 logistics").alias("vendor_key"), F.explode(F.array(F.lit("demurrage"), F.lit("detention"))).alias("code"), F.lit(75).cast(money.MONEY).alias("amount"), F.lit("day").alias("basis"))
    return customs.daily_rates(rows, caps, quoted).select("org_id", "container", "daily", "daily_source")


@query("""WITH r AS (SELECT doc_id AS container, CAST(CASE WHEN doc_id % 11 <> 0 THEN received_on - DATE '1998-01-01' END AS INT) AS days_left FROM invoices), t AS (SELECT *, CASE WHEN days_left IS NULL THEN 'unknown' WHEN days_left > 2 THEN 'ok' WHEN days_left > 0 THEN 'soon' WHEN days_left = 0 THEN 'today' ELSE 'late' END AS tone FROM r) SELECT container, days_left, tone FROM t WHERE tone IN ('late', 'today', 'soon') ORDER BY days_left NULLS LAST, container LIMIT 25""", ("invoices",))
def free_time_queue(t: Tables):
    left = F.when(F.col("doc_id") % 11 != 0, F.datediff("received_on", F.lit("1998-01-01").cast("date")))
    rows = t.invoices.select(F.col("doc_id").alias("container"), left.alias("days_left"))
    tone = F.when(F.col("days_left").isNull(), "unknown").when(F.col("days_left") > 2, "ok").when(F.col("days_left") > 0, "soon").when(F.col("days_left") == 0, "today").otherwise("late")
    return customs.most_urgent(rows.withColumn("tone", tone), "action", 25)


# --- statements ------------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT org_id, {_VK} AS vendor_key, doc_id, CASE WHEN doc_type = 'credit_note' THEN 'credit' ELSE 'invoice' END AS kind, number, invoice_date, abs(CAST(CASE WHEN currency = 'USD' THEN total ELSE round_even(total * {_RATE}, 2) END AS DECIMAL(18,2))) AS amount, doc_id % 23 = 0 AS rej FROM invoices WHERE doc_type <> 'bill_of_lading' AND doc_id < 1000000000 AND invoice_date <= DATE '{_END}')
    SELECT org_id, vendor_key, doc_id AS item_id, kind, number, invoice_date AS day, amount, CASE WHEN kind = 'credit' THEN -amount WHEN rej THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS owed FROM d
    UNION ALL SELECT org_id, {_VK}, doc_id, 'payment', 'PAY' || doc_id, received_on, total, -total FROM invoices WHERE status = 'posted' AND received_on <= DATE '{_END}'""", ("invoices",))  # fmt: skip
def statement_items(t: Tables):
    kind = F.when(F.col("doc_type") == "credit_note", "credit").otherwise("invoice")
    docs = t.invoices.filter("doc_type <> 'bill_of_lading'").withColumns({"vendor_key": keys.vendor_key("vendor_name"), "kind": kind, "bl": F.lit(""), "rejected": F.col("doc_id") % 23 == 0, "duplicate": F.col("doc_id") >= 1_000_000_000})
    pays = t.invoices.filter("status = 'posted'").select("org_id", keys.vendor_key("vendor_name").alias("vendor_key"), F.col("doc_id").alias("payment_id"), F.concat(F.lit("PAY"), "doc_id").alias("reference"), F.col("received_on").alias("paid_on"), F.col("total").alias("amount"))
    return statements.own_items(docs, pays, _home(t, docs), _END).drop("bl")


_MONTHLY = "concat_ws(' ', {vk}, CAST(year(invoice_date) AS STRING), CAST(month(invoice_date) AS STRING))"


@query(f"""WITH l AS (SELECT {_VK} AS s, CASE WHEN doc_id % 9 = 0 THEN 'opening' ELSE 'invoice' END AS kind, total FROM invoices), i AS (SELECT {_VK} AS s, invoice_date, total FROM invoices), g AS (SELECT s, CAST(sum(total) AS DECIMAL(18,2)) AS ln, CAST(sum(total) FILTER (kind = 'opening') AS DECIMAL(18,2)) AS op FROM l GROUP BY s), b AS (SELECT s, CAST(sum(total) AS DECIMAL(18,2)) AS bf FROM i WHERE invoice_date < DATE '1995-01-01' GROUP BY s),
    x AS (SELECT s AS statement_id, 'arithmetic' AS bucket, CAST(CASE WHEN length(s) % 2 = 0 THEN ln ELSE ln + 7 END - ln AS DECIMAL(18,2)) AS effect FROM g UNION ALL SELECT s, 'opening', CAST(op - coalesce(bf, 0) AS DECIMAL(18,2)) FROM g LEFT JOIN b USING (s)) SELECT * FROM x WHERE effect <> 0""", ("invoices",))  # fmt: skip
def statement_balances(t: Tables):
    sid = keys.vendor_key("vendor_name").alias("statement_id")
    lines = t.invoices.select(sid, F.when(F.col("doc_id") % 9 == 0, "opening").otherwise("invoice").alias("kind"), F.col("total").alias("amount"))
    closing = F.when(F.length("statement_id") % 2 == 0, F.col("s")).otherwise(F.col("s") + 7).cast(money.MONEY)
    heads = lines.groupBy("statement_id").agg(F.sum("amount").cast(money.MONEY).alias("s")).select("statement_id", F.lit("1995-01-01").cast("date").alias("period_start"), closing.alias("closing"))
    return statements.balances(lines, t.invoices.select(sid, F.col("invoice_date").alias("day"), F.col("total").alias("owed")), heads)


@query(f"""WITH l AS (SELECT {_VK} || ' ' || currency AS s, doc_id AS p, CAST(floor(total / 20000) AS DECIMAL(18,2)) AS amount, CAST(date_trunc('month', invoice_date) AS DATE) AS d, doc_id % 3 AS no FROM invoices) SELECT a.s AS statement_id, a.p AS position, min(b.p) AS twin FROM l a JOIN l b ON a.s = b.s AND a.amount = b.amount AND a.d = b.d AND b.p < a.p AND a.no <> b.no GROUP BY a.s, a.p""", ("invoices",))
def statement_twins(t: Tables):
    rows = t.invoices.select(F.concat_ws(" ", keys.vendor_key("vendor_name"), "currency").alias("statement_id"), F.col("doc_id").alias("position"), F.lit("invoice").alias("kind"), F.floor(F.col("total") / 20000).cast(money.MONEY).alias("amount"), F.trunc("invoice_date", "month").alias("day"), F.lit("").alias("reference"), (F.col("doc_id") % 3).cast("string").alias("number"))
    return statements.same_content(rows)


@query(None)
def statement_summary(t: Tables):
    """Buckets of every statement, credits applied to the invoices that they name."""
    lines, items = _statement(t)
    found = materialise(statements.reconcile(lines, items), "reconciled")
    credits = items.filter("kind = 'credit'").select("statement_id", "item_id", F.concat(F.lit("INV-"), F.col("item_id") + 4).alias("original"), "amount")
    return statements.reconciliation_summary(statements.credits_applied(found, lines, items, credits))


# --- landed cost inputs ----------------------------------------------------------------------------------------------

_GOODS_NAMES = "CASE part_id % 4 WHEN 0 THEN 'Inland freight' WHEN 1 THEN 'Insurance fee' ELSE 'Widget' END"


@query(f"""SELECT doc_id, position, part_id, NOT (part_id % 5 <> 0 AND part_id % 4 < 2 AND quantity <= 1) AS goods FROM lines""", ("lines",))
def goods_lines(t: Tables):
    rows = t.lines.select("doc_id", "position", "part_id", F.expr(_GOODS_NAMES).alias("description"), F.when(F.col("part_id") % 5 == 0, "SKU").alias("sku"), "quantity")
    return allocation.goods_lines(rows).select("doc_id", "position", "part_id", "goods")


@query("""SELECT doc_id, CASE WHEN shipment_id % 10 = 0 AND doc_type = 'freight_invoice' THEN 'weight' WHEN org_id % 2 = 0 AND doc_type = 'freight_invoice' THEN 'volume' ELSE 'value' END AS basis FROM invoices""", ("invoices",))
def charge_basis(t: Tables):
    rows = t.invoices.select("org_id", "shipment_id", "doc_id", F.col("doc_type").alias("category"))
    own = t.invoices.filter("shipment_id % 10 = 0").select("shipment_id", F.lit("freight_invoice").alias("category"), F.lit("weight").alias("basis")).distinct()
    org = t.invoices.select("org_id").distinct().filter("org_id % 2 = 0").select("org_id", F.lit("freight_invoice").alias("category"), F.lit("volume").alias("basis"))
    return allocation.policy_basis(rows, own, org).select("doc_id", "basis")


@query("""SELECT shipment_id, coalesce(min(invoice_date) FILTER (doc_type = 'commercial_invoice'), min(invoice_date) FILTER (doc_type = 'bill_of_lading'), min(received_on)) AS as_of FROM invoices GROUP BY shipment_id""", ("invoices",))
def landed_as_of(t: Tables):
    return allocation.as_of_day(t.invoices, t.invoices.groupBy("shipment_id").agg(F.min("received_on").alias("created_on")))


@query("""WITH l AS (SELECT doc_id, position AS product, CAST(sum(amount) AS DECIMAL(18,2)) AS landed FROM lines GROUP BY ALL), f AS (SELECT doc_id, product, CAST(landed + CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS DECIMAL(18,2)) AS landed FROM l WHERE doc_id % 3 = 0 AND product <= 3) SELECT *, true AS frozen FROM f UNION ALL SELECT *, false FROM l WHERE doc_id NOT IN (SELECT doc_id FROM f)""", ("lines",))
def frozen_results(t: Tables):
    live = t.lines.groupBy("doc_id", F.col("position").alias("product")).agg(F.sum("amount").cast(money.MONEY).alias("landed"))
    old = live.filter("doc_id % 3 = 0 and product <= 3")
    versions = [old.withColumns({"landed": (F.col("landed") + v).cast(money.MONEY), "version": F.lit(v)}) for v in (1, 2)]
    return allocation.frozen_or_live(live, versions[0].unionByName(versions[1].filter("doc_id % 6 = 0")), ["doc_id"])


# --- queues ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_SHIPMENTS}, m AS (SELECT DISTINCT org_id, unnest(range(7)) AS member FROM sh), o AS (SELECT * FROM sh WHERE status IN ('needs_review', 'open', 'ready')), a AS (SELECT org_id, assigned_to AS member, shipment_id, 0 AS r FROM o WHERE assigned_to IS NOT NULL UNION ALL SELECT org_id, member, shipment_id, 1 FROM o JOIN m USING (org_id) WHERE status = 'ready' AND member < 2)
    SELECT org_id, member, shipment_id, CASE WHEN min(r) = 0 THEN 'assigned' ELSE 'approve' END AS reason FROM a GROUP BY org_id, member, shipment_id""", ("invoices",))  # fmt: skip
def my_work(t: Tables):
    members = t.invoices.select("org_id").distinct().select("org_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("member")).withColumn("may_approve", F.col("member") < 2)
    return workflow.my_work(_shipment_rows(t), members)


@query("""WITH o AS (SELECT DISTINCT shipment_id % 100 AS shipment_id, 'doc' AS ot, doc_id % 500 AS oid FROM invoices UNION SELECT DISTINCT shipment_id % 100, 'ship', shipment_id % 500 FROM invoices), a AS (SELECT event_id, seen_at, CASE WHEN event_id % 2 = 0 THEN 'doc' ELSE 'ship' END AS ot, object_id AS oid, action FROM audit)
    SELECT shipment_id, row_number() OVER (PARTITION BY shipment_id ORDER BY seen_at, event_id) AS place, event_id, ot AS object_type, action FROM a JOIN o USING (ot, oid)""", ("invoices", "audit"))  # fmt: skip
def shipment_timeline(t: Tables):
    ship = (F.col("shipment_id") % 100).alias("shipment_id")
    objects = t.invoices.select(ship, F.lit("doc").alias("object_type"), (F.col("doc_id") % 500).alias("object_id")).unionByName(t.invoices.select(ship, F.lit("ship").alias("object_type"), (F.col("shipment_id") % 500).alias("object_id")))
    return workflow.timeline(t.audit.withColumn("object_type", F.when(F.col("event_id") % 2 == 0, "doc").otherwise("ship")), objects)


@query(f"""WITH {_ISSUES}, s AS (SELECT org_id, code, severity, count(DISTINCT shipment_id) AS n_shipments FROM iss GROUP BY ALL) SELECT org_id, code, severity, currency, count(*) AS n, CAST(sum(amount_at_risk) AS DECIMAL(18,2)) AS at_risk, any_value(n_shipments) AS n_shipments FROM iss JOIN s USING (org_id, code, severity) GROUP BY org_id, code, severity, currency""", ("invoices", "lines"))
def exceptions_by_code(t: Tables):
    return workflow.open_exceptions(rules.total_mismatch(t.invoices, t.lines))


@query("""SELECT lang AS model, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens_in, CAST(sum(n_chars % 100) AS BIGINT) AS tokens_out, CAST(sum(CAST(n_chars AS DECIMAL(18,6)) * 0.000003) AS DECIMAL(18,6)) AS cost FROM documents GROUP BY lang""")
def model_usage(t: Tables):
    calls = t.documents.select(F.col("lang").alias("model"), F.col("n_chars").alias("tokens_in"), (F.col("n_chars") % 100).alias("tokens_out"), (F.col("n_chars").cast("decimal(18,0)") * F.lit("0.000003").cast("decimal(8,6)")).alias("cost"))
    return workflow.model_usage(calls, ["model"])


@query(f"""WITH {_ISSUES}, {_SHIPMENTS}, e AS (SELECT org_id, count(*) AS errors FROM iss GROUP BY org_id) SELECT org_id, count(*) FILTER (status = 'needs_review') AS waiting, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (received_on = DATE '1998-06-15') AS received, min(received_on) FILTER (status = 'needs_review') AS oldest, coalesce(any_value(errors), 0) AS errors FROM sh LEFT JOIN e USING (org_id) GROUP BY org_id""", ("invoices", "lines"))
def digests(t: Tables):
    return workflow.digest(_shipment_rows(t), rules.total_mismatch(t.invoices, t.lines), "1998-06-15")


@query("""WITH o AS (SELECT DISTINCT org_id, CASE org_id % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Shanghai' END AS zone FROM invoices), l AS (SELECT *, timezone(zone, timezone('UTC', TIMESTAMP '2026-01-15 23:30:00')) AS clock FROM o) SELECT org_id, zone, CAST(clock AS DATE) AS day FROM l WHERE hour(clock) >= 7 AND hour(clock) < 10 AND org_id <> 2""", ("invoices",))
def digests_due(t: Tables):
    zone = F.when(F.col("org_id") % 3 == 0, "UTC").when(F.col("org_id") % 3 == 1, "America/New_York").otherwise("Asia/Shanghai")
    orgs = t.invoices.select("org_id").distinct().withColumn("zone", zone)
    sent = orgs.filter("org_id = 2").select("org_id", F.lit("2026-01-16").cast("date").alias("day"))
    return workflow.digest_due(orgs, F.lit("2026-01-15 23:30:00").cast("timestamp"), sent).select("org_id", "zone", "day")


@query("""WITH g AS (SELECT object_id AS key, count(*) FILTER (action = 'error') AS n_failed, bool_or(action = 'signup' AND actor_id % 50 = 0) AS ok, max(seen_at) AS last FROM audit GROUP BY object_id), t AS (SELECT key, CASE WHEN ok THEN 'done' WHEN n_failed >= 40 THEN 'error' ELSE 'retry' END AS state, n_failed FROM g) SELECT * FROM t""", ("audit",))
def retries(t: Tables):
    rows = t.audit.filter("action = 'error' or (action = 'signup' and actor_id % 50 = 0)").select(F.col("object_id").alias("key"), (F.col("action") != "error").alias("ok"), F.col("seen_at").alias("at"))
    plan = workflow.retry_plan(rows, most=40)
    every = t.audit.select(F.col("object_id").alias("key")).distinct().join(plan, "key", "left")
    return every.select("key", F.coalesce("state", F.lit("retry")).alias("state"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


_DECISION = "CASE doc_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'post' WHEN 2 THEN 'reject' ELSE 'reopen' END"
_WAS = "CASE doc_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'approved' WHEN 2 THEN 'posted' WHEN 3 THEN 'rejected' ELSE 'needs_review' END"


@query(f"""WITH r AS (SELECT doc_id, {_WAS} AS status, {_DECISION} AS d, doc_id % 3 AS n_errors, doc_id % 11 <> 0 AS may FROM invoices), x AS (SELECT *, CASE WHEN NOT may THEN 'not allowed' WHEN d = 'approve' AND status <> 'ready' THEN 'not ready' WHEN d = 'approve' AND n_errors > 0 THEN 'open errors' WHEN d = 'post' AND status <> 'approved' THEN 'not approved' WHEN d = 'reopen' AND status NOT IN ('approved', 'rejected') THEN 'not closed' WHEN d = 'reject' AND status = 'posted' THEN 'posted' END AS refused FROM r)
    SELECT doc_id, refused, CASE WHEN refused IS NOT NULL THEN status ELSE CASE d WHEN 'approve' THEN 'approved' WHEN 'post' THEN 'posted' WHEN 'reject' THEN 'rejected' ELSE 'needs_review' END END AS new_status FROM x""", ("invoices",))  # fmt: skip
def decisions(t: Tables):
    rows = t.invoices.select("doc_id", F.expr(_WAS).alias("status"), F.expr(_DECISION).alias("decision"), (F.col("doc_id") % 3).alias("n_errors"), (F.col("doc_id") % 11 != 0).alias("may_approve"))
    return workflow.decide(rows).select("doc_id", "refused", "new_status")


# --- text and keys ---------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[,;\\n]') AS p FROM documents) SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS INT) AS n FROM a""")
def listed_values(t: Tables):
    return t.documents.select("doc_id", F.size(text.listify("text")).alias("n"))


@query("""SELECT conv_id, turn, CAST(len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(^|[^A-Za-z0-9._])@([A-Za-z0-9._-]*[A-Za-z0-9_-])', 2), lambda x: lower(x)))) AS INT) AS n FROM conversations""")
def comment_mentions(t: Tables):
    return t.conversations.select("conv_id", "turn", F.size(text.mentions("text")).alias("n"))


@query(f"""SELECT doc_id, contains(regexp_replace(upper(coalesce(description, '')), '[^A-Z0-9]', '', 'g'), 'DAYS') AS grounded FROM (SELECT doc_id, string_agg(description, ' ' ORDER BY position, part_id, supplier_id, amount) AS description FROM lines GROUP BY doc_id)""", ("lines",))
def grounded_values(t: Tables):
    body = t.lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part_id", "supplier_id", "amount", "description"))), lambda x: x["description"]), " ").alias("body"))
    return body.select("doc_id", text.grounded(F.array(F.lit("days")), "body").alias("grounded"))


_TYPED = ["1,234.50", "soon", "2026-03-08", "usd", "dollars", "a; b, a", ""]
_KINDS = ["amount", "amount", "date", "currency", "currency", "list", "date"]
_TYPED_VALUES = ["1234.50", None, "2026-03-08", "USD", None, "a, b", None]
_TYPED_PROBLEMS = [None, "is not a valid amount", None, None, "is not a valid currency", None, None]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"SELECT c_custkey % 7 AS k, count(*) AS n, {_list(_TYPED_VALUES)}[c_custkey % 7 + 1] AS value, {_list(_TYPED_PROBLEMS)}[c_custkey % 7 + 1] AS problem FROM customer GROUP BY ALL")
def typed_corrections(t: Tables):
    counts = t.customer.groupBy((F.col("c_custkey") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    at = F.col("k").cast("int")
    c = text.corrected_value(F.get(F.array(*map(F.lit, _TYPED)), at), F.get(F.array(*map(F.lit, _KINDS)), at))
    return counts.select("k", "n", c["value"].alias("value"), c["problem"].alias("problem"))


@query("""SELECT event_id, CAST(actor_id AS STRING) || ' recorded ' || action || ' on ' || object_id AS sentence FROM audit""", ("audit",))
def audit_sentences(t: Tables):
    return t.audit.select("event_id", text.audit_sentence("actor_id", "action", "object_id").alias("sentence"))


@query("""WITH a AS (SELECT 'storage' AS name, 'exam' AS code UNION ALL SELECT 'demurrage', 'other'), l AS (SELECT description, lower(description) AS d, count(*) AS n FROM lines GROUP BY ALL) SELECT description, n, CASE WHEN d = 'storage 3 chargeable days' THEN 'exam' WHEN d = 'demurrage 6 days (4 free)' THEN 'other' ELSE NULL END AS alias FROM l""", ("lines",))
def charge_aliases(t: Tables):
    """Charge names that an organisation gave a code of its own, met by their alias key."""
    names = t.lines.groupBy("description").agg(F.count(F.lit(1)).alias("n")).withColumn("key", keys.alias_key("description"))
    own = t.spark.createDataFrame([("Storage 5 chargeable days", "exam"), ("Demurrage 2 days (9 free)", "other")], "name string, alias string").select(keys.alias_key("name").alias("key"), "alias")
    return names.join(F.broadcast(own), "key", "left").select("description", "n", "alias")


@query(f"""WITH a AS (SELECT org_id, shipment_id, doc_id, doc_type = 'bill_of_lading' AS is_bl, received_on, CASE WHEN doc_id % 4 <> 1 THEN 'BL' || doc_id ELSE '' END AS bl, regexp_replace(upper(container), '[^A-Z0-9]', '', 'g') AS box, 'PO' || (doc_id % 3) AS po FROM invoices),
    c AS (SELECT org_id, shipment_id, box, is_bl, bool_or(is_bl) OVER (PARTITION BY org_id, shipment_id) AS has_bl FROM a), x AS (SELECT org_id, shipment_id, string_agg(DISTINCT box, ',' ORDER BY box) AS boxes FROM c WHERE CASE WHEN has_bl THEN is_bl ELSE regexp_full_match(box, '[A-Z]{{3}}[UJZ][0-9]{{7}}') AND {_CHECK.replace('c[', 'box[')} END GROUP BY ALL)
    SELECT a.org_id, a.shipment_id, coalesce(arg_min(bl, (NOT is_bl, received_on, doc_id)) FILTER (bl <> ''), '') AS bl, coalesce(any_value(boxes), '') AS boxes, string_agg(DISTINCT po, ',' ORDER BY po) AS pos FROM a LEFT JOIN x ON x.org_id = a.org_id AND x.shipment_id = a.shipment_id GROUP BY a.org_id, a.shipment_id""", ("invoices",))  # fmt: skip
def shipment_references(t: Tables):
    bl = F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit("BL"), "doc_id")).otherwise("")
    docs = t.invoices.select("org_id", "shipment_id", "doc_id", "received_on", (F.col("doc_type") == "bill_of_lading").alias("is_bl"), bl.alias("bl"), F.array(keys.norm_ref("container")).alias("boxes"), F.array(F.concat(F.lit("PO"), F.col("doc_id") % 3)).alias("pos"))
    return grouping.shipment_references(docs).select("org_id", "shipment_id", "bl", F.array_join("boxes", ",").alias("boxes"), F.array_join("pos", ",").alias("pos"))
