"""Validation, rates and savings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.functions import charges, keys, money, places
from quaywise.operators import rates, rules
from quaywise.sources import adapter

from .registry import Tables, query

_RATE = adapter.fx_sql()
_VK = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(vendor_name), '[^a-z0-9 ]+', ' ', 'g'), '\b(co|company|ltd|limited|llc|inc|corp|corporation|gmbh|sa|as|bv|plc|pte|pvt)\b\.?', ' ', 'g'), '\s+', ' ', 'g'))"""
_REF = "regexp_replace(upper(number), '[^A-Z0-9]', '', 'g')"
_ISSUE = "org_id, shipment_id, doc_id, {code} AS code, {severity} AS severity, {key} AS key, CAST({risk} AS DECIMAL(18,2)) AS amount_at_risk, currency, {code} || ':' || doc_id || ':' || {key} AS fingerprint"


def _issue_sql(code: str, severity: str, key: str = "''", risk: str = "NULL") -> str:
    return _ISSUE.format(code=code if code.startswith(("CASE", "'")) else f"'{code}'", severity=severity if severity.startswith("CASE") else f"'{severity}'", key=key, risk=risk)


@query("""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders), l AS (SELECT l_orderkey AS o_orderkey, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey) AS DECIMAL(18,2)) AS line_sum,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem), x AS (SELECT o.*, l.*, total - line_sum AS over FROM o JOIN l USING (o_orderkey) WHERE i = 1 AND abs(total - line_sum) > 0.02)
    SELECT s_suppkey AS supplier_id, s_name AS vendor, count(*) AS n_mismatched, CAST(coalesce(sum(over) FILTER (over > 0), 0) AS DECIMAL(18,2)) AS at_risk FROM x JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL ORDER BY at_risk DESC, supplier_id LIMIT 20""")  # fmt: skip
def invoice_total_audit(t: Tables):
    """Vendors by the amount by which printed totals exceed the lines; an invoice's vendor is its first line's supplier."""
    docs = t.invoices.filter("doc_id < 1000000000")
    supplier = F.min(F.struct("position", "supplier_id"))["supplier_id"].alias("supplier_id")
    found = rules.overstated(docs, t.lines, supplier).withColumn("amount_at_risk", F.when(F.col("over") > 0, F.col("over")))
    sums = found.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n_mismatched"), F.coalesce(F.sum("amount_at_risk"), F.lit(0)).cast(money.MONEY).alias("at_risk"))
    named = sums.join(t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("vendor")), "supplier_id")
    return named.select("supplier_id", "vendor", "n_mismatched", "at_risk").orderBy(F.col("at_risk").desc(), "supplier_id").limit(20)


@query(f"""WITH s AS (SELECT doc_id, CAST(sum(amount) AS DECIMAL(18,2)) AS line_sum FROM lines GROUP BY doc_id), x AS (SELECT i.*, total - line_sum AS over FROM invoices i JOIN s USING (doc_id) WHERE abs(total - line_sum) > 0.02)
    SELECT {_issue_sql('total_mismatch', 'error', risk='CASE WHEN over > 0 THEN over END')} FROM x""", ("invoices", "lines"))  # fmt: skip
def total_mismatch(t: Tables):
    return rules.total_mismatch(t.invoices, t.lines)


@query(f"""WITH k AS (SELECT *, {_VK} AS vk, {_REF} AS nr FROM invoices WHERE doc_type IN ('freight_invoice','commercial_invoice')),
    x AS (SELECT a.*, (SELECT min(b.doc_id) FROM k b WHERE b.org_id = a.org_id AND b.doc_type = a.doc_type AND b.vk = a.vk AND b.nr = a.nr AND b.total = a.total AND b.doc_id < a.doc_id AND b.received_on <= a.received_on) AS copy_of FROM k a)
    SELECT {_issue_sql('duplicate_invoice', 'error', 'CAST(copy_of AS VARCHAR)', 'total')} FROM x WHERE copy_of IS NOT NULL""", ("invoices",))  # fmt: skip
def duplicate_invoice(t: Tables):
    return rules.duplicates(t.invoices)


@query(f"""WITH k AS (SELECT *, {_VK} AS vk, {_REF} AS nr FROM invoices WHERE doc_type = 'credit_note' OR doc_id % 100 = 57), m AS (SELECT * REPLACE ('credit_note' AS doc_type) FROM k),
    x AS (SELECT a.*, (SELECT min(b.doc_id) FROM m b WHERE b.org_id = a.org_id AND b.vk = a.vk AND b.nr = a.nr AND b.total = a.total AND b.doc_id < a.doc_id AND b.received_on <= a.received_on) AS copy_of FROM m a)
    SELECT {_issue_sql('duplicate_credit_note', 'error', 'CAST(copy_of AS VARCHAR)', 'total')} FROM x WHERE copy_of IS NOT NULL""", ("invoices",))  # fmt: skip
def duplicate_credit_notes(t: Tables):
    """Credit notes received twice; some invoices that were are read as credit notes, so that there are any."""
    docs = t.invoices.withColumn("doc_type", F.when(F.col("doc_id") % 100 == 57, "credit_note").otherwise(F.col("doc_type")))
    return rules.duplicates(docs, ["credit_note"], "duplicate_credit_note")


@query(f"""WITH e AS (SELECT * REPLACE (CASE WHEN doc_id >= 1000000000 AND doc_id % 100 = 57 THEN total + 1 ELSE total END AS total), {_REF} AS nr FROM invoices WHERE doc_type = 'freight_invoice'),
    w AS (SELECT *, first_value(doc_id) OVER v AS f, first_value(total) OVER v AS ft FROM e WINDOW v AS (PARTITION BY org_id, nr ORDER BY received_on, doc_id))
    SELECT {_issue_sql("CASE WHEN total IS NOT DISTINCT FROM ft THEN 'duplicate_customs_entry' ELSE 'customs_entry_changed' END", "CASE WHEN total IS NOT DISTINCT FROM ft THEN 'error' ELSE 'warning' END", 'CAST(f AS VARCHAR)', 'CASE WHEN total IS NOT DISTINCT FROM ft THEN total END')} FROM w WHERE doc_id <> f""", ("invoices",))  # fmt: skip
def duplicate_entries(t: Tables):
    total = F.when((F.col("doc_id") >= 1_000_000_000) & (F.col("doc_id") % 100 == 57), F.col("total") + 1).otherwise(F.col("total")).cast(money.MONEY)
    return rules.changed_copies(t.invoices.filter("doc_type = 'freight_invoice'").withColumn("total", total))


def even(num: str, den: str) -> str:
    """SQL: a whole number over another, rounded half-even; neither is negative."""
    return f"({num} // {den} + CASE WHEN 2 * ({num} % {den}) > {den} OR (2 * ({num} % {den}) = {den} AND ({num} // {den}) % 2 = 1) THEN 1 ELSE 0 END)"


@query(f"""WITH p AS (SELECT *, {_VK} AS vk, CAST(total * 100 AS HUGEINT) AS c, boxes::HUGEINT AS n_box, (CAST(total * 100 AS HUGEINT) * 200000000 + boxes) // (2 * boxes) AS per FROM invoices WHERE doc_type = 'freight_invoice'),
    h AS (SELECT org_id, vk, list(per ORDER BY per) AS all_per FROM p GROUP BY org_id, vk),
    x AS (SELECT p.*, list_concat(all_per[1:list_position(all_per, per) - 1], all_per[list_position(all_per, per) + 1:]) AS o FROM p JOIN h USING (org_id, vk)),
    s AS (SELECT *, o[(len(o) + 1) // 2] + o[len(o) // 2 + 1] AS two FROM x WHERE len(o) >= 3), y AS (SELECT *, {even('two', '200000000')} AS typical FROM s)
    SELECT {_issue_sql('amount_outlier', 'warning', risk='CASE WHEN per > typical * 100000000 THEN CAST(c - typical * n_box AS DECIMAL(18,0)) * 0.01 END')} FROM y WHERE per * 2 > typical * 500000000 OR per < typical * 40000000""", ("invoices",))  # fmt: skip
def vendor_outlier_leave_one_out(t: Tables):
    return rules.outliers(t.invoices)


@query("""WITH h AS (SELECT org_id, shipment_id, bool_or(doc_type = 'bill_of_lading') AS bl, bool_or(doc_type = 'commercial_invoice') AS ci FROM invoices GROUP BY ALL),
    x AS (SELECT org_id, shipment_id, 'missing_bl' AS code FROM h WHERE NOT bl UNION ALL SELECT org_id, shipment_id, 'missing_commercial_invoice' FROM h WHERE NOT ci)
    SELECT org_id, shipment_id, NULL::BIGINT AS doc_id, code, 'warning' AS severity, '' AS key, NULL::DECIMAL(18,2) AS amount_at_risk, NULL::VARCHAR AS currency, code || ':-:' AS fingerprint FROM x""", ("invoices",))  # fmt: skip
def missing_documents(t: Tables):
    return rules.missing_documents(t.invoices)


_CHECK = "(list_sum(list_transform(range(10), lambda i: CASE WHEN c[i + 1] BETWEEN '0' AND '9' THEN CAST(c[i + 1] AS INT) ELSE list_filter(range(10, 39), lambda v: v % 11 <> 0)[ascii(c[i + 1]) - 64] END * (1 << i))) % 11 % 10 = CAST(c[11] AS INT))"


@query(f"""WITH k AS (SELECT *, regexp_replace(upper(container), '[^A-Z0-9]', '', 'g') AS c FROM invoices), v AS (SELECT *, regexp_full_match(c, '[A-Z]{{3}}[UJZ][0-9]{{7}}') AND {_CHECK} AS ok FROM k),
    b AS (SELECT DISTINCT org_id, shipment_id, c FROM v WHERE doc_type = 'bill_of_lading')
    SELECT {_issue_sql('invalid_container', 'error', 'c')} FROM v WHERE NOT ok
    UNION ALL SELECT {_issue_sql('container_not_on_bl', 'error', 'c')} FROM v WHERE ok AND doc_type <> 'bill_of_lading'
      AND EXISTS (SELECT 1 FROM b WHERE b.org_id = v.org_id AND b.shipment_id = v.shipment_id) AND NOT EXISTS (SELECT 1 FROM b WHERE b.org_id = v.org_id AND b.shipment_id = v.shipment_id AND b.c = v.c)""", ("invoices",))  # fmt: skip
def container_checks(t: Tables):
    return rules.container_rules(t.invoices)


_ORIGINAL = "CASE WHEN doc_id % 40 = 0 THEN NULL WHEN doc_id % 40 = 10 THEN 'INV-X' ELSE 'inv ' || CAST(doc_id + CASE WHEN doc_id % 20 = 0 THEN 3 ELSE 7 END AS STRING) END"


@query(f"""WITH n AS (SELECT *, {_ORIGINAL} AS original FROM invoices WHERE doc_type = 'credit_note' AND doc_id < 1000000000), k AS (SELECT *, coalesce(regexp_replace(upper(original), '[^A-Z0-9]', '', 'g'), '') AS o FROM n),
    i AS (SELECT *, {_REF} AS nr FROM invoices WHERE doc_type IN ('freight_invoice','commercial_invoice')),
    m AS (SELECT k.doc_id, arg_min((i.shipment_id, i.total, i.currency), (i.received_on, i.doc_id)) AS f FROM k JOIN i ON i.org_id = k.org_id AND i.nr = k.o AND k.o <> '' AND {_VK.replace('vendor_name', 'i.vendor_name')} = {_VK.replace('vendor_name', 'k.vendor_name')} GROUP BY k.doc_id),
    x AS (SELECT k.*, CASE WHEN o = '' THEN 'credit_no_original' WHEN f IS NULL THEN 'credit_original_not_found' WHEN f[1] IS DISTINCT FROM shipment_id THEN 'credit_original_elsewhere' WHEN f[3] = currency AND abs(total) > f[2] THEN 'credit_exceeds_invoice' END AS what FROM k LEFT JOIN m USING (doc_id))
    SELECT org_id, shipment_id, doc_id, what AS code, 'warning' AS severity, o AS key, NULL::DECIMAL(18,2) AS amount_at_risk, currency, what || ':' || doc_id || ':' || o AS fingerprint FROM x WHERE what IS NOT NULL""", ("invoices",))  # fmt: skip
def credit_notes(t: Tables):
    return rules.credit_notes(t.invoices.filter("doc_type = 'credit_note' and doc_id < 1000000000").withColumn("original", F.expr(_ORIGINAL)), t.invoices)


_NAMES = ["vendor_name", "number", "total", "currency"]
_REQUIRED = {"freight_invoice": _NAMES, "credit_note": ["vendor_name", "number"]}
_VALUES = {
    "vendor_name": "CASE WHEN doc_id % 23 = 0 THEN '' ELSE vendor_name END", "number": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE number END",
    "total": "CAST(total AS STRING)", "currency": "currency",
}
_CONFIDENCE = "CASE WHEN doc_id % 31 = 5 AND name IN ('number', 'total') THEN 0.7 ELSE 0.95 END"


@query(f"""WITH f AS (SELECT org_id, shipment_id, doc_id, doc_type, {', '.join(f"{e} AS v_{c}" for c, e in _VALUES.items())} FROM invoices),
    m AS (SELECT *, list_filter(CASE doc_type WHEN 'freight_invoice' THEN [{', '.join(f"CASE WHEN coalesce(trim(v_{c}), '') IN ('', '[]') THEN '{c}' END" for c in _NAMES)}] WHEN 'credit_note' THEN [CASE WHEN coalesce(trim(v_vendor_name), '') = '' THEN 'vendor_name' END, CASE WHEN coalesce(trim(v_number), '') = '' THEN 'number' END] ELSE [] END, lambda x: x IS NOT NULL) AS lack FROM f),
    x AS (SELECT org_id, shipment_id, doc_id, 'missing_field' AS code, 'error' AS severity, array_to_string(lack, ',') AS key FROM m WHERE len(lack) > 0 UNION ALL SELECT org_id, shipment_id, doc_id, 'low_confidence', 'warning', 'number,total' FROM f WHERE doc_id % 31 = 5 AND doc_id % 7 <> 0)
    SELECT org_id, shipment_id, doc_id, code, severity, key, NULL::DECIMAL(18,2) AS amount_at_risk, NULL::VARCHAR AS currency, code || ':' || doc_id || ':' || key AS fingerprint FROM x""", ("invoices",))  # fmt: skip
def field_checks(t: Tables):
    pairs = F.explode(F.create_map(*[x for c, e in _VALUES.items() for x in (F.lit(c), F.expr(e))])).alias("name", "value")
    fields = t.invoices.select("org_id", "shipment_id", "doc_id", "doc_type", pairs)
    fields = fields.withColumns({"confidence": F.expr(_CONFIDENCE), "source": F.when(F.col("doc_id") % 7 == 0, "human").otherwise("machine")})
    return rules.field_rules(fields, _REQUIRED)


# --- rates -----------------------------------------------------------------------------------------------------------

_QUOTE = {
    "org_id": "o_custkey % 20", "quote_id": "o_orderkey", "vendor_key": "'harbor ' || CAST(o_custkey % 37 AS STRING) || ' logistics'", "valid_from": "CAST(o_orderdate AS DATE)",
    "valid_to": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(400 AS INT) END", "origin": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CNNGB' ELSE 'CNSHA' END",
    "destination": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'USLAX' WHEN 2 THEN 'USNYC' ELSE 'USLGB' END", "equipment": "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '40HC' ELSE '20GP' END",
}
_QUOTES = "quotes AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _QUOTE.items()) + " FROM orders)"
_AREA = "CASE {c} WHEN 'USLGB' THEN 'la' WHEN 'USLAX' THEN 'la' ELSE {c} END"


def _quotes(t: Tables):
    q = t.orders.selectExpr(*[f"{e} AS {c}" for c, e in _QUOTE.items()])
    return q.withColumns({f"{c}_area": F.expr(_AREA.format(c=c)) for c in ("origin", "destination")})


def _context(t: Tables):
    inv = t.invoices.filter("doc_type = 'freight_invoice'").withColumns({"vendor_key": keys.vendor_key("vendor_name"), "ship_date": F.col("invoice_date")})
    return inv.withColumns({f"{c}_area": F.expr(_AREA.format(c=c)) for c in ("origin", "destination")})


def _place(c: str) -> str:
    return f"CASE WHEN q.{c} IS NULL THEN 5 WHEN i.{c} IS NULL THEN 6 WHEN q.{c} = i.{c} THEN 10 WHEN {_AREA.format(c=f'q.{c}')} = {_AREA.format(c=f'i.{c}')} THEN 8 END"


@query(f"""WITH {_QUOTES}, i AS (SELECT org_id, doc_id, {_VK} AS vendor_key, invoice_date AS d, origin, destination, equipment FROM invoices WHERE doc_type = 'freight_invoice'),
    p AS (SELECT i.*, q.quote_id, q.valid_from AS vf, q.origin AS qo, q.destination AS qd, q.equipment AS qe, CASE WHEN q.valid_from <= d AND (q.valid_to IS NULL OR d <= q.valid_to) THEN {_place('origin')} + {_place('destination')} + CASE WHEN q.equipment IS NULL THEN 5 WHEN i.equipment IS NULL THEN 6 WHEN q.equipment = i.equipment THEN 10 END END AS s
      FROM i LEFT JOIN quotes q ON q.org_id = i.org_id AND q.vendor_key = i.vendor_key),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC NULLS LAST, vf DESC, quote_id DESC) AS nth, count(s) OVER w AS n_fit, count(quote_id) OVER w AS n_file FROM p WINDOW w AS (PARTITION BY doc_id)),
    u AS (SELECT doc_id, count(DISTINCT coalesce(qo, '')) AS no, count(DISTINCT coalesce(qd, '')) AS nd, count(DISTINCT coalesce(qe, '')) AS ne FROM p WHERE s IS NOT NULL GROUP BY doc_id)
    SELECT org_id, doc_id, CASE WHEN n_file = 0 THEN 'none_on_file' WHEN n_fit = 0 THEN 'no_match' WHEN (origin IS NULL AND qo IS NOT NULL AND no > 1) OR (destination IS NULL AND qd IS NOT NULL AND nd > 1) OR (equipment IS NULL AND qe IS NOT NULL AND ne > 1) THEN 'ambiguous' ELSE 'matched' END AS outcome,
      CASE WHEN s IS NOT NULL THEN quote_id END AS quote_id, n_fit FROM r LEFT JOIN u USING (doc_id) WHERE nth = 1""", ("invoices",))  # fmt: skip
def interval_quote_match(t: Tables):
    return rates.choose_quote(_context(t), _quotes(t))


_RULES = """(VALUES (1, 'demurrage', NULL, NULL, 'day', 4, 500.00, NULL), (2, 'demurrage', DATE '1998-01-01', NULL, 'day', 0, 900.00, 20000.00), (3, 'storage', DATE '1996-01-01', DATE '1999-12-31', 'day', 2, 4000.00, NULL),
    (4, 'detention', NULL, NULL, 'day', 3, 100.00, NULL), (5, 'waiting_time', NULL, NULL, 'hour', 1, 30000.00, NULL), (6, 'exam', NULL, NULL, 'each', 0, NULL, NULL), (7, 'chassis_split', DATE '1997-06-01', NULL, 'each', 0, NULL, 25000.00))
    AS r(rule_id, code, valid_from, valid_to, unit, free_units, max_per_unit, max_amount)"""
_CODE_OF = {0: "ocean_freight", 1: "thc_destination", 2: "demurrage", 3: "storage", 4: "demurrage", 5: "waiting_time", 6: "chassis_split", 7: "chassis", 8: "exam", 9: "customs_clearance", 10: "baf", 11: "trucking", 12: "thc_origin", 13: "documentation", 14: "detention", 15: "other"}
_CODE_SQL = "CASE part_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CODE_OF.items()) + " END"


def _approval_rules(t: Tables):
    r = t.spark.sql(f"SELECT * FROM {_RULES}")
    return r.withColumns({c: F.col(c).cast(money.MONEY) for c in ("max_per_unit", "max_amount")})


def _extras(t: Tables):
    rows = charges.with_codes(t.lines).filter(charges.is_accessorial("code"))
    return rows.withColumn("key", F.xxhash64("doc_id", "position", "part_id", "supplier_id", "amount"))


@query(f"""WITH l AS (SELECT *, {_CODE_SQL} AS code FROM lines), r AS (SELECT * FROM {_RULES})
    SELECT doc_id, position, amount, code, (SELECT arg_max(rule_id, (valid_from IS NOT NULL, coalesce(valid_from, DATE '0001-01-01'), rule_id)) FROM r WHERE r.code = l.code AND (r.valid_from IS NULL OR r.valid_from <= billed_on) AND (r.valid_to IS NULL OR billed_on <= r.valid_to)) AS rule_id
    FROM l WHERE code IN ('demurrage','storage','detention','waiting_time','exam','chassis_split','other')""", ("lines",))  # fmt: skip
def approval_rule_asof(t: Tables):
    row = ["doc_id", "position", "part_id", "supplier_id", "amount", "code", "billed_on"]
    found = rates.latest_rule(_extras(t).withColumn("n", F.lit(1)), _approval_rules(t), ["code"], "billed_on", row)
    return found.select("doc_id", "position", "amount", "code", F.col("rule.r_rule_id").alias("rule_id"))


_UNITS = "CASE part_id % 16 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 8 THEN 1 WHEN 15 THEN 1 END"


@query(f"""WITH l AS (SELECT *, {_CODE_SQL} AS code, {_UNITS} AS u FROM lines), r AS (SELECT * FROM {_RULES}),
    p AS (SELECT l.doc_id, l.code, amount, r.rule_id, max_per_unit, max_amount, CAST(round_even(CASE WHEN part_id % 16 = 3 THEN u ELSE greatest(0, u - free_units) END * max_per_unit, 2) AS DECIMAL(18,2)) AS part FROM l LEFT JOIN r ON r.code = l.code AND r.valid_from IS NULL WHERE l.code IN ('demurrage','storage','detention','waiting_time','exam','chassis_split','other')),
    g AS (SELECT doc_id, code, CAST(sum(amount) AS DECIMAL(18,2)) AS actual, max(rule_id) AS rule_id, max(max_per_unit) AS per, max(max_amount) AS most, count(*) FILTER (part IS NULL) AS unread, CAST(sum(part) AS DECIMAL(18,2)) AS s FROM p GROUP BY ALL),
    v AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'unapproved' WHEN per IS NULL AND most IS NULL THEN 'no_cap' WHEN per IS NOT NULL AND unread > 0 AND most IS NULL THEN 'unreadable' ELSE 'capped' END AS verdict FROM g),
    a AS (SELECT *, CAST(CASE verdict WHEN 'unapproved' THEN 0 WHEN 'no_cap' THEN actual WHEN 'capped' THEN CASE WHEN per IS NOT NULL AND unread = 0 THEN least(s, coalesce(most, s)) ELSE most END END AS DECIMAL(18,2)) AS allowed FROM v)
    SELECT doc_id, code, actual, verdict, allowed, CAST(actual - allowed AS DECIMAL(18,2)) AS excess FROM a""", ("lines",))  # fmt: skip
def accessorials_allowed(t: Tables):
    r = _approval_rules(t).filter("valid_from is null").select("code", F.struct(*[F.col(c).alias(f"r_{c}") for c in ("rule_id", "unit", "free_units", "max_per_unit", "max_amount")]).alias("rule"))
    return rates.allowed_by_approval(_extras(t).withColumn("quantity", F.lit(None).cast("string")).join(r, "code", "left"))


#: What the quote of every invoice allows, in dollars.
_QUOTED = "array(" + ", ".join(f"struct('{c}' AS code, CAST({a} AS DECIMAL(18,2)) AS allowed, {p} AS per_box)" for c, a, p in (("ocean_freight", "24000.00", "true"), ("thc_destination", "3500.00", "true"), ("documentation", "75.00", "false"))) + ")"


@query(f"""WITH i AS (SELECT doc_id, currency, boxes FROM invoices WHERE doc_type = 'freight_invoice' AND doc_id < 1000000000), l AS (SELECT l.*, {_CODE_SQL} AS code FROM lines l JOIN i USING (doc_id)),
    f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND code NOT IN ('ocean_freight','thc_destination','documentation') THEN 'ocean_freight' ELSE code END AS code, amount FROM l),
    s AS (SELECT doc_id, f.code, CAST(sum(amount) AS DECIMAL(18,2)) AS actual, max(i.boxes) AS boxes, max(i.currency) AS currency FROM f JOIN i USING (doc_id) GROUP BY ALL),
    q AS (SELECT * FROM (VALUES ('ocean_freight', 24000.00, true), ('thc_destination', 3500.00, true), ('documentation', 75.00, false)) AS v(code, allowed, per_box)),
    h AS (SELECT s.*, q.allowed, CAST(allowed * CASE WHEN per_box THEN boxes ELSE 1 END AS DECIMAL(18,2)) AS asked FROM s LEFT JOIN q USING (code)),
    a AS (SELECT *, CAST(CASE WHEN allowed IS NULL THEN 0 WHEN currency = 'USD' THEN asked ELSE round_even(CAST(asked AS DECIMAL(28,10)) / CAST(round_even({_RATE}, 2) AS DECIMAL(18,2)), 2) END AS DECIMAL(18,2)) AS allowed_total FROM h),
    e AS (SELECT *, CAST(actual - allowed_total AS DECIMAL(18,2)) AS excess, CAST(greatest(round_even(abs(allowed_total) * 0.02, 2), 5.00) AS DECIMAL(18,2)) AS tolerance FROM a WHERE allowed_total IS NOT NULL)
    SELECT doc_id, code, actual, allowed_total, excess, tolerance FROM e WHERE excess > tolerance""", ("invoices", "lines"))  # fmt: skip
def over_quote(t: Tables):
    inv = t.invoices.filter("doc_type = 'freight_invoice' and doc_id < 1000000000").select("doc_id", "currency", "boxes", (F.col("doc_id") % 2 == 0).alias("all_in"), adapter.fx_rate(F.col("currency")).alias("rate"))
    per_doc = inv.withColumn("q", F.explode(F.expr(_QUOTED))).select("doc_id", "currency", "q.*").select("doc_id", "code", "allowed", "per_box", F.lit("1").cast("decimal(18,8)").alias("quote_rate"), (F.col("currency") == "USD").alias("same_currency"))
    lines = charges.with_codes(t.lines.select("doc_id", "description", "amount")).join(inv, "doc_id")
    return rates.over_quote(lines, per_doc)


_CATCH = {
    "org_id": "org_id", "catch_id": "doc_id", "scope": "CASE WHEN doc_id % 8 = 0 THEN 's' ELSE 'd' END || CAST(shipment_id AS STRING)", "vendor": "vendor_name",
    "code": "CASE doc_id % 7 WHEN 0 THEN 'amount_outlier' WHEN 1 THEN 'unapproved_accessorial' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'duplicate_invoice' ELSE 'over_quote' END ELSE 'over_quote' END",
    "caught": "total", "latest": "CASE doc_id % 3 WHEN 0 THEN total WHEN 1 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(total - CAST(100 AS DECIMAL(18,2)) AS DECIMAL(18,2)) END",
    "shipment_status": "CASE WHEN doc_id % 19 = 0 THEN 'rejected' WHEN status = 'posted' THEN 'posted' ELSE 'needs_review' END", "issue_open": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE true END",
    "issue_resolved": "doc_id % 6 = 0", "cleared_reason": "CASE WHEN doc_id % 10 = 0 THEN 'rates' ELSE 'invoice' END", "month": "invoice_date",
}
_OUTCOME = f"""catches AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _CATCH.items())} FROM invoices), b AS (SELECT *, least(latest, caught) AS lt, shipment_status = 'rejected' AS rej, issue_open IS NULL AS gone, issue_open IS NULL AND cleared_reason = 'rates' AS rts, shipment_status = 'posted' OR issue_resolved AS paid FROM catches),
    outc AS (SELECT *, CASE WHEN rej THEN 'prevented' WHEN rts THEN 'withdrawn' WHEN gone THEN 'prevented' WHEN lt > 0 THEN CASE WHEN paid THEN 'accepted' ELSE 'at_risk' END ELSE 'prevented' END AS outcome,
      CAST(CASE WHEN rej OR (gone AND NOT rts) THEN caught ELSE greatest(caught - lt, 0) END AS DECIMAL(18,2)) AS prevented, CAST(CASE WHEN NOT rej AND rts THEN lt ELSE 0 END AS DECIMAL(18,2)) AS withdrawn,
      CAST(CASE WHEN NOT rej AND NOT gone AND paid THEN lt ELSE 0 END AS DECIMAL(18,2)) AS accepted, CAST(CASE WHEN NOT rej AND NOT gone AND NOT paid THEN lt ELSE 0 END AS DECIMAL(18,2)) AS at_risk FROM b)"""


def _caught(t: Tables):
    return rates.outcomes(t.invoices.selectExpr(*[f"{e} AS {c}" for c, e in _CATCH.items()]))


@query(f"WITH {_OUTCOME} SELECT catch_id, outcome, prevented, withdrawn, accepted, at_risk FROM outc", ("invoices",))
def savings_outcomes(t: Tables):
    return _caught(t).select("catch_id", "outcome", "prevented", "withdrawn", "accepted", "at_risk")


@query(f"""WITH {_OUTCOME}, w AS (SELECT *, scope LIKE 'd%' AND outcome <> 'withdrawn' AS tk FROM outc), g AS (SELECT *, bool_or(code = 'duplicate_invoice') OVER p AS whole, coalesce(sum(caught) FILTER (code IN ('over_quote','unapproved_accessorial')) OVER p, 0) AS ln FROM w WINDOW p AS (PARTITION BY org_id, scope, tk))
    SELECT catch_id, CAST(CASE WHEN NOT tk THEN 1 WHEN whole THEN CASE WHEN code = 'duplicate_invoice' THEN 1 ELSE 0 END WHEN ln <> 0 AND code = 'amount_outlier' AND caught > 0 THEN round(CAST(greatest(0, caught - ln) AS DOUBLE) / CAST(caught AS DOUBLE), 6) ELSE 1 END AS DOUBLE) AS factor FROM g""", ("invoices",))  # fmt: skip
def overlap_factors(t: Tables):
    return rates.overlap_factor(_caught(t)).select("catch_id", F.round(F.col("factor").cast("double"), 6).alias("factor"))


@query(f"""WITH {_OUTCOME}, m AS (SELECT org_id, code, vendor, CAST(date_trunc('month', month) AS DATE) AS month, prevented, at_risk, accepted FROM outc WHERE outcome <> 'withdrawn')
    SELECT org_id, code, vendor, month, CAST(sum(prevented) AS DECIMAL(18,2)) AS prevented, CAST(sum(at_risk) AS DECIMAL(18,2)) AS at_risk, CAST(sum(accepted) AS DECIMAL(18,2)) AS accepted, count(*) AS n,
      CASE WHEN grouping(code) = 0 THEN 'code' WHEN grouping(vendor) = 0 THEN 'vendor' WHEN grouping(month) = 0 THEN 'month' ELSE 'all' END AS level, CAST(sum(prevented) + sum(at_risk) + sum(accepted) AS DECIMAL(18,2)) AS caught
    FROM m GROUP BY GROUPING SETS ((org_id), (org_id, code), (org_id, vendor), (org_id, month))""", ("invoices",))  # fmt: skip
def grouping_sets_savings(t: Tables):
    return rates.savings_sets(_caught(t).filter("outcome <> 'withdrawn'").withColumn("month", F.trunc("month", "month")))


@query(None)
def savings_ledger(t: Tables):
    """Issue events from the audit stream folded into catches: every fifth event deletes the issue, every seventh is a change of rates."""
    e = t.audit.select(
        (F.col("object_id") % 20).alias("org_id"), F.concat(F.lit("d"), F.col("object_id")).alias("scope"), F.col("action").alias("catch_key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 5 != 0, F.col("amount")).alias("amount"), F.when(F.col("event_id") % 7 == 0, "rates").alias("reason"),
    )
    return rates.fold_ledger(e)


_PLACES = ["Port of Long Beach, CA, USA", "Ningbo-Zhoushan", "Shenzhen (Yantian)", "CN SHA terminal", "nlrtm", "Nowhere special", "Jebel Ali / Dubai"]


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Port of Long Beach, CA, USA' WHEN 1 THEN 'Ningbo-Zhoushan' WHEN 2 THEN 'Shenzhen (Yantian)' WHEN 3 THEN 'CN SHA terminal' WHEN 4 THEN 'nlrtm' WHEN 5 THEN 'Nowhere special' ELSE 'Jebel Ali / Dubai' END AS place FROM customer)
    SELECT place, CASE place WHEN 'Port of Long Beach, CA, USA' THEN 'USLGB' WHEN 'Ningbo-Zhoushan' THEN 'CNNGB' WHEN 'Shenzhen (Yantian)' THEN 'CNYTN' WHEN 'CN SHA terminal' THEN 'CNSHA' WHEN 'nlrtm' THEN 'NLRTM' WHEN 'Jebel Ali / Dubai' THEN 'AEJEA' ELSE 'nowhere special' END AS place_key, count(*) AS n FROM p GROUP BY ALL""")  # fmt: skip
def place_resolve(t: Tables):
    chain = F.get(F.array(*map(F.lit, _PLACES)), (F.col("c_custkey") % 7).cast("int"))
    counts = t.customer.select(chain.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))  # distinct names only
    return counts.select("place", places.place_key("place").alias("place_key"), "n")


@query(f"SELECT description, {_CODE_SQL.replace('part_id % 16', 'min(part_id % 16)')} AS code, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM lines GROUP BY description", ("lines",))
def keyword_classify(t: Tables):
    sums = t.lines.groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(money.MONEY).alias("amount"))
    return sums.select("description", charges.classify("description").alias("code"), "n", "amount")


@query(f"""WITH c AS (SELECT amount, {_CODE_SQL} AS code FROM lines) SELECT CASE WHEN code IN ('ocean_freight','baf','caf','thc_origin','documentation','bl_fee','security_filing','insurance','congestion','hazmat') THEN 'freight'
    WHEN code IN ('thc_destination','customs_clearance','exam','demurrage','storage') THEN 'destination' WHEN code = 'other' THEN 'other' ELSE 'delivery' END AS charge_group,
    CASE WHEN code IN ('ocean_freight','baf','trucking','chassis','chassis_split','waiting_time') THEN 'freight' WHEN code IN ('thc_origin','thc_destination','storage','demurrage','detention','exam') THEN 'handling' ELSE 'other' END AS category,
    count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM c GROUP BY ALL""", ("lines",))  # fmt: skip
def charge_groups(t: Tables):
    by_name = t.lines.groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).withColumn("code", charges.classify("description"))
    sums = by_name.groupBy(charges.group_of("code").alias("charge_group"), charges.category_of("code").alias("category"))
    return sums.agg(F.sum("n").alias("n"), F.sum("amount").cast(money.MONEY).alias("amount"))


@query(f"SELECT doc_id, {_VK} AS vendor_key, {_REF} AS ref, substring({_VK} || '|' || CASE WHEN {_REF} <> '' THEN {_REF} END, 1, 260) AS product_key FROM invoices", ("invoices",))
def normalize_keys(t: Tables):
    return t.invoices.select("doc_id", keys.vendor_key("vendor_name").alias("vendor_key"), keys.norm_ref("number").alias("ref"), keys.product_key("vendor_name", "number", F.lit("")).alias("product_key"))


@query(f"SELECT part_id % 16 AS k, description, CAST({_UNITS.replace('WHEN 6 THEN 1 WHEN 8 THEN 1 WHEN 15 THEN 1 ', '').replace('WHEN 5 THEN 2', 'WHEN 7 THEN 2')} AS DOUBLE) AS units, CASE part_id % 16 WHEN 2 THEN 4 END AS free, part_id % 16 = 3 AS chargeable FROM lines GROUP BY ALL", ("lines",))
def units_on_line(t: Tables):
    names = t.lines.select((F.col("part_id") % 16).alias("k"), "description").distinct()
    u = charges.units_on_line("description", F.lit(None).cast("string"), "day")
    return names.select("k", "description", u["units"].alias("units"), u["free"].alias("free"), u["chargeable"].alias("chargeable"))
