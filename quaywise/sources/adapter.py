"""Views of the benchmark's star schema in the shape of the payables model, from one text for both engines.

Each view is a list of (table, projection, condition). Spark reads the projection with selectExpr, so scans stay pruned;
``ctes`` writes the same views as common table expressions for a second engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_INVOICE = {
    "org_id": "o_custkey % 20",
    "doc_id": "o_orderkey",
    "shipment_id": "CAST(floor(o_orderkey / 4) AS BIGINT)",
    "doc_type": "CASE o_orderkey % 10 WHEN 0 THEN 'credit_note' WHEN 1 THEN 'commercial_invoice' WHEN 2 THEN 'bill_of_lading' ELSE 'freight_invoice' END",
    "vendor_name": "CASE o_orderkey % 3 WHEN 0 THEN 'Harbor ' || CAST(o_custkey % 37 AS STRING) || ' Logistics, LLC' WHEN 1 THEN 'HARBOR ' || CAST(o_custkey % 37 AS STRING) || ' LOGISTICS LLC.' ELSE 'Harbor ' || CAST(o_custkey % 37 AS STRING) || ' Logistics' END",
    "number": "'INV-' || CAST(o_orderkey AS STRING)",
    "currency": "CASE o_orderkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN CASE WHEN o_orderkey % 66 = 2 THEN 'AED' ELSE 'USD' END ELSE 'USD' END",
    "total": "CAST(o_totalprice AS DECIMAL(18,2))",
    "invoice_date": "CAST(o_orderdate AS DATE)",
    "received_on": "CAST(o_orderdate AS DATE)",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'needs_review' ELSE 'posted' END",
    "priority": "o_orderpriority",
    "boxes": "1 + o_orderkey % 4",
    "origin": "CASE o_custkey % 4 WHEN 0 THEN 'CNSHA' WHEN 1 THEN 'CNNGB' WHEN 2 THEN 'VNSGN' ELSE NULL END",
    "destination": "CASE o_orderkey % 3 WHEN 0 THEN 'USLGB' WHEN 1 THEN 'USNYC' ELSE 'NLRTM' END",
    "equipment": "CASE o_orderkey % 5 WHEN 0 THEN '20GP' WHEN 1 THEN NULL ELSE '40HC' END",
    "container": "CASE WHEN o_orderkey % 9 = 4 THEN 'oslu ' ELSE 'OSLU' END || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || CAST(o_orderkey % 10 AS STRING)",
}
_AGAIN = _INVOICE | {"doc_id": "o_orderkey + 1000000000", "received_on": "CAST(o_orderdate AS DATE) + CAST(3 AS INT)", "number": "'inv ' || CAST(o_orderkey AS STRING)"}
_LINE = {
    "doc_id": "l_orderkey",
    "position": "l_linenumber",
    "part_id": "l_partkey",
    "supplier_id": "l_suppkey",
    "description": "CASE l_partkey % 16 WHEN 0 THEN 'Ocean freight 40HC' WHEN 1 THEN 'THC & handling at destination' WHEN 2 THEN 'Demurrage 6 days (4 free)' WHEN 3 THEN 'Storage 3 chargeable days' WHEN 4 THEN 'D&D charges' WHEN 5 THEN 'Driver detention 2 hrs' WHEN 6 THEN 'Chassis split' WHEN 7 THEN 'Chassis x 2' WHEN 8 THEN 'Customs exam fee' WHEN 9 THEN 'Customs entry filing' WHEN 10 THEN 'Bunker adjustment (BAF)' WHEN 11 THEN 'Trucking / drayage' WHEN 12 THEN 'OTHC' WHEN 13 THEN 'Documentation fee' WHEN 14 THEN 'Detention' ELSE 'Miscellaneous' END",
    "quantity": "CAST(l_quantity AS DECIMAL(18,2))",
    "amount": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "duty_rate": "CAST(l_discount * 100 AS DECIMAL(9,4))",
    "billed_on": "CAST(l_shipdate AS DATE)",
    "returned": "l_returnflag",
}
VIEWS: dict[str, list[tuple[str, dict[str, str], str]]] = {
    "invoices": [("orders", _INVOICE, "true"), ("orders", _AGAIN, "o_orderkey % 50 = 7")],
    "lines": [("lineitem", _LINE, "true")],
    "audit": [("events", {"event_id": "event_id", "seen_at": "ts", "actor_id": "user_id", "action": "event_type", "amount": "CAST(value AS DECIMAL(18,2))", "data": "props", "object_id": "event_id % 500"}, "true")],
}
#: Rates to the home currency; others have none.
FX = {"USD": "1.00000000", "EUR": "1.08370000", "GBP": "1.27000000"}
HOME = "USD"
#: The day that reports are run on.
TODAY = "2001-08-01"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = [
        spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition).selectExpr(*(f"{e} AS {c}" for c, e in cols.items()))
        for table, cols, condition in VIEWS[name]
    ]
    return reduce(DataFrame.unionByName, parts)


def ctes(*names: str) -> str:
    """'WITH invoices AS (...), ...' for the views named."""

    def body(name: str) -> str:
        return " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {table} WHERE {condition}" for table, cols, condition in VIEWS[name])

    return "WITH " + ", ".join(f"{n} AS ({body(n)})" for n in names)


def fx_sql(currency: str = "currency") -> str:
    """SQL, in either dialect: the rate of a currency to the home currency, null if unknown."""
    return f"CASE {currency} " + " ".join(f"WHEN '{c}' THEN CAST({r} AS DECIMAL(18,8))" for c, r in FX.items()) + " END"


def fx_rate(currency):
    """Column form of fx_sql."""
    from pyspark.sql import functions as F

    chain = F.when(F.lit(False), F.lit(None).cast("decimal(18,8)"))
    for c, r in FX.items():
        chain = chain.when(currency == c, F.lit(r).cast("decimal(18,8)"))
    return chain
