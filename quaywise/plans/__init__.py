"""Queries over the adapter's views. Importing the package registers all of them."""

from . import close_queries, record_queries, report_queries, rule_queries, shipment_queries, workflow_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
