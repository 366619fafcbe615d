"""Queries by name, each with the SQL that states it for a second engine where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaywise.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Driver tables and adapter views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapter.VIEWS:
            return adapter.view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of Tables under its name. ``views`` are put before ``sql`` as common table expressions."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                body = adapter.ctes(*views) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
            ORACLE_SQL[f.__name__] = body
        return f

    return register
