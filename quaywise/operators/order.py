"""Places and running sums within groups of any size: ranges of the order are numbered on their own, then moved by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.sources.scratch import materialise


def placed(rows: DataFrame, by: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 1 within a group in ``order``, and ``upto``, the running sum of ``value`` if one is named.

    ``order`` must tell the rows of a group apart and ``by`` may not be null. Rows are dealt by range over group and order and written, so
    a group of a third of all rows spans a third of the partitions; each range is numbered within itself, and what comes
    before it in its group is a prefix sum over as many rows as there are ranges.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    w = Window.partitionBy("_part", *by).orderBy(*order)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(value).alias("_s")] if value else [])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part", *by).agg(*sums)
    first = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")] + ([F.sum("_s").over(before).alias("_s0")] if value else [])
    out = dealt.withColumn("place", F.row_number().over(w).cast("long"))
    if value:
        out = out.withColumn("upto", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(offsets.select("_part", *by, *first), ["_part", *by]).withColumn("place", F.col("place") + F.col("_n0"))
    if value:
        out = out.withColumn("upto", F.when(F.col("_s0").isNull(), F.col("upto")).otherwise(F.col("upto") + F.col("_s0")))
    return out.drop("_part", "_n0", "_s0")


def beside(rows: DataFrame, by: list[str], columns: dict[str, str], step: int) -> DataFrame:
    """``placed`` rows with the columns named (old: new) of the row ``step`` places after (before, if negative); null at the ends."""
    other = rows.select(*by, (F.col("place") - step).alias("place"), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(other, [*by, "place"], "left")
