"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text counts no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def shard_by_bytes(rows: DataFrame, size: str, order: list[str], shards: int = 8) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless within its shard) to ``rows``.

    Rows are dealt by range of ``order``, each partition's bytes are totalled, and a prefix sum over those totals
    (one row a partition) tells each partition where it begins. Within a partition a running sum does the rest, so
    no task sees more than its own range. A row goes to the shard that the middle of its bytes falls into, which
    keeps every shard within one row of its equal share.

    Order: nulls first, then by ``order``; rows that agree in all of it are interchangeable. An empty table gives an
    empty result. ``rows`` should be narrow (keys and sizes, no texts): it is written once to shared storage. Columns
    beginning with ``_s_`` are reserved; any other extra columns are kept.
    """
    # rows that agree in all keys are told apart by their place in the input, so that many of them spread over ranges
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.col("_s_tie")]
    dealt = materialise(rows.withColumn("_s_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("_s_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_s_part").agg(F.sum(size).alias("_s_bytes"), F.count(F.lit(1)).alias("_s_rows"))
    before = Window.orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_s_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = totals.select(  # one row for each partition
        F.col("_s_part"),
        F.coalesce(F.sum("_s_bytes").over(before), F.lit(0)).alias("_s_bytes_before"),
        F.coalesce(F.sum("_s_rows").over(before), F.lit(0)).alias("_s_rows_before"),
        F.sum("_s_bytes").over(everything).alias("_s_total"),
    )
    own = Window.partitionBy("_s_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumns({"_s_running": F.sum(size).over(own), "_s_nth": F.row_number().over(own)})
        .join(F.broadcast(begins), "_s_part")
        .withColumn("_s_row", F.col("_s_rows_before") + F.col("_s_nth") - 1)
        .withColumn("_s_twice", 2 * (F.col("_s_bytes_before") + F.col("_s_running")) - F.col(size))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(_s_twice * {shards} div (2 * _s_total) as int)")))
    )
    first = placed.groupBy("shard").agg(F.min("_s_row").alias("_s_first"))  # one row for each shard
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_s_row") - F.col("_s_first")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_s_")])


def op9_byte_shards(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``: eight shards of nearly equal bytes, in order of doc_id."""
    rows = docs.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_by_bytes(rows, "size", ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 has no function in DuckDB: the table of 256 is built by eight shift steps, and each text folded over it.
ORACLE_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT)) AS t
), bytes AS (
  SELECT doc_id, row_number() OVER () AS k, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents
), rows AS (
  SELECT doc_id, k, size,
         xor(4294967295::BIGINT, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM bytes, steps
), placed AS (
  SELECT *, least(7, ((2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, k) - size) * 8) // (2 * sum(size) OVER ())) AS shard
  FROM rows
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, k) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""
