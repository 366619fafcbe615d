"""A text index for searches: postings of three neighbouring characters, sorted so that a search reads the files of its own, and a check of the hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a posting; shorter searches have none and read all texts.
GRAM = 3


def write_postings(rows: DataFrame, key: list[str], columns: list[str], path: str) -> DataFrame:
    """Write the index of ``rows`` and return it: gram (its hash) and ``key``, a row for each three characters of the lower-case text columns of a row.

    Rows are dealt by range of gram and key, so a gram of a third of all rows spans a third of the files, and a file holds few grams: a
    search's filter skips the others by the grams' bounds that are kept with each part of a file. Nulls are empty. What a key has
    several times is posted as often, and grams whose hashes collide are found together; a search checks the texts, so it loses nothing by that.
    """
    texts = rows.select(*key, F.explode(F.array(*map(_plain, columns))).alias("_text")).filter(F.length("_text") >= GRAM)
    each = texts.select(*key, "_text", F.explode(F.sequence(F.lit(1), F.length("_text") - (GRAM - 1))).alias("_at"))
    each = each.select(*key, F.xxhash64(F.substring("_text", F.col("_at"), F.lit(GRAM))).alias("gram"))
    each.repartitionByRange("gram", *key).sortWithinPartitions("gram").write.parquet(path)
    return rows.sparkSession.read.schema(each.schema).parquet(path)


def _plain(text: Column | str) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _text_id(text: Column | str) -> Column:
    return F.xxhash64(_plain(text))


def write_text_postings(rows: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Write the index of the distinct texts of ``columns`` and return it: gram and text_id, for find_by_text.

    A text that many rows carry is posted once, so the index grows with what there is to read, not with the rows. Texts whose ids
    collide are found together, and checked apart.
    """
    texts = rows.select(F.explode(F.array(*map(_plain, columns))).alias("text")).filter(F.length("text") >= GRAM).distinct()
    return write_postings(texts.withColumn("text_id", _text_id("text")), ["text_id"], ["text"], path)


def candidates(postings: DataFrame, key: list[str], text: str) -> DataFrame | None:
    """Keys that have every three characters of ``text``, in one column or over several; None for a text that is too short to tell."""
    q = text.lower()
    wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not wanted:
        return None
    codes = [F.xxhash64(F.lit(g)) for g in wanted]
    found = postings.filter(F.col("gram").isin(codes)).groupBy(*key).agg(F.count_distinct("gram").alias("_n"))
    return found.filter(F.col("_n") == F.size(F.array_distinct(F.array(*codes)))).select(*key)


def find(rows: DataFrame, postings: DataFrame, key: list[str], columns: list[str], text: str) -> DataFrame:
    """``rows`` of which a column contains ``text``, in either case: those that the index names, checked against their texts. An empty text finds all."""
    named = candidates(postings, key, text)
    some = rows if named is None else rows.join(named, key, "left_semi")
    return some.filter(reduce(Column.__or__, _contain(columns, text)))


def _contain(columns: list[str], text: str) -> list[Column]:
    return [F.contains(_plain(c), F.lit(text.lower())) for c in columns]


def find_by_text(rows: DataFrame, postings: DataFrame, columns: list[str], text: str) -> DataFrame:
    """As find, through the index of write_text_postings. A row is found under the first of the columns that contains ``text``."""
    named, has = candidates(postings, ["text_id"], text), _contain(columns, text)
    if named is None:
        return rows.filter(reduce(Column.__or__, has))
    named = named.withColumnRenamed("text_id", "_text_id")
    first = [reduce(Column.__and__, [~h for h in has[:i]], h) for i, h in enumerate(has)]
    return reduce(DataFrame.unionByName, [rows.join(named, _text_id(c) == F.col("_text_id"), "left_semi").filter(f) for c, f in zip(columns, first, strict=True)])
