"""CSV files as people send them: whatever encoding and separator, as rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators that are tried; of equal counts in the first line the first wins.
SEPARATORS = [",", ";", "\t", "|"]

#: The control characters of Latin-1 that are printed ones in Windows-1252, and those.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_C1_AS = bytes(map(ord, _C1)).decode("cp1252")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without a byte-order mark, else Windows-1252, else (where it has no such character) Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.when(utf8.isNull(), F.decode(content, "ISO-8859-1"))
    undefined = latin.rlike("[\x81\x8d\x8f\x90\x9d]")
    other = F.when(undefined, latin).otherwise(F.translate(latin, _C1, _C1_AS))
    return F.regexp_replace(F.coalesce(utf8, other), "^﻿", "")


def separator(text: Column) -> Column:
    """The separator that the first line holds most of."""
    line = F.regexp_extract(text, r"^\s*([^\r\n]*)", 1)
    counts = [F.struct(F.length(F.regexp_replace(line, f"[^{s}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)]
    return F.array_max(F.array(*counts))["s"]


def cells(record: Column, sep: Column) -> Column:
    """The cells of a record: quoted ones without their quotes, doubled quotes as one, others trimmed."""
    chain = F.when(F.lit(False), F.array().cast("array<string>"))
    for s in SEPARATORS:
        pattern = rf'(?:^|[{s}])("(?:[^"]|"")*"|[^{s}]*)'
        chain = chain.when(sep == s, F.regexp_extract_all(record, F.lit(pattern), F.lit(1)))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c))
    return F.transform(chain, bare)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, row (from 1) and cells of every record of the CSV files under a path; blank lines are left out, a quoted cell may span lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), decoded(F.col("content")).alias("_t"))
    records = F.regexp_extract_all("_t", F.lit(r'((?:[^"\r\n]|"(?:[^"]|"")*")+)'), F.lit(1))
    rows = texts.select("name", separator(F.col("_t")).alias("_sep"), F.posexplode(F.filter(records, lambda r: F.trim(r) != "")).alias("_i", "_r"))
    return rows.select("name", (F.col("_i") + 1).alias("row"), cells(F.col("_r"), F.col("_sep")).alias("cells"))
