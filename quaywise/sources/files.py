"""Files as they arrive: content type by magic bytes, one row for each distinct content, page texts, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.operators.workflow import once


def file_type(content: Column, name: Column) -> Column:
    """pdf, zip, xlsx, png, jpeg, tiff, gif, email, csv or unknown: by the first bytes, then by the name."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    zipped = F.when(ext.isin("xlsx", "xlsm"), "xlsx").when(ext == "docx", "docx").otherwise("zip")
    return (
        F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304") | head.startswith("504B0506"), zipped).when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("47494638"), "gif")
        .when(ext.isin("eml", "msg"), "email").when(ext.isin("csv", "tsv", "txt"), "csv").otherwise("unknown")
    )


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder: name, type, size, sha256 and content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("name"), file_type(F.col("content"), name).alias("type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("at"), "content")


def first_by_content(files: DataFrame, by: list[str], at: str = "at", key: str = "name") -> DataFrame:
    """The earliest file of each content in each organisation."""
    return once(files, [*by, "sha256"], [at, key])


def message_key(message_id: Column | str, content: Column) -> Column:
    """Identity of a mail: its Message-ID, or a digest of its content if that is missing, too long or has blanks."""
    raw = F.regexp_replace(F.trim(F.coalesce(F.col(message_id) if isinstance(message_id, str) else message_id, F.lit(""))), "^<|>$", "")
    return F.when((raw != "") & (F.length(raw) <= 240) & ~raw.rlike(r"\s"), raw).otherwise(F.concat(F.lit("sha256:"), F.sha2(content, 256)))


def skip_reason(name: Column, kind: Column, size: Column, inline: Column) -> Column:
    """Why an attachment isn't kept: empty, a tiny image, or a small image within the text; null if it is."""
    image = kind.isin("png", "jpeg", "gif", "tiff")
    return F.when(size.isNull(), "not downloaded").when(size == 0, "empty").when(image & (size <= 6 * 1024), "tiny image").when(image & inline & (size <= 100 * 1024), "inline image")
