"""A corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows and reads them again as
the next one's input. All stages but the last return the columns of ``docs``. Every decision takes effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.llm import common, mixing, neardup, packing, quality, secrets

#: The mixing stage's target shares: the good documents' whole supply, and what the others may add to it.
STAGE_WEIGHTS = {"good": 0.97, "low": 0.02, "toxic": 0.01}


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns named by place, so that no name clashes with an operator's, and its names of doc_id and text."""
    names = [f"_p{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose texts pass policy v2. Rules are judged on the row's own text, so repeated ids and rows do no harm.

    A null or empty text has too few words and goes; nulls in other columns stay as they are; a very long text is measured as a whole; an
    empty table gives an empty one; columns may have any names, as they are named by place inside.
    """
    plain, _, text = _plain(docs)
    judged = quality.ledger(plain, plain.columns, text).filter(quality.passes(quality.POLICIES["v2"]))
    return judged.select(plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked texts: the one of least doc_id (null last), then of least place in the input.

    Texts link at a Jaccard similarity of 0.8 or more of their five-word shingles. Operator 10's index finds the pairs within four
    bits, which are held against their texts; bands of minimum hashes find those that differ in more. Rows are told apart by
    a number written with them, so rows without an id, or of one id, stay unless their texts link. Null and empty texts are alike; ties of an
    id go by place in the input; a very long text is compared as a whole; an empty table gives an empty one; extra columns are kept.
    """
    plain, key, text = _plain(docs)
    rows = common.materialise(plain.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(rows, "_row", text).join(rows.select("_row", key), "_row")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull(), key, "_row")).alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(plain.columns).toDF(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mask; n_chars follows the text.

    Every row stays, repeated ones and those of null or empty texts unchanged; a very long text costs time in proportion to its
    length; an empty table gives an empty one; columns may have any names.
    """
    plain, _, text = _plain(docs)
    found = secrets.find_secrets(plain, secrets.fit_model(plain, text), text)
    out = secrets.redact(found.withColumn("_hit", F.size("secrets") > 0), text)
    if "n_chars" in docs.columns:
        n_chars = plain.columns[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col("_hit"), F.length(text).cast(plain.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(plain.columns).toDF(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out low and toxic documents to their target share of tokens; good documents all stay (rates reach one).

    A row's draw is a hash of its id, so rows of one id (or none) share theirs, and rows alike are kept or dropped together. Null and
    empty texts have no tokens and the posterior of the bias; with no labels every domain is as likely and the first one, good, is
    kept whole; an empty table gives an empty one; columns may have any names.
    """
    plain, key, text = _plain(docs)
    labelled = mixing.labelled_texts(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"), key, text)
    others = [c for c in plain.columns if c != key]
    rates = mixing.mix(plain, labelled, STAGE_WEIGHTS, [key, *others], most=1.0, whole="good", text=text)
    return rates.filter("copies > 0").select(plain.columns).toDF(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of several context sizes. Null and empty texts are the end id alone, repeated rows
    are packed as often as they come, very long texts are cut into windows, and an empty table gives no pieces."""
    return packing.op5_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: SimHash, the Markov model, the classifier and the tokenizer have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to shared storage and read again, and deleted once the next ones are."""
    docs, before = common.read_documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(*before)
        before = [docs]
    return docs
