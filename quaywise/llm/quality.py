"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, materialise

#: name -> SQL over the measurements that is true where a document fails. A rule's bit is its place here; append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules that it enforces; documents failing any of them are rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "symbols")), Policy("v2", tuple(RULES)))}


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        twice, seen = set(), set()
        for x in windows:
            (twice if x in seen else seen).add(x)
        end = 0
        for i, x in enumerate(windows):
            if x in twice:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACES),
        sum(text.count(c) for c in _SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the measurements of every whole text, one row for each row of ``docs``. Names must differ from MEASURES."""
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [measure_text(x) for x in b.column(at).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in columns)], [*keep, *MEASURES])

    schema = StructType([docs.schema[c] for c in keep] + [StructField(m, LongType()) for m in MEASURES])
    return bound_batches(docs).select(sent).mapInArrow(batches, schema)


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i of RULES fails.

    A null or empty text has no words and fails ``few_words``; a very long text is held with its words and three-word windows;
    repeated rows each get a row; an empty table gives an empty ledger; columns other than ``keep`` and ``text`` are ignored,
    whatever their names.
    """
    bits = None
    for i, rule in enumerate(RULES.values()):
        bit = F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, keep, text).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents failing it, rejected by it alone, and kept if it were left out.

    One aggregation over distinct bit patterns (at most two to the number of rules) serves all rules.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")
    patterns = ledger_rows.select(masked).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("rules_seen"),
    )


def stored_ledger(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger of ``docs`` by doc_id, written once (to ``path`` or the shared folder) and read back: policies and ablations
    of any later version apply to it without another look at the texts."""
    rows = ledger(docs, ["doc_id"])
    if path is None:
        return materialise(rows, "ledger")
    rows.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def verdicts(ledger_rows: DataFrame) -> list[Column]:
    """A column for each version of the policies: whether it keeps the row."""
    return [(passes(BASE) & passes(p)).alias(f"kept_{p.version}") for p in POLICIES.values()]


def quality_ablations(docs: DataFrame) -> DataFrame:
    """The ablations of all policies over the stored ledger: version, rule, n_failed, n_only_this, n_kept_without, rules_seen."""
    rows = stored_ledger(docs)
    parts = [ablation(rows, p).select(F.lit(p.version).alias("version"), "*") for p in POLICIES.values()]
    return reduce(DataFrame.unionByName, parts)


def op1_quality_ledger(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """The contract's columns from the stored ledger: measurements, ``base_failed``, the policy's verdict ``kept``, the bits, the
    verdict of every version, and the rule that alone rejects the row (null if none or several do)."""
    rows = stored_ledger(docs)
    failed = ~passes(BASE)
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    alone = F.coalesce(*[F.when(masked == 1 << list(RULES).index(r), F.lit(r)) for r in policy.rules])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes(policy)).alias("kept"), "n_lines", "fail_bits", *verdicts(rows), alone.alias("only_rule"),
    )


_BITS = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n
  FROM (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT k, count(DISTINCT i + j) AS n FROM win, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY k
), lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)
), bits AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
          + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT)::INT AS fail_bits
  FROM m
)
"""
ORACLE_SQL = _BITS + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, fail_bits, (fail_bits & 3) = 0 AS kept_base, (fail_bits & 7) = 0 AS kept_v1, fail_bits = 0 AS kept_v2,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS only_rule
FROM bits
"""
ABLATION_SQL = _BITS + """, rule AS (
  SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)) AS r(rule, bit)
), policy AS (
  SELECT * FROM (VALUES ('base', 3), ('v1', 7), ('v2', 63)) AS p(version, mask)
)
SELECT version, rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits & mask = bit)::BIGINT AS n_only_this,
       count(*) FILTER ((fail_bits & mask) & ~bit = 0)::BIGINT AS n_kept_without, bit_or(fail_bits & mask) AS rules_seen
FROM bits, policy, rule WHERE mask & bit <> 0 GROUP BY version, rule
"""
