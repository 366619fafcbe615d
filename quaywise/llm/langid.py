"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: N-grams kept in a profile, and the penalty of an n-gram that a profile lacks.
PROFILE = 400
#: Sizes of n-grams.
SIZES = (1, 2, 3)
#: Training documents taken for each language, about (chosen by a hash of the key).
TRAIN_DOCS = 4000

_LETTER = np.zeros(0x110000, bool)
_MADE = False


def _letters() -> np.ndarray:
    global _MADE
    if not _MADE:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _MADE = True
    return _LETTER


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as numbers) of the lower-cased text and their counts; anything but letters is one space."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 32)
    c = c[(c != 32) | np.append(c[1:] != 32, True)]  # runs of spaces become one
    two, three = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    every = np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))
    return np.unique(every, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts go by the n-gram's number."""
    return grams[np.lexsort((grams, -counts))[:most]]


def _counts(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(lang, gram, n) totals per batch of training rows."""
    kind = docs.schema[label].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            by: dict = {}
            for body, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(body)
            for lang, bodies in by.items():
                grams, n = ngrams("\n".join(bodies))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), b.schema.field(1).type), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    return bound_batches(docs).select(text, label).mapInArrow(batches, f"lang {kind}, gram long, n long")


def fit_profiles(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = TRAIN_DOCS, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's n-grams in rank order, from about ``train_docs`` rows of each label with a text.

    Rows of a language are taken while a hash of their key lies below its share, so the sample depends on no order. The
    driver gets ``most`` n-grams a language.
    """
    rows = train.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label)
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(train_docs) / n)])
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    sums = _counts(rows.filter(draw < share[F.col(label)]), key, text, label).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    pairs = F.struct((-F.col("n")).alias("n"), F.col("gram").alias("gram"))
    parts = sums.select("lang", pairs.alias("p"), F.pmod(F.xxhash64("gram"), F.lit(32)).alias("part"))
    # the best of each part, then the best of those
    best = parts.groupBy("lang", "part").agg(F.slice(F.array_sort(F.collect_list("p")), 1, most).alias("best"))
    top = best.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best"))
    return {r.lang: np.array([x.gram for x in r.best], np.int64) for r in top.collect()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, lang_pred and score for every whole text.

    A document's most frequent n-grams are compared with each profile: the distance is the sum of differences between
    their ranks, an n-gram that the profile lacks counting as PROFILE. The score is one less the best distance as a share
    of the greatest possible one. Equal distances go to the language that sorts first. Null texts and texts without a
    letter are ``und`` with score 0, as are all texts where no language was learned. A very long text is counted as a whole, in memory;
    repeated rows each get a row; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    langs = sorted(profiles)
    every = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.int64)
    rank = np.full((len(langs), len(every) + 1), -1, np.int64)
    for i, x in enumerate(langs):
        rank[i, np.searchsorted(every, profiles[x])] = np.arange(len(profiles[x]))

    def score(body: str | None) -> tuple[str, float]:
        if not body or not langs:
            return "und", 0.0
        grams, n = ngrams(body)
        if not (grams < 1 << 21).any():  # no single letter
            return "und", 0.0
        own = ranked(grams, n)
        at = np.searchsorted(every, own)
        at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != own)] = len(every)
        r = rank[:, at]
        away = np.where(r < 0, PROFILE, np.abs(r - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return langs[best], float(1 - away[best] / (PROFILE * len(own)))

    fields = [docs.schema[c] for c in (key, *keep)]
    names = [key, *keep, "lang_pred", "score"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [score(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return bound_batches(docs).select(key, *keep, text).mapInArrow(batches, schema)


def op6_language(docs: DataFrame) -> DataFrame:
    """The contract's columns: profiles are learned from rows that aren't held out, and every row gets a prediction."""
    rows = docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"))
    profiles = fit_profiles(rows.filter(~F.col("held_out")))
    return identify(rows, profiles, keep=("held_out",))
