"""Phrase collocations: word-id suffix arrays of shards, built by prefix doubling, whose LCP intervals count n-grams; counts are merged by key.

A task turns its documents into shards of at most ``SHARD_WORDS`` words. In a shard, suffixes of word ids are ranked by their
first one, two and four words; suffixes in order that share k words or more form the LCP intervals of depth k, one for each
n-gram of k words, whose widths are its counts. Spark sums the counts of all shards by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, bound_batches, discard, materialise, mix, release

#: Words of one suffix array: a bound on a task's memory.
SHARD_WORDS = 1 << 19
#: Hashes that a bucket of them all is to hold at most: a bound on the memory of the task that sums it.
BUCKET = 1 << 21
#: Least count of a candidate, phrases reported per language, and the share (%) of a phrase's count at which a longer one replaces it.
LEAST, TOP, SHARE = 10, 2000, 50
#: Ends a piece: no UTF-8 text holds this byte.
_END = b"\xff"
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 0xFF
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, with ``_END`` between pieces."""
    return text.translate(_FOLD).replace(_END, b" \xff ").split()


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols at least, and the symbols (``depth`` at most) that each shares with the one before.

    Prefix doubling: ranks by h symbols, paired at offset h, give ranks by 2h; past the end a suffix ranks before all others.
    The shared length follows from the same ranks, from the largest power of two down.
    """
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, h = [rank], 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        h *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(ids), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        padded = np.append(levels[k], 0)
        same = (padded[np.minimum(a, len(ids))] == padded[np.minimum(b, len(ids))]) & (np.maximum(a, b) + (1 << k) <= len(ids))
        shared[1:][same] += 1 << k
        a, b = a + same * (1 << k), b + same * (1 << k)
    return order, np.minimum(shared, depth)


class _Shard:
    """Words of whole pieces or of stretches of one; a stretch is followed by two words that are counted in the next shard."""

    def __init__(self):
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.sizes: list[int] = []
        self.ahead: list[tuple[int, int]] = []

    def add(self, lang: str, words: list[bytes], ahead: int = 0) -> None:
        self.words += words
        self.words.append(_END)
        self.langs.append(lang)
        self.sizes.append(len(words) + 1)
        if ahead:
            self.ahead.append((len(self.words) - 1 - ahead, len(self.words)))

    def row(self) -> Iterator[pa.RecordBatch]:
        """The shard as a row, under a name of its own."""
        if self.words:
            body = zstandard.ZstdCompressor(level=3).compress(b" ".join(self.words))
            lo, hi = zip(*self.ahead, strict=True) if self.ahead else ((), ())
            columns = [uuid.uuid4().hex, body, self.langs, self.sizes, lo, hi]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, _ROW, strict=True)], schema=_ROW)


#: A shard as it is written: its words, the language and words of each stretch, and stretches that are counted elsewhere.
_ROW = pa.schema([
    ("shard", pa.string()), ("body", pa.binary()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())),
])
_ROW_TYPES = "shard string, body binary, langs array<string>, sizes array<int>, lo array<int>, hi array<int>"


class _Counts:
    """n-grams of a written shard, from the LCP intervals of its suffix array."""

    def __init__(self, row: dict, depth: int):
        coded = pa.array(zstandard.ZstdDecompressor().decompress(row["body"]).split(b" "), pa.binary()).dictionary_encode()
        names = pa.array(row["langs"], pa.string()).dictionary_encode()
        self.word, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.lang = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), row["sizes"])
        self.langs = names.dictionary
        real = self.word != self.words.index(_END).as_py()
        self.order, self.shared = suffix_array(np.where(real, self.lang * len(self.words) + self.word + 1, 0), depth)
        self.counted = np.ones(len(self.word), bool)
        for lo, hi in zip(row["lo"], row["hi"], strict=True):
            self.counted[lo:hi] = False
        after = np.append(real, [False, False])
        self.left = np.where(~real, 0, np.where(~after[1:-1], 1, np.where(~after[2:], 2, 3)))  # words before the piece ends, three at most
        self.real = real
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        tongue = np.array([xxhash.xxh3_64_intdigest(x.encode(), 7) for x in self.langs.to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            self.hash = mix(own[self.word] * np.uint64(_BASE) + tongue[self.lang])

    def intervals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A suffix of each interval of depth k, and how many counted suffixes it holds."""
        first = np.flatnonzero(self.shared < k)
        width = np.add.reduceat(self.counted[self.order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        kept = (self.left[self.order[first]] >= k) & (width > 0)
        return self.order[first[kept]], width[kept]

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """64 bits of each n-gram of one or two words, of its language and length."""
        if k == 1:
            return self.hash[at]
        with np.errstate(over="ignore"):
            return mix(self.hash[at] * np.uint64(_BASE) + self.hash[at + 1] + np.uint64(1))


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for b in it:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = tokens(text.as_buffer().to_pybytes())
            at = 0
            while at < len(words):
                room = SHARD_WORDS - len(shard.words)
                if len(words) - at <= room:
                    shard.add(lang, words[at:])
                    break
                ahead = words[at + room : at + room + 2]
                shard.add(lang, words[at : at + room] + ahead, len(ahead))
                at += room
                yield from shard.row()
                shard = _Shard()
            if len(shard.words) >= SHARD_WORDS:
                yield from shard.row()
                shard = _Shard()
    yield from shard.row()


def _blocks(buckets: int, least: int):
    """Hashes of a shard's words and pairs with their counts (``least`` at most, as only reaching it matters), dealt over buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                counts = _Counts(row, 2)
                found = [(counts.hashes(at, k), c) for k in (1, 2) for at, c in (counts.intervals(k),)]
                h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, c = h[order], np.minimum(c[order], least).astype(np.int32)
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                there = np.flatnonzero(np.diff(cut))
                columns = [pa.array(there), pa.array([row["shard"]] * len(there), pa.string())]
                columns += [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in there], pa.binary()) for x in (h, c)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "h", "c"])

    return run


def _frequent(least: int):
    """For each shard the hashes of a bucket whose counts reach ``least`` over all shards. Rows come sorted by bucket."""

    def answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        c = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) // 8 for r in rows])
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        enough = np.add.reduceat(c[order].astype(np.int64), first) >= least
        kept = np.zeros(len(h), bool)
        kept[order] = np.repeat(enough, np.diff(np.append(first, len(h))))
        h, owner = h[kept], owner[kept]
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        there = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in there], pa.string()), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in there], pa.binary())], ["shard", "h"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for b in it:
            for own, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if own != bucket and rows:
                    yield from answers(rows)
                    rows = []
                bucket = own
                rows.append(row)
        if rows:
            yield from answers(rows)

    return run


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a shard's frequent words and pairs, and of triples of two frequent pairs; all words of a language as those of no word."""
    for b in it:
        for row in b.to_pylist():
            counts = _Counts(row, 3)
            known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in row["known"] or [b""]]))

            def often(at: np.ndarray, k: int, counts=counts, known=known) -> np.ndarray:
                h = counts.hashes(at, k)
                place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                return known[place] == h if len(known) else np.zeros(len(h), bool)

            every = np.bincount(counts.lang[counts.real & counts.counted], minlength=len(counts.langs))
            parts = [(counts.langs, np.zeros(len(counts.langs), np.int32), pa.array([""] * len(counts.langs), pa.string()), every.astype(np.int64))]
            words = counts.words.cast(pa.string(), safe=False)
            for k in (1, 2, 3):
                at, c = counts.intervals(k)
                kept = often(at, 1) if k == 1 else often(at, 2)
                if k == 3:
                    kept[kept] = often(at[kept] + 1, 2)
                at, c = at[kept], c[kept]
                phrase = [words.take(pa.array(counts.word[at + i])) for i in range(k)]
                parts.append((counts.langs.take(pa.array(counts.lang[at])), np.full(len(at), k, np.int32), pc.binary_join_element_wise(*phrase, " ") if k > 1 else phrase[0], c))
            for lang, n, phrase, c in parts:
                yield pa.RecordBatch.from_arrays([lang, pa.array(n), phrase, pa.array(c)], ["lang", "words", "phrase", "c"])


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: words, pairs and triples that occur ``least`` times or more, and all words of a language as words = 0; written once.

    1. Shards are written. 2. Each sends the hashes of its words and pairs to buckets, which answer those that are frequent over all
    shards; as many buckets as keep one to BUCKET hashes. 3. Each shard counts what may be frequent: n-grams whose hashes are, triples of two
    such pairs (none is more frequent than its pairs); Spark sums the counts by their words, so no hash decides a count.
    """
    spark = docs.sparkSession
    rows = bound_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    shards = materialise(rows.mapInArrow(_shards, _ROW_TYPES), "shards")
    buckets = max(1, 2 * shards.count() * SHARD_WORDS // BUCKET)
    dealt = shards.mapInArrow(_blocks(buckets, least), "bucket long, shard string, h binary, c binary")
    dealt = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    known = materialise(dealt.mapInArrow(_frequent(least), "shard string, h binary"), "frequent")
    release(spark)
    asked = shards.join(known.groupBy("shard").agg(F.collect_list("h").alias("known")), "shard", "left")
    counts = asked.mapInArrow(_counted, "lang string, words int, phrase string, c long").groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f"))
    out = materialise(counts.filter((F.col("words") == 0) | (F.col("f") >= least)), "counts")
    discard(shards, known)
    release(spark)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of two or three words.

    Scores are exact decimals. A null text is empty, a null language ``und``; a very long text spans several shards, whose edges count
    every n-gram once; repeated rows count as often as they come; ties go by count, then phrase; an empty table gives no rows;
    other columns are ignored.
    """
    counts = ngram_counts(docs, text, lang, least)

    def of(words: int) -> DataFrame:
        return counts.filter(F.col("words") == words).select("lang", "phrase", "f")

    n, ones, twos = of(0).select("lang", F.col("f").alias("n")), of(1), of(2)
    word = [F.split_part("phrase", F.lit(" "), F.lit(i)) for i in (1, 2, 3)]
    threes = of(3).select("lang", "phrase", "f", word[0].alias("first"), F.concat_ws(" ", *word[:2]).alias("front"), F.concat_ws(" ", *word[1:]).alias("back"), word[2].alias("third"))

    def counted(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
        return rows.join(counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)), ["lang", key])

    def score(a: str, left: str, right: str):
        """floor(1000000 * a * a / (left * right)) in decimals of 38 digits: exact for counts below 10 ** 15."""
        a, left, right = (F.col(x).cast("decimal(15,0)") for x in (a, left, right))
        return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, left * right)

    pairs = twos.select("lang", "phrase", F.col("f").alias("a"), word[0].alias("first"), word[1].alias("second"))
    pairs = counted(counted(pairs, "first", ones, "l"), "second", ones, "r")
    inside = threes.select("lang", "f", F.explode(F.array("front", "back")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    pairs = pairs.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a")))
    pairs = pairs.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"))
    triples = threes.withColumnRenamed("f", "a")
    for key, parts, name in (("first", ones, "l1"), ("back", twos, "r1"), ("front", twos, "l2"), ("third", ones, "r2")):
        triples = counted(triples, key, parts, name)
    triples = triples.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", *[F.when(early, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(o) for x, o in (("l", "l"), ("r", "r"), ("s", "score"))])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most candidates: its parts are ranked first, and only their best meet
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = pairs.unionByName(triples).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return collocations(docs)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d)
), g AS (
  SELECT lang, k AS m, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, m, phrase, a, w, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:m], ' ') AS q
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m
), scored AS (
  SELECT cuts.lang, cuts.m, cuts.phrase, a, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f), k) AS nth
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = p JOIN f AS y ON y.lang = cuts.lang AND y.phrase = q
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored AS s LEFT JOIN inside AS i ON s.m = 2 AND i.lang = s.lang AND i.phrase = s.phrase
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
