"""Exact repeats of byte strings by distributed prefix doubling: Spark sorts pairs of ranks at growing offsets until ranks are unique or cover a string.

A string of ``length`` bytes is dealt by its anchor, the least hash among its grams of half its length, so equal strings have
one anchor at one offset. Neighbouring strings of one anchor travel as a run. Anchors met once can't repeat and go; a run met
twice as a whole is settled. The other distinct runs of an anchor are laid on a lattice of steps of an eighth of the length,
counted from the anchor: blocks of one step are ranked, pairs of ranks at offsets 1, 2 and 3 steps give ranks of 2, 4 and 7 steps,
and a rank that occurs once goes. What a string has beside its 7 steps, one step in all to the left and right, is compared last.
Ranks are of bytes, so no hash decides between anchors of unequal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _INVERSE, _powers, bound_batches, discard, materialise, mix, release

#: Bytes of a string; a multiple of 8.
LENGTH = 200
#: Bytes of text whose grams are hashed at once; blocks overlap by a string.
_BLOCK = 1 << 20


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(_BASE, n)[:n], out=total[1:])
        return mix((total[size:] - total[:-size]) * _powers(_INVERSE, n)[: n - size + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - width + have], x[width - have :]) if have < width else x


def runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of each run: neighbouring strings with one leftmost anchor. Long texts are read in blocks, whose edges end runs of themselves."""
    gram, parts = length // 2, []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, _BLOCK):
        g = _grams(whole[at : at + _BLOCK + length - 1], gram)
        least = _sliding_least(g, length - gram + 1)
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (g[: len(least) - 1] == least[:-1])))
        start = np.flatnonzero(new)
        parts.append((least[start], start + at, np.diff(np.append(start, len(least)))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _digest(data: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    x = xxhash.xxh3_128_digest(data)
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


class _Met:
    """How often a partition has met a text; its rows hold a text twice at most, as only 'once or more often' matters."""

    def __init__(self, most: int):
        self.most, self.times = most, {}

    def again(self, digest: tuple[int, int]) -> bool:
        n = self.times[digest] = self.times.get(digest, 0) + 1
        return n <= self.most


def _bodies(b: pa.RecordBatch, i: int = 0) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() for x in b.column(i))


def _anchors(length: int):
    """The anchors of all runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(2)
        for b in it:
            parts = [runs(x, length)[0] for x in _bodies(b) if len(x) >= length and met.again(_digest(x))]
            if parts:
                a, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c)], ["a", "c"])

    return run


_RUN_ROWS = "t1 long, t2 long, a long, c1 long, c2 long, at int, n short"


def _run_rows(length: int):
    """Text, anchor, content, place and strings of each run."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(2)
        for b in it:
            texts, found, contents = [], [], []
            for x in _bodies(b):
                if len(x) < length or not met.again(t := _digest(x)):
                    continue
                a, at, n = runs(x, length)
                contents += [xxhash.xxh3_128_digest(x[i : i + m + length - 1]) for i, m in zip(at.tolist(), n.tolist(), strict=True)]
                texts.append(np.tile(np.array(t, np.int64), (len(a), 1)))
                found.append((a, at, n))
            if not texts:
                continue
            t, c = np.concatenate(texts), np.frombuffer(b"".join(contents), np.int64).reshape(-1, 2)
            a, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [t[:, 0], t[:, 1], a.view(np.int64), c[:, 0], c[:, 1], at.astype(np.int32), n.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["t1", "t2", "a", "c1", "c2", "at", "n"])

    return run


def _packed(once: bool):
    """Digest and compressed bytes of each text; ``once`` in a partition, or of every row with its key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, met = zstandard.ZstdCompressor(level=3), _Met(1)
        for b in it:
            rows = [(t, z.compress(x)) if not once or met.again(t) else None for x in _bodies(b) for t in (_digest(x),)]
            kept = [i for i, r in enumerate(rows) if r]
            t = np.array([rows[i][0] for i in kept], np.int64).reshape(-1, 2)
            out = [pa.array(np.ascontiguousarray(t[:, 0])), pa.array(np.ascontiguousarray(t[:, 1])), pa.array([rows[i][1] for i in kept], pa.binary())]
            names = ["t1", "t2", "z"]
            if not once:
                out, names = [*out, b.column(1)], [*names, "_key"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _pieces(length: int):
    """The bytes of each wanted run, and the place of its anchor in them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        gram = length // 2
        for b in it:
            rows = []
            for packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = z.decompress(packed)
                for x in wanted:
                    body = data[x["at"] : x["at"] + x["n"] + length - 1]
                    g = _grams(np.frombuffer(body[:length], np.uint8), gram)
                    rows.append((x["kind"], x["n"], int(np.argmin(g)), body))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "n", "d", "body"])

    return run


def _reranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """kind and its ``ranks`` (place -> rank): the sorted keys that occur more than once are numbered in order, all others go."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranked = materialise(again.select(*keys).orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)
    own = rows.join(ranked, keys).groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("j", "rank"))).alias("ranks"))
    out = materialise(own, name)
    discard(ranked)
    return out


def _pairs(ranks: DataFrame, offset: int) -> DataFrame:
    """kind, j and the ranks at j and ``offset`` places on, where both are left."""
    each = ranks.select("kind", "ranks", F.explode("ranks").alias("j", "r1"))
    return each.withColumn("r2", F.try_element_at("ranks", F.col("j") + offset)).filter("r2 is not null").select("kind", "j", "r1", "r2")


def _doubled(pieces: DataFrame, length: int) -> DataFrame:
    """kind, w, n: stretches of strings of each piece (the first at w) that another piece has too."""
    step = length // 8
    on = F.col("d") + step * F.col("j")
    last = F.floor((F.octet_length("body") - F.col("d")) / step).cast("int") - 1
    blocks = pieces.withColumn("j", F.explode(F.sequence(-F.floor(F.col("d") / step).cast("int"), last)))
    ranks = _reranked(blocks.select("kind", "j", F.substring("body", on + 1, F.lit(step)).alias("block")), ["block"], "ranks")
    for offset in (1, 2):
        before, ranks = ranks, _reranked(_pairs(ranks, offset), ["r1", "r2"], "ranks")
        discard(before)
    # strings begin at their anchor or before it
    core = _reranked(_pairs(ranks, 3).filter("j <= 0"), ["r1", "r2"], "ranks")
    discard(ranks)
    # a string v bytes before place j has the last v bytes of the step to the left and the first step - v of the one to the right
    own = core.select("kind", F.explode("ranks").alias("j", "core")).join(pieces, "kind")
    own = own.withColumn("low", F.greatest(F.lit(0), on - F.col("n") + 1)).withColumn("high", F.least(F.lit(step - 1), on)).filter("low <= high")
    left = F.substring("body", on - F.col("high") + 1, F.col("high"))
    right = F.substring("body", on + 7 * step + 1, F.lit(step) - F.col("low"))
    sides = ["core", "low", "high", "left", "right"]
    own = materialise(own.select("kind", on.alias("on"), "core", "low", "high", left.alias("left"), right.alias("right")), "sides")
    discard(core)
    alike = own.groupBy(*sides).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("kind", "on")).alias("one"))
    alike = materialise(alike.select(*sides, "one.*", (F.col("c") > 1).alias("settled")), "alike")
    settled = own.join(alike.filter("settled").select(*sides), sides, "left_semi")
    open_cores = materialise(alike.filter("not settled").select("core").distinct(), "open")  # written, so that a hot core's rows may be split
    each = alike.join(open_cores, "core", "left_semi").withColumn("v", F.explode(F.sequence("low", "high")))
    side = F.concat(F.substring("left", F.col("high") - F.col("v") + 1, F.col("v")), F.substring("right", F.lit(1), F.lit(step) - F.col("v")))
    each = each.select("core", "v", side.alias("side"), "kind", "on", "settled")
    keys = ["core", "v", "side"]
    twice = materialise(each.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*keys), "twice")
    single = each.filter("not settled").join(twice, keys, "left_semi")
    found = settled.select("kind", (F.col("on") - F.col("high")).alias("w"), (F.col("high") - F.col("low") + 1).alias("n"))
    found = materialise(found.unionByName(single.select("kind", (F.col("on") - F.col("v")).alias("w"), F.lit(1).alias("n"))), "found")
    discard(own, alike, twice, open_cores)
    return found


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """t1, t2 (a text's digest), cuts: stretches of n strings, the first at byte ``at``, that also start elsewhere; texts without any are left out."""
    if length % 8 or length < 16:
        raise ValueError("length must be a multiple of 8, 16 or more")
    spark = docs.sparkSession
    bodies = bound_batches(docs).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    often = bodies.mapInArrow(_anchors(length), "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).filter("c > 1").select("a")
    often = materialise(often, "often")
    release(spark)
    hits = materialise(bodies.mapInArrow(_run_rows(length), _RUN_ROWS).join(often, "a", "left_semi"), "hits")
    discard(often)
    release(spark)
    kinds = hits.groupBy("a", "c1", "c2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t1", "t2", "at", "n")).alias("f"))
    kinds = materialise(kinds.select("a", "c1", "c2", (F.col("c") > 1).alias("settled"), "f.*").withColumn("kind", F.monotonically_increasing_id()), "kinds")
    several = materialise(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a"), "several")
    wanted = kinds.join(several, "a", "left_semi").groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "at", "n")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    pieces = bodies.mapInArrow(_packed(True), "t1 long, t2 long, z binary").join(wanted, ["t1", "t2"]).select("z", "wanted")
    pieces = materialise(pieces.mapInArrow(_pieces(length), "kind long, n int, d int, body binary").dropDuplicates(["kind"]), "pieces")
    discard(several, wanted)
    release(spark)
    found = _doubled(pieces, length)
    discard(pieces)
    release(spark)
    partly = found.groupBy("kind").agg(F.collect_set(F.struct("w", "n")).alias("spans"))
    partly = kinds.filter("not settled").join(partly, "kind").select("c1", "c2", "spans")
    entire = kinds.filter("settled").select("c1", "c2", F.array(F.struct(F.lit(0).alias("w"), F.col("n").cast("int").alias("n"))).alias("spans"))
    answers = materialise(partly.unionByName(entire), "answers")
    cuts = hits.select("t1", "t2", "c1", "c2", "at").join(answers, ["c1", "c2"]).select("t1", "t2", "at", F.explode("spans").alias("s"))
    cuts = cuts.groupBy("t1", "t2").agg(F.collect_set(F.struct((F.col("at") + F.col("s.w")).alias("at"), F.col("s.n").alias("n"))).alias("cuts"))
    out = materialise(cuts, "cuts")
    discard(hits, kinds, found, answers)
    release(spark)
    return out


def _removed(length: int, keep: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in it:
            rows = []
            ends = np.cumsum(b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts, stretch = (b.column(2).flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "n"))
            first = 0
            for packed, last in zip(b.column(1), ends.tolist(), strict=True):
                data = z.decompress(packed.as_buffer())
                removed = spans = 0
                kept = data
                if last > first:
                    # stretches in order, those that touch joined
                    order = first + np.argsort(starts[first:last], kind="stable")
                    lo, hi = starts[order], np.maximum.accumulate(starts[order] + stretch[order] + length - 1)
                    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    lo, hi = lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()
                    removed, spans = sum(hi) - sum(lo), len(lo)
                    kept = b"".join(data[x:y] for x, y in zip([0, *hi], [*lo, len(data)], strict=True))
                first = last
                rows.append((len(data), removed, spans, kept if keep else hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if keep else pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["_key", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: bool = True) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and ``kept``: the bytes left (or their SHA-256) of each row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any row or the same one. Null texts
    are empty; rows of one key are documents of their own, and repeated rows repeat each other; texts are told apart by 128 bits of a digest, not by
    key, so keys may be null; a very long text is read as a whole; shorter ones stay; an empty table gives no rows; other columns are ignored.
    Kept bytes may begin or end within a character, so they are binary.
    """
    cuts = repeated(docs, text, length)
    rows = bound_batches(docs).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), F.col(key).alias("_key"))
    kind = rows.schema["_key"].dataType.simpleString()
    packed = rows.mapInArrow(_packed(False), f"t1 long, t2 long, z binary, _key {kind}")
    done = packed.join(cuts, ["t1", "t2"], "left").select("_key", "z", "cuts")
    done = done.mapInArrow(_removed(length, keep), f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept {'binary' if keep else 'string'}")
    return done.withColumnRenamed("_key", key)


def op11_byte_spans(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return remove_repeats(docs, keep=False).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT k, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS s FROM (SELECT k, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)
), late AS (
  SELECT k, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), step AS (
  SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM late
), span AS (
  SELECT k, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS s FROM step) GROUP BY k, s
), kept AS (
  SELECT d.k, sum(hi - lo) AS n_removed, count(*) AS n_spans,
    list_reduce(list_prepend('', list(substr(h, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT) ORDER BY lo)), lambda x, y: x || y)
      || substr(any_value(h), (2 * max(hi) + 1)::BIGINT) AS s
  FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS before FROM span) AS x JOIN d USING (k) GROUP BY d.k
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(s, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
