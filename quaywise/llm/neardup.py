"""Near-duplicates by Jaccard similarity of five-word shingles: SimHash links and bands of minimum hashes find pairs, exact sets
decide them.

The Gray-order index of ``simhash`` finds all pairs whose fingerprints differ in four bits or fewer. Pairs of similarity 0.8 differ
in about ten of 64 bits, too many for blocks of bits as keys, so bands find those that the fingerprints leave.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.operators.graph import components

from .common import bound_batches, discard, materialise, mix, release, word_hashes
from .simhash import _ASCII_LOWER, fingerprint, links

SHINGLE = 5
#: Texts link if five times the shingles they share are at least four times those of either: a similarity of 0.8.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair of similarity s meets in a band with probability s ** DEPTH; 0.8 is missed by all bands with one of 0.8 %.
BANDS, DEPTH = 16, 6
#: Bytes of the signatures of a pair of similarity 0.8 that agree: 77 of 96 are expected, fewer than these with one in 2,000.
LIKELY = 64
#: Ids of texts to be read that are broadcast, at most: 8 MB of them.
FEW_NODES = 1 << 20
#: Rows of a band, and shingles of their texts, of one share of it; two shares meet in a tile.
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20
_SEED = np.random.RandomState(20240301)
_XOR, _TIMES = (_SEED.randint(1, 1 << 62, BANDS * DEPTH, dtype=np.int64).astype(np.uint64)[:, None] for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five ASCII-lower-cased words; a shorter text is one run."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER))[2]
    size = min(len(words), SHINGLE)
    if not size:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(run)])
    return np.unique(run)


def minima(runs: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * DEPTH hash functions over the runs."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(runs), 2048):  # a block at a time, so that a very long text needs little memory
            least = np.minimum(least, ((runs[None, at : at + 2048] ^ _XOR) * _TIMES).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima; texts that agree in all of a band share it."""
    with np.errstate(over="ignore"):
        key = mix(np.arange(BANDS, dtype=np.uint64))
        for column in least.reshape(BANDS, DEPTH).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """A byte of each minimum; two texts agree in as large a share of them as they are similar, but for one in 256."""
    return mix(least).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


def _sketches(rows: DataFrame, key: str, text: str) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            runs = [shingles(x) for x in b.column(1).to_pylist()]
            digest = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in runs]
            least = [minima(r) if len(r) else None for r in runs]
            keys = pa.array([[] if m is None else band_keys(m) for m in least], pa.list_(pa.int64()))
            sig = pa.array([None if m is None else signature(m) for m in least], pa.binary())
            sizes = pa.array([len(r) for r in runs], pa.int64())
            fp = np.array([fingerprint(x, SHINGLE) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), sizes, keys, pa.array(fp), sig], ["node", "digest", "size", "keys", "fp", "sig"])

    return bound_batches(rows).select(key, text).mapInArrow(batches, "node long, digest binary, size long, keys array<long>, fp long, sig binary")


def _whole_tiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, of batches that are sorted by their first column, the tile."""
    rest = None
    for b in itertools.chain(it, (None,)):
        if b is not None and not b.num_rows:
            continue
        if b is not None:
            now = pa.Table.from_batches([b])
            rest = now if rest is None else pa.concat_tables([rest, now])
        if rest is None or not rest.num_rows:
            continue
        tile = rest.column(0).to_numpy()
        cut = len(tile) if b is None else int(np.searchsorted(tile, tile[-1], "left"))  # the last tile may go on in the next batch
        edge = np.append(np.flatnonzero(np.concatenate(([True], tile[1:cut] != tile[: cut - 1]))) if cut else [], cut).astype(int)
        done, rest = rest, rest.slice(cut)
        for lo, hi in zip(edge, edge[1:], strict=False):
            yield done.slice(lo, hi - lo)


def _near(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in a tile of pairs to be decided: signatures agree in LIKELY bytes or more, parts differ and sizes allow it.

    A pair that shares several bands is met in the first of them only, and in one tile of it. Bands that hold two parts all have tiles.
    """
    node, size, part, side, band = (t.column(c).to_numpy() for c in ("node", "size", "part", "side", "band"))
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
    for at in range(0, len(node), 64):
        own = slice(at, at + 64)
        near = (node[own, None] < node[None, :]) & (part[own, None] != part[None, :]) & ((side[own, None] != side[None, :]) | (side[own, None] == 0))
        near &= DENOMINATOR * np.minimum(size[own, None], size[None, :]) >= NUMERATOR * np.maximum(size[own, None], size[None, :])
        near &= (sig[own, None, :] == sig[None, :, :]).sum(2, dtype=np.int16) >= LIKELY
        i, j = np.nonzero(near)
        i += at
        shared = keys[i] == keys[j]
        first = keys[i, shared.argmax(1)] == band[i]
        yield i[first], j[first]


def _likely(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are in a pair to be decided, once each."""
    for t in _whole_tiles(it):
        found = [np.unique(np.concatenate(p)) for p in _near(t)]
        if len(some := np.unique(np.concatenate(found))):
            yield from t.take(pa.array(some)).combine_chunks().to_batches()


def _joins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the alike texts of each tile by their exact sets: as few as connect the parts that all of them connect."""
    for t in _whole_tiles(it):
        sets = [np.frombuffer(r, "<u8") for r in t.column("runs").to_pylist()]
        size = np.array([len(s) for s in sets])
        edge = np.concatenate(([0], np.cumsum(size)))
        every, ids = np.unique(np.concatenate(sets), return_inverse=True)
        label = np.unique(t.column("part").to_numpy(), return_inverse=True)[1]
        node, mark, a, b = t.column("node").to_numpy(), np.zeros(len(every), bool), [], []
        for i, j in _near(t):
            for one in np.unique(i):
                others = j[i == one]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                own = ids[edge[one] : edge[one + 1]]
                mark[own] = True
                shared = np.array([np.count_nonzero(mark[ids[edge[x] : edge[x + 1]]]) for x in others])
                mark[own] = False
                for x in others[DENOMINATOR * shared >= NUMERATOR * (size[one] + size[others] - shared)]:
                    if label[x] != label[one]:
                        label[label == label[x]] = label[one]
                        a.append(node[one])
                        b.append(node[x])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).astype("<u8").tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["node", "runs"])


def _decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        last, runs, same = None, None, []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if y != last:
                last, runs = y, shingles(y)
            same.append(alike(shingles(x), runs))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], ["a", "b", "same"])


def _agree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in LIKELY bytes or more."""
    for b in it:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((one == two).sum(1) >= LIKELY)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _plausible(pairs: DataFrame, lone: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a similarity of 0.8; no text is read."""
    close = f"{DENOMINATOR} * least(a_size, b_size) >= {NUMERATOR} * greatest(a_size, b_size)"
    sketch = lone.select("node", "size", "sig")
    both = pairs.join(sketch.toDF("a", "a_size", "a_sig"), "a").join(sketch.toDF("b", "b_size", "b_sig"), "b").filter(close)
    return both.select("a", "b", "a_sig", "b_sig").mapInArrow(_agree, "a long, b long")


def _texts_of(nodes: DataFrame, few: bool, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``node`` and ``text`` of the distinct ``nodes``, which are broadcast if they are few; else Spark shuffles the texts to meet them."""
    return rows.select(F.col(key).alias("node"), F.col(text).alias("text")).join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def _decided(pairs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``pairs`` (a, b) with ``same``: whether their whole texts are similar enough. Only texts of pairs are moved."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialise(_texts_of(nodes, 2 * pairs.count() <= FEW_NODES, rows, key, text), "pair-texts")
    release(rows.sparkSession)
    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    out = materialise(both.mapInArrow(_decide, "a long, b long, same boolean"), "decided")
    discard(pairs, texts)
    release(rows.sparkSession)
    return out


def _joined_in_tiles(named: DataFrame, lone: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) that connect what all pairs of alike texts of a band and of different parts connect. ``named``: band, node, part.

    A band of many texts, or of long ones, is dealt over tiles of pairs of its shares. In a tile all signatures are compared; the sets of the texts whose
    signatures agree enough with another's then meet in the tile, which decides all its pairs exactly. A pair costs time but no row: a tile gives
    at most one row a text.
    """
    share = F.ceil(F.greatest(F.col("n") / F.lit(TILE_ROWS), F.col("words") / F.lit(TILE_SHINGLES))).cast("long")
    sized = materialise(named.join(lone.select("node", "size", "sig", "keys"), "node"), "sized")
    counts = materialise(sized.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).select("band", share.alias("shares")), "band-sizes")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    tiles = sized.join(counts, "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("shares"))).withColumn("other", other)
    side = F.when(F.col("mine") < F.col("other"), 1).when(F.col("mine") > F.col("other"), 2).otherwise(0).alias("side")
    tiles = tiles.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "node", "size", "part", side, "band", "sig", "keys")
    schema = "tile long, node long, size long, part long, side int, band long, sig binary, keys array<long>"
    likely = materialise(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_likely, schema), "likely")
    nodes = likely.select("node").distinct()
    runs = materialise(_texts_of(nodes, likely.count() <= FEW_NODES, rows, key, text).mapInArrow(_runs, "node long, runs binary"), "runs")
    release(rows.sparkSession)
    met = likely.join(runs, "node").select(*likely.columns, "runs")
    out = materialise(met.repartition("tile").sortWithinPartitions("tile").mapInArrow(_joins, "a long, b long").distinct(), "late")
    discard(sized, counts, likely, runs)
    release(rows.sparkSession)
    return out


def near_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` (unique, a long) and ``component_id``, the least key reachable over links of similar texts.

    Texts of equal shingles are met first by one grouped minimum; texts without words are such a group, and so are null ones. The
    others meet by SimHash links (simhash.links, four bits) and in bands. First each text is held against those it is linked
    with and the least and the greatest of its bands (texts are read where signatures agree enough), which joins a large group of near copies in linear work. In the bands that
    are still apart all signatures are then compared in tiles, and the pairs that agree enough are decided there by their exact sets, so
    pairs of texts that share a band cost no row, whether they are alike or not. A very long text is one set of shingles in memory.
    Repeated rows are one group; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    sketches = materialise(_sketches(rows, key, text), "sketches")
    firsts = sketches.groupBy("digest").agg(F.min("node").alias("first"))
    lone = materialise(sketches.join(firsts, F.col("node") == F.col("first"), "left_semi"), "lone")
    prints = materialise(lone.filter("size > 0").groupBy("fp").agg(F.min("node").alias("least")), "prints")
    alike_bits = links(prints.select("fp", F.col("least").alias("node")))
    equal_bits = lone.filter("size > 0").join(prints, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = materialise(alike_bits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(equal_bits), "linked")
    met = lone.select("node", "size", F.explode("keys").alias("band"))
    # written before they are joined, so that Spark can split a band that many texts share
    ends = materialise(met.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "ends")
    met = materialise(met.join(ends, "band"), "bands")
    star = met.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
    star = star.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).unionByName(linked).distinct()
    tried = _decided(_plausible(star, lone), rows, key, text)

    joined = tried.filter("same").select("a", "b")
    label = materialise(components(joined), "labels")
    named = materialise(met.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part")), "named")
    split = named.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("band")
    split = materialise(split, "split")
    last, named = named, materialise(named.join(split, "band", "left_semi"), "split-bands")
    discard(label, met, linked, ends, split, last)
    late = _joined_in_tiles(named, lone, rows, key, text)
    discard(named)

    owner = components(joined.unionByName(late))
    whole = firsts.join(owner, F.col("first") == F.col("node"), "left").select("digest", F.coalesce("component", "first").alias("component_id"))
    return sketches.join(whole, "digest").select(F.col("node").alias(key), "component_id")
