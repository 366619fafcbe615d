"""SimHash near-duplicates: a Gray-order hierarchical index finds all fingerprints within a few bits of each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.operators.graph import components

from .common import bound_batches, discard, materialise

_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text: ASCII-lower-cased words, word shingles (repeats included), XXH64 with seed 42."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([h(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # a block at a time, so that a very long text needs little memory
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``key`` and ``fp`` (64 bits held in a long) of every whole text; no words give 0."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return bound_batches(docs).select(key, text).mapInArrow(batches, f"`{key}` {kind}, fp long")


# --- the index -------------------------------------------------------------------------------------------------------

FANOUT = 16


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence: neighbours there differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints sorted by group and Gray rank, under two levels of nodes of up to FANOUT children.

    A node holds the bits that all fingerprints below it share (``mask``) and their values (``bits``). A query descends
    from the upper nodes: the differing bits found at a node carry over to its children, which add only those bits
    that the parent didn't share, and whole groups are pruned once the sum exceeds the limit.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.group, self.fp = group[self.order], fp[self.order]
        self.levels = []
        group, both, either = self.group, self.fp, self.fp
        for _ in range(2):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            start = np.flatnonzero(nth % FANOUT == 0)
            both, either = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(either, start)
            mask = ~(both ^ either)
            self.levels.append((start, np.append(start[1:], len(group)), mask, both & mask))
            group = group[start]
        self.top_group = group

    def links(self, most: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j in sorted order, of one group with at most ``most`` differing bits, for queries i."""
        lo = np.searchsorted(self.top_group, self.group[rows], "left")
        n = np.searchsorted(self.top_group, self.group[rows], "right") - lo
        q, node = np.repeat(rows, n), _ragged(lo, n)
        over, spent = np.zeros(len(q), np.uint64), np.zeros(len(q), np.int16)
        (s1, e1, m1, b1), (s2, e2, m2, b2) = self.levels
        for start, end, mask, bits in ((s2, e2, m2, b2), (s1, e1, m1, b1)):
            spent = spent + np.bitwise_count((self.fp[q] ^ bits[node]) & mask[node] & ~over).astype(np.int16)
            last = e1[end - 1] if start is s2 else end  # one past the last fingerprint below the node
            keep = (spent <= most) & (last[node] > q + 1)
            q, node, spent, over = q[keep], node[keep], spent[keep], mask[node][keep]
            n = end[node] - start[node]
            q, spent, over, node = np.repeat(q, n), np.repeat(spent, n), np.repeat(over, n), _ragged(start[node], n)
        later = node > q
        q, node, spent, over = q[later], node[later], spent[later], over[later]
        keep = spent + np.bitwise_count((self.fp[q] ^ self.fp[node]) & ~over) <= most
        return q[keep], node[keep]


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] values), start[1], ..."""
    total = int(n.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total) if total else np.zeros(0, np.int64)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is linked with over a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forests(most: int):
    """Index the groups of each batch and emit, per group, each node's link to the least node of its component."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in it:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])  # tile, fp, node; sorted by tile
            table = table if rest is None else np.concatenate((rest, table), axis=1)
            cut = np.searchsorted(table[0], table[0, -1], "left") if table.shape[1] else 0
            rest, done = table[:, cut:], table[:, :cut]  # the last tile may go on in the next batch
            yield from _link(done, most)
        if rest is not None:
            yield from _link(rest, most)

    return run


def _link(t: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    if not t.shape[1]:
        return
    index, node = GrayIndex(t[0], t[1].view(np.uint64)), t[2]
    found = [index.links(most, np.arange(at, min(at + 2048, t.shape[1]))) for at in range(0, t.shape[1], 2048)]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(a):
        root = _spanning(t.shape[1], a, b)
        own = np.flatnonzero(root != np.arange(len(root)))
        node = node[index.order]
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])


MOST_BITS = 4
#: Blocks that 64 bits are cut into, and fingerprints up to which so many serve. Four differing bits leave all but four blocks
#: alike, so each choice of that many is a key: 2 of 6 blocks are keys of 21 bits, 3 of 7 of 27, 4 of 8 of 32.
BLOCKS = ((6, 1 << 26), (7, 1 << 32), (8, 1 << 62))
#: Rows of one key that meet in one tile; a larger key is dealt over tiles of pairs of its parts, so no pair is lost.
TILE_ROWS = 2048


def block_keys(n_blocks: int) -> list:
    """A key for each choice of the blocks that ``MOST_BITS`` differing bits leave alike."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(range(n_blocks), n_blocks - MOST_BITS)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(block[i])
        keys.append(key)
    return keys


def links(nodes: DataFrame, most: int = MOST_BITS, tile_rows: int = TILE_ROWS, n_blocks: int | None = None) -> DataFrame:
    """Links (``a``, ``b``) that connect all rows of ``nodes`` (fp distinct, node) at ``most`` differing bits or fewer.

    Rows that share a block key meet; more rows get longer keys (see BLOCKS), so a key's rows stay few as tables grow. The
    links are spanning forests, at most one a row of each tile: they connect what the pairs connect.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits")
    if n_blocks is None:
        n = nodes.count()
        n_blocks = next(k for k, upto in BLOCKS if n <= upto)
    keys = block_keys(n_blocks)
    rows = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(tile_rows)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiles = (
        rows.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .select("fp", "node", "key", "mine", other.alias("other"))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "fp", "node")
    )
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_forests(most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = MOST_BITS) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the least key reachable over links of at most ``most`` bits.

    A very long text is hashed a block of shingles at a time.

    Exact copies and equal fingerprints are met first by one grouped minimum, so that only distinct fingerprints are
    indexed. A null or empty text has fingerprint zero and links like any other; repeated keys each get a row; a null key
    gets a row but never names a component unless no other key is in it (then the component is null). An empty table
    gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = materialise(nodes.filter("least is not null").select("fp", F.col("least").alias("node")), "nodes")
    owner = components(links(found, most))
    named = nodes.join(owner, nodes["least"] == owner["node"], "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )
    return prints.join(named, "fp").select(key, "fp", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``."""
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
