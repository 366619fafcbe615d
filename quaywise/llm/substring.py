"""Substring dedup: word windows that occur earlier in the corpus, found by FM-indexes over content-defined shards.

A window of ``WINDOW`` words is dealt to the shard of its anchor, the least hash among its ``GRAM``-word grams, so equal
windows always meet and a document is streamed only through the shards that can hold a match. Consecutive windows of one
anchor travel as one run. A shard indexes the first runs of its anchors and streams the others through the index by backward
search: stretches whose matching statistics reach a window have their earliest place there; what stays below is indexed next.
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
from pyspark.sql.types import IntegralType

from .common import _BASE, _INVERSE, _powers, bound_batches, discard, materialise, mix, release, word_bounds, word_hashes
from .fmindex import FMIndex

#: Words of a window, and of the grams that name its shard.
WINDOW, GRAM = 20, 8
#: Words that one index holds: a bound on a task's memory, which grows with no input.
SHARD_WORDS = 1 << 19
#: An anchor with more distinct runs than this is dealt window by window instead, under each window's own hash, once for equal windows.
SPLIT = 512
#: Stands for a null key, before all others.
_LEAST = -(1 << 63)
#: Place, in answers, of a window that is dealt alone.
_LONE = -(1 << 14)


def _grams(h: np.ndarray, sums: np.ndarray, inverse: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[k:] - sums[:-k]) * inverse[: len(h) - k + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - width + have], x[width - have :]) if have < width else x


class _Hashes:
    """Prefix sums over the word hashes of one text; hashes of any stretch of words follow from two of them."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.h, self.inverse = h, _powers(_INVERSE, max(n, 1))
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * _powers(_BASE, max(n, 1))[:n], out=self.sums[1:])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, content hash, first window and number of windows of each run: windows with one leftmost anchor."""
        g = _grams(self.h, self.sums, self.inverse, GRAM)
        least = _sliding_least(g, WINDOW - GRAM + 1)
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (g[: len(least) - 1] == least[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(least)))
        return least[start], self.stretch(start, size + WINDOW - 1), start, size

    def stretch(self, start: np.ndarray, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + words] - self.sums[start]) * self.inverse[start] ^ np.uint64(0x5851F42D4C957F2D))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, the key or the least long for null; t1 and t2, 128 bits of the text's digest; text. Rows equal in key and text share their result."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number: documents are ordered by it")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("other"), body).alias("t2")
    return bound_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("k"), *digest, body.alias("text"))


def _run_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k", "t1", "t2", "a", "r", "at", "n"]
    for b in it:
        parts, which = [], []
        for i, body in enumerate(b.column(3).to_pylist()):
            h = word_hashes(body.encode("utf-8", "surrogatepass"))[2]
            if len(h) >= WINDOW:
                parts.append(_Hashes(h).runs())
                which.append(np.full(len(parts[-1][0]), i))
        if parts:
            a, r, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            i = np.concatenate(which)
            k, t1, t2 = (b.column(c).to_numpy(zero_copy_only=False)[i] for c in (0, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t1), pa.array(t2), pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16))], names)


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress texts before they are shuffled."""
    z = zstandard.ZstdCompressor(level=3)
    for b in it:
        body = [z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(body, pa.binary())], ["k", "t1", "t2", "z"])


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted run of a document, whole or, where ``split`` says so, window by window."""
    z = zstandard.ZstdDecompressor()
    names = ["split", "route", "other", "a", "r", "w", "n", "k", "at", "words"]
    for b in it:
        for k, packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = z.decompress(packed)
            starts, ends = word_bounds(data)
            hashes, rows = None, []
            for x in wanted:
                a, r, at, n = x["a"], x["r"], x["at"], x["n"]
                if not x["split"]:
                    rows.append((False, a, 0, a, r, 0, n, k, at, data[starts[at] : ends[at + n + WINDOW - 2]]))
                    continue
                hashes = hashes or _Hashes(word_hashes(data)[2])
                own = hashes.stretch(np.arange(at, at + n), np.full(n, WINDOW)).view(np.int64).tolist()
                for w in range(n):
                    words = b" ".join(data[starts[at + w] : ends[at + w + WINDOW - 1]].split())
                    other = int.from_bytes(xxhash.xxh3_64_digest(words), "big", signed=True)
                    rows.append((True, own[w], other, a, r, w, 1, k, at + w, words))
            columns = list(zip(*rows, strict=True))
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int32(), pa.binary()]
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _ragged(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[0], start[0] + 1, ... (n[0] values), start[1], ...; and the number of the stretch that each belongs to."""
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), which


class _Shard:
    """Runs gathered until they fill an index; see answers."""

    def __init__(self):
        self.contents: dict[bytes, int] = {}  # distinct words of runs, by route and place
        self.first: list[tuple[int, int]] = []  # their places: document, first word
        self.sizes: list[int] = []  # their words
        self.routes: list[int] = []
        self.rows: list[tuple] = []
        self.words = 0

    def add(self, route: int, words: bytes, n: int, k: int, at: int) -> int:
        """Place of ``words`` among the contents. Rows of a route come by document and place, so the first is the earliest."""
        i = self.contents.setdefault(words, len(self.contents))
        if i == len(self.first):
            self.first.append((k, at))
            self.sizes.append(n + WINDOW - 1)
            self.routes.append(route)
            self.words += n + WINDOW
        return i

    def earliest(self, ids: np.ndarray, early: np.ndarray) -> np.ndarray:
        """For the word at which each window begins, the word at which the same window begins first; else -1.

        Pieces (stretches of words, by route and place) are searched in turns. A turn indexes the first of each route, twice as
        many as the turn before, and streams the rest through the index. A stretch that matches WINDOW words or more has its
        earliest place in the index, as all indexed pieces of a route come before the streamed ones; the stretches below
        the threshold are the pieces of the next turn.
        """
        sizes = np.array(self.sizes)
        start, route = np.cumsum(sizes) - sizes, np.array(self.routes)
        source, lead = np.full(len(ids), -1), 1
        while len(start):
            first = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
            nth = np.arange(len(route)) - np.repeat(first, np.diff(np.append(first, len(route))))
            head = nth < lead
            word, piece = _ragged(start[head], sizes[head])
            text, at = np.zeros(len(word) + int(head.sum()), np.int64), np.arange(len(word)) + piece
            text[at] = ids[word]
            index = FMIndex(text, WINDOW)
            rank = np.full(len(text), len(ids))
            rank[at] = early[word]
            edge = np.flatnonzero(index.lcp < WINDOW)  # rows between edges share their first WINDOW words
            least = np.minimum.reduceat(rank[index.rows], edge)
            first_word = np.argsort(early)  # of each rank

            def place(row: np.ndarray, edge=edge, least=least, first_word=first_word) -> np.ndarray:
                return first_word[least[np.searchsorted(edge, row, "right") - 1]]

            row_of = np.empty(len(text), np.int64)
            row_of[index.rows] = np.arange(len(text))
            own, held = _ragged(start[head], sizes[head] - WINDOW + 1)
            source[own] = place(row_of[own - start[head][held] + at[np.cumsum(sizes[head]) - sizes[head]][held]])
            start, sizes, route = start[~head], sizes[~head], route[~head]
            if not len(start):
                break
            word, _ = _ragged(start, sizes)
            match, row = index.matching_statistics(ids[word], sizes)
            window, piece = _ragged(start, sizes - WINDOW + 1)
            where = window - start[piece] + (np.cumsum(sizes) - sizes)[piece]
            above = match[where] >= WINDOW
            source[window[above]] = place(row[where[above]])
            window, piece = window[~above], piece[~above]
            new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)))[: len(window)]
            begin = np.flatnonzero(new)
            start, route = window[begin], route[piece[begin]]
            sizes = np.diff(np.append(begin, len(window))) + WINDOW - 1
            lead *= 2
        return source

    def answers(self) -> pa.RecordBatch | None:
        """For each row its stretches of windows and where those windows occur first."""
        if not self.rows:
            return None
        sizes = np.array(self.sizes)
        ids = np.unique(word_hashes(b" ".join(self.contents))[2], return_inverse=True)[1] + 1
        nth, piece = _ragged(np.zeros(len(sizes), np.int64), sizes)
        k, at = np.array(self.first, np.int64).T
        k, at = k[piece], at[piece] + nth
        early = np.empty(len(ids), np.int64)
        early[np.lexsort((at, k))] = np.arange(len(ids))
        source = self.earliest(ids, early)
        windows = np.flatnonzero(source >= 0)
        where_k, where_at = k[source[windows]], at[source[windows]]
        own, w = piece[windows], nth[windows]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (where_k[1:] != where_k[:-1]) | (where_at[1:] != where_at[:-1] + 1)))
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(windows)))
        lo = np.searchsorted(own[start], np.arange(len(sizes) + 1))
        content, a, r, shift = (np.array(x, np.int64) for x in zip(*self.rows, strict=True))
        s, i = _ragged(lo[content], lo[content + 1] - lo[content])
        return pa.RecordBatch.from_arrays(
            [pa.array(a[i]), pa.array(r[i]), pa.array((w[start][s] + shift[i]).astype(np.int16)), pa.array(n[s].astype(np.int16)), pa.array(where_k[start][s]), pa.array(where_at[start][s].astype(np.int32))],
            ["a", "r", "w", "m", "first_k", "first_at"],
        )


def _answers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index the pieces of a partition, sorted by route, document and place, a shard at a time.

    A route that a full shard cuts in two is carried on: the next shard begins with the route's distinct contents, of
    which there are at most SPLIT (one for a route that is a window's own hash), so no window misses its earliest place.
    """
    shard, route, carried = _Shard(), None, {}
    for b in it:
        columns = (b.column(c).to_pylist() for c in ("route", "a", "r", "w", "n", "k", "at", "words"))
        for own, a, r, w, n, k, at, words in zip(*columns, strict=True):
            words = b" ".join(words.split())
            full = shard.words >= SHARD_WORDS or len(shard.rows) >= SHARD_WORDS
            if own != route:
                route, carried = own, {}
            if full:
                if (out := shard.answers()) is not None:
                    yield out
                shard = _Shard()
                for x, place in carried.items():
                    shard.add(route, x, *place)
            carried.setdefault(words, (n, k, at))
            shard.rows.append((shard.add(route, words, n, k, at), a, r, w))
    if (out := shard.answers()) is not None:
        yield out


def _remove(keep_words: bool):
    """Cut the windows out of each document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in it:
            rows, first = [], 0
            ends = np.cumsum(b.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts, windows = (b.column(4).flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "n"))
            for packed, last in zip(b.column(3), ends.tolist(), strict=True):
                words = z.decompress(packed.as_buffer()).split()
                removed = 0
                if last > first:
                    # stretches in order, those that touch joined
                    order = first + np.argsort(starts[first:last], kind="stable")
                    lo, hi = starts[order], np.maximum.accumulate(starts[order] + windows[order] + WINDOW - 1)
                    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    lo, hi = lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()
                    removed, n_words = sum(hi) - sum(lo), len(words)
                    kept = b" ".join([w for x, y in zip([0, *hi], [*lo, n_words], strict=True) for w in words[x:y]])
                else:
                    n_words, kept = len(words), b" ".join(words)
                first = last
                rows.append((n_words, removed, kept if keep_words else hashlib.sha256(kept).hexdigest()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            if keep_words:
                kept = [x.decode("utf-8", "surrogatepass") for x in kept]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["k", "t1", "t2", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """k, t1, t2, at, n: stretches of n windows, the first at word ``at``, that each occur earlier in the corpus; and the tables it is read from.

    1. Runs are cut from every document; anchors seen once are dropped by a grouped count, which combines before it
       shuffles. 2. Equal runs are grouped; documents that hold the first of a kind give its words. 3. Shards of pieces
       are indexed and searched; of equal windows of a crowded anchor one grouped minimum goes there. 4. Answers meet all occurrences of their runs by a join that Spark may split where skewed.
    """
    keyed = _keyed(docs, key, text)
    runs = materialise(keyed.mapInArrow(_run_rows, "k long, t1 long, t2 long, a long, r long, at int, n short"), "runs")
    # tables are written before they are joined where a grouping would else keep Spark from splitting a skewed side
    often = materialise(runs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a"), "often")
    hits = materialise(runs.join(often, "a", "left_semi"), "hits")
    discard(runs, often)
    release(docs.sparkSession)
    kinds = materialise(hits.groupBy("a", "r").agg(F.min(F.struct("k", "at", "t1", "t2", "n")).alias("f")), "kinds")
    crowded = materialise(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SPLIT).select("a", F.lit(True).alias("split")), "crowded")
    wanted = kinds.join(crowded, "a", "left").groupBy("f.k", "f.t1", "f.t2").agg(
        F.collect_list(F.struct("a", "r", F.col("f.at").alias("at"), F.col("f.n").alias("n"), F.coalesce("split", F.lit(False)).alias("split"))).alias("wanted")
    )
    packed = keyed.mapInArrow(_pack, "k long, t1 long, t2 long, z binary")
    pieces = packed.join(wanted, ["k", "t1", "t2"]).select("k", "z", "wanted")
    pieces = materialise(pieces.mapInArrow(_pieces, "split boolean, route long, other long, a long, r long, w short, n short, k long, at int, words binary"), "pieces")
    discard(kinds, crowded)
    release(docs.sparkSession)
    # of equal windows of crowded anchors (two hashes of 64 bits agree) only the first is dealt; the others meet its answer by both
    alone = pieces.filter("split").groupBy("route", "other").agg(F.min(F.struct("k", "at")).alias("f"), F.max("words").alias("words"))
    short = [F.lit(x).cast("short") for x in (_LONE, 1)]
    alone = alone.select("route", F.col("other").alias("a"), F.col("route").alias("r"), short[0].alias("w"), short[1].alias("n"), "f.k", "f.at", "words")
    dealt = pieces.filter("not split").drop("split", "other").unionByName(alone).repartition("route").sortWithinPartitions("route", "k", "at")
    answers = materialise(dealt.mapInArrow(_answers, "a long, r long, w short, m short, first_k long, first_at int"), "answers")
    lone = answers.filter("w < 0").select(F.col("r").alias("route"), F.col("a").alias("other"), "m", "first_k", "first_at")
    split = pieces.filter("split").select("route", "other", "a", "r", "w").join(lone, ["route", "other"]).select("a", "r", "w", "m", "first_k", "first_at")
    here = F.col("at") + F.col("w")
    earlier = (F.col("first_k") < F.col("k")) | ((F.col("first_k") == F.col("k")) & (F.col("first_at") < here))
    found = [hits.select("k", "t1", "t2", "a", "r", "at").join(x, ["a", "r"]).filter(earlier).select("k", "t1", "t2", here.cast("int").alias("at"), F.col("m").alias("n")) for x in (answers.filter("w >= 0"), split)]
    return found[0].unionByName(found[1]), [hits, pieces, answers]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_words: bool = True) -> DataFrame:
    """``key``, n_words, n_removed and ``kept``: the words left, joined by one space (or their SHA-256).

    A word goes if it lies in a window that also starts earlier: in a row of smaller key, or earlier in the same text.
    Null texts are empty. The key is a whole number (any other type is refused); a null key sorts before all others. Rows that repeat a key are one
    document at one place: a window at the same word of two such rows is earlier in neither. Each row gets its own result;
    rows equal in key and text get equal ones. An empty table gives an empty result; other columns are ignored.
    """
    windows, tables = repeated_windows(docs, key, text)
    cuts = materialise(windows.groupBy("k", "t1", "t2").agg(F.collect_set(F.struct("at", "n")).alias("cuts")), "cuts")
    discard(*tables)
    release(docs.sparkSession)
    packed = _keyed(docs, key, text).mapInArrow(_pack, "k long, t1 long, t2 long, z binary")
    done = packed.join(cuts, ["k", "t1", "t2"], "left").select("k", "t1", "t2", "z", "cuts").mapInArrow(_remove(keep_words), "k long, t1 long, t2 long, n_words long, n_removed long, kept string")
    return done.select(F.nullif(F.col("k"), F.lit(_LEAST)).alias(key), "n_words", "n_removed", "kept")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns for all ``documents``."""
    return dedup(docs, keep_words=False).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT k, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), late AS (
  SELECT k, i FROM (SELECT k, doc_id, i, min((doc_id, i)) OVER (PARTITION BY g) AS f FROM win) WHERE f < (doc_id, i)
), gone AS (
  SELECT DISTINCT k, i + j AS i FROM late, (SELECT unnest(range(20)) AS j)
), word AS (
  SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
