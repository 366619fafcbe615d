"""Packing token sequences: documents go to context-size tiers, long windows' gaps are filled from shorter tiers."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Context sizes, longest first. All are powers of two; a window of each is a full sequence.
TIERS = (4096, 2048, 1024, 512)
#: Tokens pooled before windows are cut: a bound on a task's memory, which grows with no input.
POOL_TOKENS = 1 << 20
#: Tokens that tasks leave unpacked (each less than a window) go to one packer for so many.
PACKER_TOKENS = 1 << 22
#: Words whose ids a worker remembers since it last forgot; as many again from before are remembered until then.
CACHE_WORDS = 1 << 18
END_ID = 2


#: The normalizer and splitter of vocabularies with word ends, whose pieces can be cut here.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable ASCII and Latin-1 letters, which NFC leaves alone, and the same pieces within them once in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, remembered by word and by piece of a word.

    The tokenizer drops white space and its pre-tokens never cross it, so the ids of a text are those of its words in
    turn (split at ASCII white space; any other white space is left to the tokenizer). Plain words are cut into
    pre-tokens here and only pieces not met before go to the model; other words go through the whole tokenizer. The
    constructor refuses tokenizers whose settings could join over white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        if set(kinds) - set(_NORMALIZERS) or any(" " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("this tokenizer's words depend on their neighbours")
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        self.plain = (
            kinds == _NORMALIZERS and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        )
        #: Added tokens are found in the text before anything else.
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the known words of the generation before
        self.pieces: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces, self.pieces_before = {}, self.pieces
            if (ids := self.pieces_before.get(piece)) is None:
                form = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
                ids = array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
            self.pieces[piece] = ids
        return ids

    def learn(self, missing: set[bytes]) -> None:
        odd, known, plain, cut = [], self.known, _PLAIN.fullmatch, _PIECES.findall
        for w in missing:
            s = w.decode()
            if self.plain and plain(s) and not ("<" in s and any(t in s for t in self.special)):
                found, pieces = cut(s.lower()), self.pieces
                try:
                    known[w] = b"".join([pieces[p] for p in found])
                except KeyError:
                    known[w] = b"".join([self.piece(p) for p in found])
            else:
                odd.append(w)
        if odd:
            got = self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(odd, got, strict=True))

    def encode(self, text: str) -> np.ndarray:
        words = text.encode().split()
        known = self.known
        missing = set(words).difference(known)
        if not missing:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)
        if len(known) + len(missing) > CACHE_WORDS:
            self.known, self.before = {}, known
            known, missing = self.known, set(words)
        held = {w: ids for w in missing if (ids := self.before.get(w)) is not None}
        known.update(held)
        self.learn(missing - held.keys())
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of a vocabulary; a worker that runs several tasks keeps what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Cuts documents into full windows of the tiers; see pack_documents. Rows: doc, start, length, crc, doc tokens, tier, nth window of the tier, offset."""

    def __init__(self):
        self.made = dict.fromkeys(TIERS, 0)
        self.pool: dict[int, list] = defaultdict(list)  # tier -> pieces (doc, start, ids, doc tokens), to be packed
        self.pooled = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, start = len(ids), 0
        while n - start >= TIERS[0]:
            yield from self.window(TIERS[0], [(doc, start, ids[start : start + TIERS[0]], n)])
            start += TIERS[0]
        if start < n:
            self.put((doc, start, ids[start:], n))

    def put(self, piece: tuple) -> None:
        self.pool[min(t for t in TIERS if t >= len(piece[2]))].append(piece)
        self.pooled += len(piece[2])

    def window(self, size: int, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, n in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, size, self.made[size], at
            at += len(ids)
        self.made[size] += 1

    def flush(self, last: bool) -> Iterator[tuple]:
        """Cut the pool into windows, longest tier first. Unless ``last``, pieces that fill no window stay: less than one of 4096."""
        for pieces in self.pool.values():
            pieces.sort(key=lambda p: len(p[2]))  # longest at the end; the sort is stable, so equal lengths keep their order of coming
        for tier in TIERS:
            below = [t for t in TIERS if t <= tier]
            tokens = sum(len(p[2]) for t in below for p in self.pool[t])
            while own := self.pool[tier]:
                if tokens < tier and not last:
                    break
                tokens -= tier  # what the next window takes; only a last one may take less
                pieces = [own.pop()]
                gap = tier - len(pieces[0][2])
                while gap and (best := self.longest(below, gap)):
                    pieces.append(best)
                    gap -= len(best[2])
                if gap and (cut := self.shortest(below)):  # no whole piece fits: cut one, and its rest stays
                    doc, start, ids, n = cut
                    pieces.append((doc, start, ids[:gap], n))
                    rest = (doc, start + gap, ids[gap:], n)
                    self.insert(min(t for t in TIERS if t >= len(rest[2])), rest)
                    gap = 0
                yield from self.window(tier, pieces) if not gap else self.tail(pieces)
        self.pooled = sum(len(p[2]) for pool in self.pool.values() for p in pool)

    def insert(self, tier: int, piece: tuple) -> None:
        pool, lo, hi = self.pool[tier], 0, len(self.pool[tier])
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if len(pool[mid][2]) < len(piece[2]) else (lo, mid)
        pool.insert(lo, piece)

    def longest(self, tiers: list[int], gap: int) -> tuple | None:
        """Take the longest piece of at most ``gap`` tokens, from the longest tier that has one."""
        for t in tiers:
            pool, lo, hi = self.pool[t], 0, len(self.pool[t])
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if len(pool[mid][2]) <= gap else (lo, mid)
            if lo:
                return pool.pop(lo - 1)
        return None

    def shortest(self, tiers: list[int]) -> tuple | None:
        for t in reversed(tiers):
            if self.pool[t]:
                return self.pool[t].pop(0)
        return None

    def tail(self, pieces: list) -> Iterator[tuple]:
        """The last pieces of a packer: full windows of the tiers as long as they go, then one padded window."""
        while pieces:
            total = sum(len(p[2]) for p in pieces)
            size = max((t for t in TIERS if t <= total), default=total)
            now, room = [], size
            while room:
                doc, start, ids, n = pieces.pop(0)
                now.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], n))
                room -= len(now[-1][2])
            yield from self.window(size if size in TIERS else TIERS[0], now)


_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "tier", "nth", "offset"]


def _batch(found: list[tuple], left: list[tuple], part: int, key: str, key_type: pa.DataType) -> pa.RecordBatch:
    """Rows of packed pieces, and of pieces left over (doc, start, ids, doc tokens), which carry their ids."""
    rows = [(*r, None) for r in found] + [(doc, start, len(ids), None, n, None, at, None, ids.astype("<u4").tobytes()) for at, (doc, start, ids, n) in enumerate(left)]
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    types = [key_type, *[pa.int64()] * 7, pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *arrays], ["part", key, *_PIECE, "left"])


def _pack_tasks(tokenizer: str, end_id: int, key: str):
    """Pack what a task reads; what fills no window is left over."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, key_type = Packer(), 0, pa.int64()
        encoder = encoder_of(tokenizer)
        for b in it:
            key_type = b.schema.field(0).type
            part = int(b.column(2)[0].as_py()) if b.num_rows else part
            found: list[tuple] = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found += packer.add(doc, np.append(encoder.encode(body or ""), np.uint32(end_id)))
                if packer.pooled >= POOL_TOKENS:
                    found += packer.flush(last=False)
            yield _batch(found, [], part, key, key_type)
        found = list(packer.flush(last=False))
        yield _batch(found, [p for t in TIERS for p in packer.pool[t]], part, key, key_type)

    return run


def _pack_left(key: str):
    """Pack the pieces that tasks left over. Parts of packers count down from -1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, key_type = Packer(), -1, pa.int64()
        for b in it:
            key_type = b.schema.field(0).type
            part = -1 - int(b.column(4)[0].as_py()) if b.num_rows else part
            for doc, start, n, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                packer.put((doc, start, np.frombuffer(ids, "<u4"), n))
            found = list(packer.flush(last=False)) if packer.pooled >= POOL_TOKENS else []
            yield _batch(found, [], part, key, key_type)
        yield _batch(list(packer.flush(last=True)), [], part, key, key_type)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, step_tokens: int = 16 * TIERS[0]) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    Each task packs what it reads. A document's full windows of 4096 are cut first; its rest goes to the shortest tier that
    holds it. Within a bounded pool each tier's windows, longest tier first, take their largest piece (of equal ones the latest),
    then the longest pieces of the same or shorter tiers that fit the gap, and at last a cut of the shortest piece, so
    windows come out full. The pieces that fill no window, less than 4096 tokens a task, travel with their ids to one packer
    for each PACKER_TOKENS of them, so how the input is split decides nothing and only the last window of a packer is padded.

    Windows are numbered over all tasks by prefix sums of the tasks' counts, longest tier first; a step is the next
    ``step_tokens`` tokens of them (a multiple of 4096). So a step holds windows of one length, but for the few where tiers
    change, and all steps but the last hold the same number of tokens.

    Null and empty texts are the end id alone; a very long text is one row of ids in memory, cut into windows at once; every id of
    every document, repeated rows included, lies in exactly one piece. An empty table gives no pieces. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"part long, `{key}` {kind}, " + ", ".join(f"`{n}` long" for n in _PIECE) + ", left binary"
    placed = bound_batches(docs).select(key, text, F.spark_partition_id().alias("_part"))
    made = materialise(placed.mapInArrow(_pack_tasks(tokenizer, end_id, key), schema), "packed")
    left = made.filter("left is not null")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = left.repartition(max(1, -(-tokens // PACKER_TOKENS)), "part").sortWithinPartitions("part", "nth")
    dealt = dealt.select(key, "start", "doc_tokens", "left", F.spark_partition_id().alias("_packer"))
    rest = materialise(dealt.mapInArrow(_pack_left(key), schema), "packed-rest")
    rows = made.filter("left is null").drop("left").unionByName(rest.drop("left"))
    # as many rows as tasks and tiers
    counts = rows.groupBy("part", "tier").agg((F.max("nth") + 1).alias("_n"))
    before = Window.orderBy(F.col("tier").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    first = [F.coalesce(F.sum(x).over(before), F.lit(0)).alias(c) for x, c in ((F.col("_n"), "_windows"), (F.col("_n") * F.col("tier"), "_tokens"))]
    rows = rows.join(counts.select("part", "tier", *first), ["part", "tier"])
    step = F.floor((F.col("_tokens") + F.col("nth") * F.col("tier")) / step_tokens).cast("long")
    return rows.select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_windows") + F.col("nth")).alias("sequence_id"), "offset", "tier", step.alias("step_id"))


def op5_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns for all ``documents``, and each piece's tier and step."""
    return pack_documents(docs, tokenizer or default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
