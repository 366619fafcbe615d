"""Media columns: content-addressed PNG payloads in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, scratch

#: Payload bytes in a row of pixels; payloads are padded with zeros to a multiple of it.
WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, IHDR chunk: what a header-only read fetches.
HEADER_BYTES = 33
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 64 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are ``payload``, WIDTH to a row, losslessly."""
    rows = len(payload) // WIDTH
    raw = b"".join(b"\0" + payload[i * WIDTH : (i + 1) * WIDTH] for i in range(rows))
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height, from the first HEADER_BYTES alone."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">II", header[16:24])


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png made; checksums are verified."""
    width, rows = png_size(stored[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = memoryview(zlib.decompress(b"".join(packed)))
    return b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(rows))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text without padding, and the payload: UTF-8, zeros up to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def feature_of(samples: bytes) -> str:
    """Size, sum, extremes and shares of four bands of the samples, as text."""
    bands = [0, 0, 0, 0]
    counts = [samples.count(bytes([v])) for v in (0, 10, 32)]
    for i, (lo, hi) in enumerate(((0, 64), (64, 128), (128, 192), (192, 256))):
        bands[i] = len(samples) - len(samples.translate(None, bytes(range(lo, hi))))
    return f"rows={len(samples) // WIDTH};adler={zlib.adler32(samples)};zero,line,space={counts};bands={bands}".replace(" ", "")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


#: Begins the names of shards that are still written; what failed attempts leave of them is deleted once the index is complete.
_OPEN = "_open-"


class _Writer:
    """Tar shards of a task, a member a digest. A shard is named by its members when it is full, and its rows are given out then."""

    def __init__(self, root: str, key_name: str):
        self.system, self.base = _filesystem(root)
        self.names = [key_name, "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]
        self.sink = None

    def _begin(self) -> None:
        self.open_name = f"{self.base}/{_OPEN}{uuid.uuid4().hex}"
        self.sink = self.system.open_output_stream(self.open_name)
        self.at, self.known, self.held = 0, {}, []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.sink is None:
            return
        self.sink.write(b"\0" * 1024)
        self.sink.close()
        self.sink = None
        shard = hashlib.sha256("".join(self.known).encode()).hexdigest()[:32] + ".tar"
        from pyarrow import fs

        # another attempt, or another task with the same members, may have put it there: the bytes are the same
        if self.system.get_file_info(f"{self.base}/{shard}").type == fs.FileType.NotFound:
            self.system.move(self.open_name, f"{self.base}/{shard}")
        else:
            self.system.delete_file(self.open_name)
        for keys, rows in self.held:
            n, size, digest, at, length = zip(*rows, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array([shard] * len(rows)), pa.array(at, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays([keys, *columns], self.names)

    def add(self, keys: pa.Array, bodies: list[str | None]) -> Iterator[pa.RecordBatch]:
        rows, first = [], 0
        for i, body in enumerate(bodies):
            n, payload = payload_of(body)
            digest = hashlib.sha256(payload).hexdigest()
            if self.sink is not None and digest not in self.known and self.at >= SHARD_BYTES:
                if rows:
                    self.held.append((keys.slice(first, i - first), rows))
                rows, first = [], i
                yield from self.close()
            if self.sink is None:
                self._begin()
            if digest not in self.known:
                stored = encode_png(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(stored)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                self.known[digest] = self.at + len(head), len(stored)
                for part in (head, stored, b"\0" * (-len(stored) % 512)):
                    self.sink.write(part)
                    self.at += len(part)
            rows.append((n, len(payload), digest, *self.known[digest]))
        if rows:
            self.held.append((keys.slice(first), rows))


def write_shards(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text under ``root`` and return the index: key, n_bytes, payload_bytes, digest, shard, offset, length.

    Each task writes its own tar shards, a member a digest, so a shard holds a payload once however many rows have it. A shard is
    written under a name of its own and renamed by what it holds, so attempts can't mix, and equal inputs dealt alike give equal shards. The
    index is itself written under ``root``: reading it never writes shards again. Every row of a digest has one address (``one_address``).
    """
    kind = docs.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(root, key)
        for b in it:
            yield from writer.add(b.column(0), b.column(1).to_pylist())
        yield from writer.close()

    system, base = _filesystem(root)
    system.create_dir(base)
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"
    made = bound_batches(docs).select(key, text).mapInArrow(batches, schema)
    made.write.parquet(f"{root}/index")
    from pyarrow import fs

    for left in system.get_file_info(fs.FileSelector(base)):
        if left.base_name.startswith(_OPEN):
            system.delete_file(left.path)
    return one_address(docs.sparkSession.read.schema(made.schema).parquet(f"{root}/index"), key)


def one_address(index: DataFrame, key: str) -> DataFrame:
    """Every row with the address of its digest, the least (shard, offset), in order of addresses, so that each is read once a task.

    The minimum is combined before it is shuffled, and only addresses move, not payloads; a digest that many rows have is dealt over tasks by
    the rows' places. Copies that other tasks have stored are nobody's address.
    """
    least = materialise(index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_a")), "addresses")
    rows = index.drop("shard", "offset", "length").withColumn("_row", F.monotonically_increasing_id()).join(least, "digest")
    rows = rows.select(*[c for c in index.columns if c not in ("shard", "offset", "length")], "_a.*", "_row")
    return rows.repartitionByRange("shard", "offset", "_row").sortWithinPartitions("shard", "offset", "_row").drop("_row")


class _Ranges:
    """Range reads from shards, one open shard at a time."""

    def __init__(self, root: str):
        self.system, self.base = _filesystem(root)
        self.name = self.file = None

    def __call__(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.system.open_input_file(f"{self.base}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def with_header(index: DataFrame, root: str) -> DataFrame:
    """Fill ``width`` and ``height`` by reading the first HEADER_BYTES of each row's media and nothing else."""
    names = [*index.columns, "width", "height"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Ranges(root)
        for b in it:
            last, sizes = None, []
            for at in zip(*(b.column(c).to_pylist() for c in ("shard", "offset")), strict=True):
                sizes.append(sizes[-1] if at == last else png_size(read(*at, HEADER_BYTES)))
                last = at
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in sizes], pa.int64()) for i in (0, 1))], names)

    return index.mapInArrow(batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", width long, height long")


def read_media(index: DataFrame, root: str) -> DataFrame:
    """Read each row's stored bytes back and add digests and the feature, computed from what was read.

    ``index``: shard, offset, length and any others. A payload that differs from its ``digest`` fails the read.
    """
    names = [*index.columns, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(stored: bytes, digest: str) -> tuple:
        samples = decode_png(stored)
        found = hashlib.sha256(samples).hexdigest()
        if found != digest:
            raise ValueError("a payload differs from its digest")
        return found, zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, last, got = _Ranges(root), None, None
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in it:
            rows = []
            for *at, digest in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if at != last:
                    last, got = at, one(read(*at), digest)
                rows.append(got)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(batches, schema + ", payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(docs: DataFrame, root: str | None = None) -> DataFrame:
    """The contract's columns for all ``documents``; shards and index stay under ``root`` for the caller to use or delete.

    Rows carry the payload's digest and its shard, offset and length; width and height come from range reads of the headers alone,
    the contract's digests and feature from the stored bytes. A null text is empty (one padded row of zeros); equal texts have
    equal values and one address over the whole table, and two runs over equally dealt rows give equal results; a very long text is one payload,
    held in memory with its image; repeated keys each get a row; an empty table writes no shard; other columns are ignored.
    """
    root = root or scratch(docs.sparkSession, "media")
    return read_media(with_header(write_shards(docs, root), root), root)
