"""Helpers that the corpus operators share: scratch tables on shared storage and vectorised words."""

from __future__ import annotations

import gc
import re
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.sources.scratch import discard, materialise, scratch

__all__ = ["bound_batches", "discard", "materialise", "mix", "read_documents", "release", "scratch", "text_or_empty", "word_bounds", "word_hashes"]

#: Words of every contract: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended.

    Its cleaner waits for the driver's garbage collection, which a quiet driver puts off for half an hour; a chain of
    large stages would meanwhile hold the files of all of them.
    """
    for _ in range(2):  # what the first round frees refers to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends rows to Python in batches of BATCH_BYTES at most: texts have any length, and a worker holds
    a batch several times over."""
    spark = df.sparkSession
    if (spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "") != f"{BATCH_BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


_SEED = np.random.RandomState(20240229)
_BYTE = _SEED.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... (n of them), modulo 2 ** 64; a worker keeps those it has computed."""
    have = _KNOWN.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _KNOWN[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 text."""
    edge = np.diff(np.concatenate(([0], (~_SPACE[np.frombuffer(data, np.uint8)]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes of text whose words are hashed at once; some forty bytes of memory go with each.
_BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of UTF-8 text, a block of it at a time; blocks end between words."""
    parts, at = [], 0
    while at < len(data) or not parts:
        gap = _GAP.search(data, at + _BLOCK) if len(data) - at > _BLOCK else None
        end = gap.start() if gap else len(data)
        starts, ends, hashes = _hash_block(data[at:end])
        parts.append((starts + at, ends + at, hashes))
        at = end
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(data)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _powers(_BASE, max(len(b), 1))[: len(b)], out=total[1:])
        own = (total[ends] - total[starts]) * _powers(_INVERSE, len(b) + 1)[starts]
        return starts, ends, mix(own + (ends - starts).astype(np.uint64))
