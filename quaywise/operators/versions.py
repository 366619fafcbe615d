"""Versions and merges: snapshots that are committed against the version they expect, rows merged by fingerprint, lookups that are asked once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .close import checksum


class VersionConflict(Exception):
    """Another writer committed the version that this one was about to."""


class Snapshots:
    """Locked versions of reports in a folder that all writers share, each period's in a folder of its own.

    A version is a table of rows and a pointer to it. Rows are written first, where nobody reads them; the pointer is then renamed to the
    number of the version, which the file system refuses if another writer has put one there. So of two writers that saw the same
    version one wins, and the other's rows are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, period: str) -> list[int]:
        """Numbers of the committed versions of a period, oldest first."""
        fs, path = self._files(), self._path(period, "versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def about(self, period: str, version: int) -> dict:
        """What was committed: version, rows (where they are), n, checksum and note."""
        return json.loads(self.spark.read.text(f"{self.root}/{period}/versions/{version}", wholetext=True).first()[0])

    def read(self, period: str, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest; a version whose rows were changed since is refused."""
        have = self.versions(period)
        if not have or (version is not None and version not in have):
            raise ValueError(f"{period} has no version {version or ''}".rstrip())
        about = self.about(period, version or have[-1])
        rows = self.spark.read.parquet(f"{self.root}/{period}/{about['rows']}")
        found = checksum(rows.withColumn("_all", F.lit(0)), ["_all"]).first()
        if (found.checksum if found else "") != about["checksum"]:
            raise ValueError(f"version {about['version']} of {period} was changed after it was locked")
        return rows

    def commit(self, rows: DataFrame, period: str, expected: int | None = None, note: str = "") -> int:
        """Lock ``rows`` as the next version of a period; its number. ``expected`` is the latest version that the writer saw (0: none).

        A second version wants a note that says why. Raises VersionConflict if the latest version is another, or becomes another meanwhile.
        """
        have = self.versions(period)
        latest = have[-1] if have else 0
        if expected is not None and expected != latest:
            raise VersionConflict(f"version {latest} of {period} was locked meanwhile")
        if latest and not note.strip():
            raise ValueError(f"version {latest} of {period} is locked: say why the amount changes")
        fs, name = self._files(), f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{period}/{name}")
        written = self.spark.read.parquet(f"{self.root}/{period}/{name}")
        found = checksum(written.withColumn("_all", F.lit(0)), ["_all"]).first()
        about = {"version": latest + 1, "rows": name, "n": found.n if found else 0, "checksum": found.checksum if found else "", "note": note.strip()[:500]}
        draft = self._path(period, f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        fs.mkdirs(self._path(period, "versions"))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(period, "versions", str(latest + 1)), none)
        except Exception as error:
            fs.delete(draft, False)
            fs.delete(self._path(period, name), True)
            if "FileAlreadyExists" in str(error) or "already exist" in str(error):
                raise VersionConflict(f"version {latest + 1} of {period} was locked meanwhile") from error
            raise
        return latest + 1


def merged(stored: DataFrame, fresh: DataFrame, key: list[str], content: list[str], human: list[str]) -> DataFrame:
    """``fresh`` rows merged into ``stored`` ones: key, content, what people chose (``human`` columns of stored), action.

    Rows meet by key and are told apart by a digest of their content: kept, changed, added, or gone (listed with their stored
    content). Choices are carried over to rows that are kept or changed. Merging the result's live rows with the same fresh rows again
    keeps them all. Keys are unique on either side; a null in a key equals a null.
    """

    def marked(df: DataFrame, more: list[str], side: str) -> DataFrame:
        digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        return df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\\0")).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*key, *content, *more).alias(side), digest.alias(f"{side}_d"))

    on = [f"_k{i}" for i in range(len(key))]
    both = marked(stored, human, "_s").join(marked(fresh, [], "_f"), on, "full_outer")
    action = F.when(F.col("_s").isNull(), "added").when(F.col("_f").isNull(), "gone").when(F.col("_s_d") == F.col("_f_d"), "kept").otherwise("changed")
    side = [F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(f"_s.{c}")).alias(c) for c in (*key, *content)]
    return both.select(*side, *[F.col(f"_s.{c}").alias(c) for c in human], action.alias("action"))


def unseen(pairs: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ``key`` values that the cache has no answer for."""
    return pairs.select(*key).distinct().join(cache.select(*key), key, "left_anti")


def answered(cache: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """The cache with answers to what it hadn't; of several for one key the first in order of its columns, and never one in place of an earlier answer."""
    rest = [c for c in cache.columns if c not in key]
    one = answers.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_a")).select(*key, *[F.col(f"_a.{c}").alias(c) for c in rest])
    return cache.unionByName(one.join(cache.select(*key), key, "left_anti").select(*cache.columns))
