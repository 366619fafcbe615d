"""Centroid clustering with exact integer arithmetic: Lloyd's rounds whose nearest centroids are found by annulus search.

Centroids are sorted by norm. A vector of norm m whose distance to some centroid is u has its nearest centroid among those of norm
m - u to m + u, since distances are no less than differences of norms; two binary searches bound them, and only they are computed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialise

#: Components of a vector, clusters, rounds, and steps of a unit.
SIZE, CLUSTERS, ROUNDS, STEPS = 64, 40, 5, 256
#: Components of up to this size have squared distances, over 64 components, within 64 bits.
LARGEST = 1 << 27
#: Below this bound sums of products are exact in doubles too, and so go through matrix products.
_EXACT = 1 << 53


def whole_vectors(rows: DataFrame, vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """Rows whose vector has ``size`` components, none null or not finite, with it in whole steps as ``_v``."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fits = (F.size(vector) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    kept = rows.filter(F.col(vector).isNotNull()).filter(F.coalesce(fits, F.lit(False)))
    step = F.transform(x, lambda c: F.floor(c * STEPS))
    small = F.forall(x, lambda c: F.abs(c) <= LARGEST // STEPS)
    refused = F.raise_error(F.lit(f"a component is beyond {LARGEST // STEPS}: squared distances would pass 64 bits")).cast("array<bigint>")
    return kept.withColumn("_v", F.when(small, step).otherwise(refused))


class Centroids:
    """Integer centroids, sorted by norm for the search."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def distance(self, v: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """Exact squared distances of each vector to centroid j (one, or one for each vector)."""
        d = v - self.rows[j]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, v: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smaller of ties) and squared distance of each vector; and the distances computed.

        ``guess`` bounds a vector's distance: by default the centroid next to it in norm. The annulus is widened by a relative 1e-9 and one step,
        above the rounding of square roots, so centroids on its edge are among those computed.
        """
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        if guess is None:
            at = np.clip(np.searchsorted(self.norm, norm), 1, max(len(self.norm) - 1, 1))
            left = norm - self.norm[at - 1] <= self.norm[np.minimum(at, len(self.norm) - 1)] - norm
            guess = self.order[np.where(left, at - 1, np.minimum(at, len(self.norm) - 1))]
        best, number = self.distance(v, guess), guess.astype(np.int64).copy()
        reach = np.sqrt(best.astype(np.float64))
        slack = 1 + 1e-9 * (norm + reach)
        low = np.searchsorted(self.norm, norm - reach - slack, "left")
        high = np.searchsorted(self.norm, norm + reach + slack, "right")
        computed = len(v)
        fast = len(v) and int(np.abs(v).max()) ** 2 * v.shape[1] * 4 < _EXACT and int(np.abs(self.rows).max()) ** 2 * v.shape[1] * 4 < _EXACT
        square = np.einsum("ij,ij->i", v, v) if fast else None
        plain = v.astype(np.float64) if fast else None
        for place, j in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high))
            if not len(rows):
                continue
            computed += len(rows)
            if fast:
                c = self.rows[j]
                d = square[rows] + int(c @ c) - 2 * (plain[rows] @ c.astype(np.float64)).astype(np.int64)
            else:
                d = self.distance(v[rows], j)
            better = (d < best[rows]) | ((d == best[rows]) & (j < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], j
        return number, best, computed

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.rows.tolist()]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(centroids: Centroids):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.rows.shape
        count, total, held = np.zeros(k, np.int64), np.zeros((k, size), np.int64), 0

        def out() -> pa.RecordBatch:
            there = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(there), pa.array(count[there]), pa.array(list(total[there]), pa.list_(pa.int64()))], ["cluster", "n", "total"]
            )

        for b in it:
            for at in range(0, len(b), 4096):
                v = _vectors(b.column(0).slice(at, 4096))
                number, _, _ = centroids.nearest(v)
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[order], prepend=-1))
                total[number[order][first]] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(number, minlength=k)
                held += len(v)
                if held > 1 << 34:  # sums of components of LARGEST stay within 64 bits
                    yield out()
                    count[:], total[:], held = 0, 0, 0
        yield out()

    return run


def _assigned(centroids: Centroids):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                number, distance, _ = centroids.nearest(_vectors(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(number.astype(np.int32)), pa.array(distance)], [*part.schema.names[:-1], "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, key: str, clusters: int) -> np.ndarray:
    """The vectors of the least SHA-256 of ``2:<key>``, in that order; a null key is an empty one, rows of one key go by their vectors."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(digest.alias("digest"), "_v").orderBy("digest", "_v").limit(clusters).collect()
    return np.array([r._v for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


def fit(rows: DataFrame, key: str, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Centroids:
    """Centroids after ``rounds`` rounds over ``rows`` of ``whole_vectors``. A round is one aggregation; the driver gets sums of ``clusters`` vectors."""
    current = first_centroids(rows, key, clusters)
    if not len(current):
        return Centroids(np.zeros((0, 0), np.int64))
    for _ in range(rounds):
        sums = bound_batches(rows.select("_v")).mapInArrow(_sums(Centroids(current)), "cluster long, n long, total array<long>")
        whole = F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
        # every task sends one row a cluster; components are summed apart, as decimals
        parts = sums.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), whole).collect()
        current = current.copy()
        for r in parts:
            current[r.cluster, r.at] = int(r.x) // r.n
    return Centroids(current)


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row whose vector has ``size`` finite components.

    Vectors of another length, with a null or a component that isn't finite are left out; rows that repeat a key each get a row and count each;
    ties go to the smaller number; clusters without vectors keep their centroid; with fewer vectors than ``clusters`` there are as
    many clusters as vectors; an empty table gives no rows; other columns are ignored. A component beyond 524,288 is an error, as its
    squared distance would pass 64 bits; so would an inertia beyond 64 bits.
    """
    own = whole_vectors(rows.select(F.col(key), F.col(vector)), vector, size).select(F.col(key).alias("_key"), "_v")
    kept = materialise(own, "vectors")
    model = fit(kept, "_key", clusters, rounds)
    key_type = kept.schema["_key"].dataType.simpleString()
    out = f"_key {key_type}, cluster int, distance long"
    if not len(model.rows):
        found = kept.sparkSession.createDataFrame([], out)
    else:
        found = materialise(bound_batches(kept).mapInArrow(_assigned(model), out), "clusters")
    discard(kept)
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    digests = kept.sparkSession.createDataFrame(list(enumerate(model.digests())), "cluster int, centroid_sha256 string")
    total = total.join(F.broadcast(digests), "cluster").select("cluster", F.col("d").cast("long").alias("cluster_inertia"), "centroid_sha256", "d")
    every = total.agg(F.sum("d").cast("long").alias("inertia"))
    # one row a cluster: bounded by ``clusters``
    each = total.drop("d").join(F.broadcast(every), F.lit(True))
    return found.join(F.broadcast(each), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_annulus(rows: DataFrame) -> DataFrame:
    """The contract's columns for all ``embeddings``."""
    return clustered(rows)


def _oracle() -> str:
    """Lloyd's rounds as common tables, one after the other."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 40))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT i, vec_id, v, (arg_min(j, (d, j)))::INTEGER AS j, min(d) AS d
  FROM (SELECT i, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n}) GROUP BY i, vec_id, v
)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""s{n} AS (
  SELECT j, list(m ORDER BY place) AS c FROM (
    SELECT j, place, (sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS m
    FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS place FROM a{n}) GROUP BY j, place) GROUP BY j
), c{n + 1} AS MATERIALIZED (SELECT j, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (j))"""
            )
    last = f"""SELECT vec_id, j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (j)"""
    return "WITH " + ", ".join(parts) + "\n" + last


ORACLE_SQL = _oracle()
