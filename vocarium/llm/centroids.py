"""Centroid clustering by scalar lookup tables.

Vectors become integers once. A round tabulates, for each dimension, each integer that occurs in a batch of
vectors and each centroid, the squared difference; a vector's distances are gathers from these tables and
sums. All arithmetic is on integers, so the result does not depend on how the vectors are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.llm.rows import make_room, plain
from vocarium.session import written

#: Components of a vector and steps of one unit.
DIMENSION, SCALE = 64, 1024

CLUSTERS, ROUNDS, SEED = 8, 10, 3

#: Vectors whose tables are made together; the tables have at most so many rows for each dimension.
TOGETHER = 4096

#: Integers beyond this could give distances and sums that no long holds.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, steps)`` of the rows whose vector is whole and finite: the floor of ``scale`` times each component."""
    values = F.col(vector).cast("array<double>")
    whole = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.raise_error(F.lit(f"a component is beyond {LARGEST / scale}; its squared distances would not fit into a long"))
    step = lambda x: F.when(F.abs(x) <= LARGEST / scale, F.floor(x * scale)).otherwise(far).cast("int")
    return vectors.filter((F.size(values) == dimension) & whole).select(F.col(key).cast("bigint").alias(key), F.transform(values, step).alias("steps"))


class Vectors:
    """Some vectors as places in the sorted integers of each dimension."""

    def __init__(self, steps: np.ndarray):
        coded = [np.unique(column, return_inverse=True) for column in steps.T]
        self.sizes = np.array([len(known) for known, _ in coded])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.integers = np.concatenate([known for known, _ in coded]).astype(np.int64)
        self.places = [place + first for (_, place), first in zip(coded, self.first, strict=True)]
        self.count = len(steps)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, of equally near ones the first, and the squared distance."""
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        table = (self.integers[:, None] - centroids.T[of]) ** 2  # [occurring integers, centroids]
        total = np.zeros((self.count, len(centroids)), np.int64)
        for place in self.places:
            total += table[place]
        cluster = total.argmin(1)
        return cluster, total[np.arange(self.count), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sums of the vectors of each cluster ``[k, dimension]``: how often each integer occurs in it, times the integer."""
        n = len(self.integers)
        times = sum(np.bincount(place + cluster * n, minlength=k * n) for place in self.places).reshape(k, n)
        return np.add.reduceat(times * self.integers, self.first, axis=1)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Vectors]]:
    make_room(__name__)
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part.column(0), Vectors(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))


def first_centroids(stored: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id, in that order; equal ids by their components."""
    key = stored.columns[0]
    rows = stored.select(hash_of(key, seed).alias("h"), "steps").orderBy("h", "steps").limit(k).collect()
    return np.array([r["steps"] for r in sorted(rows)], np.int64)


def hash_of(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of the exact means; those without vectors stay. Each task sends one row a cluster."""
    k, dimension = centroids.shape
    schema = "cluster int, n long, sums array<long>"
    arrow = to_arrow_schema(stored.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for _, vectors in _together(batches):
            cluster, _ = vectors.nearest(centroids)
            n += np.bincount(cluster, minlength=k)
            sums += vectors.sums(cluster, k)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((range(k), n, list(sums)), arrow, strict=True)], schema=arrow)

    parts = plain(stored).mapInArrow(run, schema).filter("n > 0").select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    after = centroids.copy()
    for row in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        after[row["cluster"], row["d"]] = row["s"] // row["n"]
    return after


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(key, cluster, distance)`` for every stored vector."""
    schema = f"{stored.columns[0]} long, cluster int, distance long"
    arrow = to_arrow_schema(stored.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _together(batches):
            cluster, distance = vectors.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=arrow)

    return plain(stored).mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION,
            scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows ``(key, cluster, distance)`` of all kept vectors, and the centroids ``[k, dimension]``.

    A vector is kept when it has ``dimension`` components, none null or not finite; the others give no row.
    A component's integer is the floor of ``scale`` times it; one beyond ``LARGEST`` raises an error. Fewer
    than ``k`` kept vectors give as many centroids. Ties go to the smaller centroid. Repeated rows count
    as often as they occur; a null id hashes as an empty one; other columns play no part; an empty table
    gives no rows.
    """
    stored = written(quantised(vectors, dimension, scale, key, vector), "vectors")
    centroids = first_centroids(stored, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(stored, centroids)
    return assigned(stored, centroids), centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of its cluster and of all, and the digest of its centroid."""
    spark = found.sparkSession
    found = written(found, "assigned")
    shas = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    digests = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    # One row a cluster on the small side of each join.
    return found.join(F.broadcast(inertia), "cluster").join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(whole)).select(
        found.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> str:
    """The registered query in DuckDB, a pair of tables for each round."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256(concat('{seed}:', vec_id)) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT n, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT v.n, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c)
  GROUP BY n)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
      SELECT a.best.c AS c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n
      FROM a{r} a JOIN v USING (n), (SELECT unnest(range(1, {dimension} + 1)) AS i) GROUP BY ALL)
    GROUP BY c) m ON m.c = c.c)""")
    return "WITH " + ",".join(steps) + f"""
SELECT v.vec_id, a.best.c::INT AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (n) JOIN c{rounds} c ON c.c = a.best.c"""
