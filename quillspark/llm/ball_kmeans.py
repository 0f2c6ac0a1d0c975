"""Ball k-means over integer vectors, exact.

A cluster is a ball: its centroid and a radius that all members lie in. Centroid j is a neighbour of i if half their distance is within i's radius. A member
nearer to its centroid than half the way to the nearest neighbour is in the stable core and stays without a comparison; beyond that, neighbours in order
of their distance cut the ball into annuli, and a member of the n-th annulus is compared exactly with the n nearest neighbours only.
The result is that of comparing everything, since d(x, j) >= d(i, j) - d(x, i).

The first round begins with one ball around centroid 0 of unknown radius. Later a radius is the greatest distance of a member to the old centroid, as the
round before measured it, plus the centroid's shift, so no pass is needed for it. Vectors and their clusters are a table, written anew each round; a
task adds up its own members for each cluster, and k x (dimensions + 2) numbers go to the driver.

Vectors of another length, null vectors and those with a null or non-finite component are left out. Components beyond +-2^27 count as that, so that squared
distances fit 64 bits. Null ids are ids like others. Repeated rows are vectors of their own; of equal starting hashes the lesser vector is first.
Fewer vectors than k give fewer clusters, no vectors no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

WIDEST = 1 << 27
ROWS = 4096


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: float) -> DataFrame:
    """id, v: floor(scale x) of each component of whole, finite vectors."""
    good = F.size(vector_col).eqNullSafe(dimensions) & F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    part = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(WIDEST))), F.lit(float(-WIDEST)))).cast("int")
    return df.where(good).select(F.col(id_col).alias("id"), F.transform(vector_col, part).alias("v"))


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the k smallest hashes of `seed:id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray, radius: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each centroid those within twice its radius, as (squared distance, number), nearest first."""
    out = []
    for i, c in enumerate(centroids):
        d = squared(centroids, c)
        out.append(sorted((int(d[j]), j) for j in range(len(centroids)) if j != i and d[j] <= 4 * radius[i] ** 2))
    return out


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and its squared distance, and how many distances were computed. own: the rows' present clusters."""
    cluster, distance, n = own.copy(), np.empty(len(x), np.int64), len(x)
    for i in np.unique(own).tolist():
        at = np.flatnonzero(own == i)
        first = best = squared(x[at], centroids[i])
        which = np.full(len(at), i)
        for gap, j in near[i]:
            beyond = np.flatnonzero(4 * first >= gap)  # the annuli from this neighbour's on; those inside are nearer to i
            if not len(beyond):
                break
            d = squared(x[at[beyond]], centroids[j])
            n += len(d)
            better = (d < best[beyond]) | ((d == best[beyond]) & (j < which[beyond]))
            best = best.copy()
            best[beyond[better]], which[beyond[better]] = d[better], j
        cluster[at], distance[at] = which, best
    return cluster, distance, n


def matrix(v: pa.Array, dimensions: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def assign(members: DataFrame, centroids: np.ndarray, radius: np.ndarray) -> DataFrame:
    """id, v, cluster, distance: each vector in its nearest cluster."""
    near, kind = neighbours(centroids, radius), members.select("id", "v", "cluster", "distance").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                x = matrix(part.column("v"), centroids.shape[1])
                cluster, distance, _ = nearest(x, part.column("cluster").to_numpy(), centroids, near)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "v", "cluster", "distance"])

    return members.select("id", "v", "cluster", "distance").mapInArrow(run, kind)


def add_up(members: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Of each cluster its members' sum, their number and the greatest squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 2), np.int64)
        for batch in batches:
            cluster, distance = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            x = matrix(batch.column("v"), dimensions)
            for i in np.unique(cluster).tolist():
                at = cluster == i
                total[i, :dimensions] += x[at].sum(0)
                total[i, dimensions] += at.sum()
                total[i, -1] = max(total[i, -1], distance[at].max())
        some = np.flatnonzero(total[:, dimensions])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dimensions + 2), pa.int32()), pa.array(np.tile(np.arange(dimensions + 2), len(some)), pa.int32()), pa.array(total[some].ravel())], ["cluster", "at", "x"])

    rows = members.select("v", "cluster", "distance").mapInArrow(run, "cluster int, at int, x long").groupBy("cluster", "at").agg(F.sum("x").alias("total"), F.max("x").alias("most")).collect()
    sums, n, most = np.zeros((k, dimensions), object), [0] * k, np.zeros(k, np.int64)
    for r in rows:
        if r["at"] < dimensions:
            sums[r.cluster, r["at"]] = r.total
        elif r["at"] == dimensions:
            n[r.cluster] = r.total
        else:
            most[r.cluster] = r.most
    return sums, n, most


def cluster(df: DataFrame, id_col: str, vector_col: str, dimensions: int, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """id, v, cluster, distance of each whole vector, and the centroids."""
    spark = df.sparkSession
    at = common.scratch(spark, "balls")
    unknown = whole_numbers(df, id_col, vector_col, dimensions, scale).withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
    members = common.write(unknown, at)
    centroids = start(members, k, seed)
    if not len(centroids):
        return members, centroids
    radius = np.full(len(centroids), np.inf)
    for turn in range(rounds + 1):
        to = common.scratch(spark, "balls")
        members = common.write(assign(members, centroids, radius), to)
        common.remove(spark, at)
        at = to
        if turn < rounds:
            sums, n, most = add_up(members, len(centroids), dimensions)
            moved = np.array([[s // count for s in row] if count else old for row, count, old in zip(sums, n, centroids.tolist(), strict=True)], np.int64)
            # rounded up, so that a radius is never too small
            radius = (np.sqrt(most.astype(float)) + np.sqrt(squared(moved, centroids).astype(float))) * (1 + 1e-9) + 1e-6
            centroids = moved
    return members, centroids


def _sql(rounds: int) -> str:
    parts = ["""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64
 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INT) AS c, v FROM k QUALIFY c < 16)"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM k, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(k.v) AS x, unnest(range(64)) AS i FROM a{i} a JOIN k ON k.r = a.r) GROUP BY c, i) GROUP BY c),
 c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {", ".join(parts)}, h AS (SELECT c, sha256(array_to_string(v, ',')) AS h FROM c{rounds})
 SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} a JOIN k ON k.r = a.r JOIN h ON h.c = a.c"""


#: The same in SQL, of the table embeddings.
SQL = _sql(3)
