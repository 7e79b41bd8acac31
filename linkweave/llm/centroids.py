"""Centroid clustering of integer vectors with Orchard's search for the nearest centroid.

Every centroid has a list of the others, sorted by distance from it. A search stands at the best
centroid so far and goes through its list; whenever one is closer it jumps to that one's list.
Centroids it has met are marked and not measured again. It stops where the next one on the
list is strictly more than twice as far from the centroid as the vector is: by the triangle
inequality that one, and all after it, are strictly farther from the vector. So the result is exact, and of
equally near centroids the smallest number wins. All vectors of an Arrow batch search at
the same time, each at its own place in its own list.

Vectors are turned into integers once and stored; a round reads them, and each task sends
count and componentwise sums of its clusters, which Spark adds up. Only centroids (their
number times their dimension, both parameters) come to the driver. All arithmetic is on integers, so the
order of rows, partitions and tasks changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkweave.session import cut_lineage

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = "1"
# Components by which a search chooses where to begin.
GUESS = 4


@dataclass(frozen=True)
class Clustering:
    """``assigned``: vec_id, cluster, distance of every kept vector; ``centroids``: cluster, centroid, size, inertia."""

    assigned: DataFrame
    centroids: DataFrame
    inertia: int


class OrchardSearch:
    """Nearest of some integer centroids, for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        between = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        order = np.argsort(between, axis=1, kind="stable")
        self.lists = np.stack([row[row != i] for i, row in enumerate(order)]).reshape(k, k - 1)
        # Quarter of the squared distance, rounded up: more than a number means strictly more than twice as far.
        self.quarters = -(-np.take_along_axis(between, self.lists, axis=1) // 4)
        self.guess = np.sort(np.argsort(-(centroids - centroids.mean(axis=0)).__pow__(2).sum(axis=0), kind="stable")[:GUESS])

    def begin(self, vectors: np.ndarray) -> np.ndarray:
        """Nearest by a few components: only where the search begins, whatever it is the result is the same."""
        return ((vectors[:, None, self.guess] - self.centroids[None, :, self.guess]) ** 2).sum(axis=2).argmin(axis=1)

    def nearest(self, vectors: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid, squared distance to it, and how many distances were measured."""
        now = self.begin(vectors) if begin is None else begin.copy()
        best = ((vectors - self.centroids[now]) ** 2).sum(axis=1)
        met = np.zeros((len(vectors), len(self.centroids)), bool)
        met[np.arange(len(vectors)), now] = True
        place, measured = np.zeros(len(vectors), np.int64), len(vectors)
        going = np.arange(len(vectors) if self.lists.shape[1] else 0)
        while len(going):
            going = going[place[going] < self.lists.shape[1]]
            going = going[self.quarters[now[going], place[going]] <= best[going]]
            other = self.lists[now[going], place[going]]
            place[going] += 1
            new = ~met[going, other]
            some, other = going[new], other[new]
            met[some, other] = True
            distance = ((vectors[some] - self.centroids[other]) ** 2).sum(axis=1)
            measured += len(some)
            closer = (distance < best[some]) | ((distance == best[some]) & (other < now[some]))
            jump = some[closer]
            now[jump], best[jump], place[jump] = other[closer], distance[closer], 0
        return now, best, measured


def largest_component(dimensions: int) -> int:
    """Integers up to this have squared distances, and four times them, within 64 bits."""
    return math.isqrt((2**60 - 1) // (4 * dimensions))


def integer_vectors(df: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors with ``dimensions`` components, none null or non-finite, as integers floor(scale * x)."""
    raw = F.col(vector_col).cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = largest_component(dimensions)
    small = F.forall(raw, lambda x: F.abs(x * float(scale)) < float(most))
    message = f"a component is not below {most} after scaling: its distances would not fit 64 bits"
    integers = F.transform(raw, lambda x: F.floor(x * float(scale)).cast("int"))
    return df.where((F.size(raw) == dimensions) & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.when(small, integers).otherwise(F.raise_error(F.lit(message))).alias("v"),
    )


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(-1, dimensions).astype(np.int64)


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the componentwise floor of the mean of its vectors; where it was if it has none."""
    start = np.array(centroids, np.int64)
    dimensions = start.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, total = OrchardSearch(start), np.zeros(len(start), np.int64), np.zeros_like(start)
        for batch in batches:
            matrix = _matrix(batch, dimensions)
            cluster = search.nearest(matrix)[0]
            counts += np.bincount(cluster, minlength=len(start))
            np.add.at(total, cluster, matrix)
        held = np.flatnonzero(counts)
        flat = pa.array(total[held].ravel(), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dimensions, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64()), lists], ["cluster", "n", "total"])

    parts = vectors.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    added = (
        parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n"), F.sum(F.col("part").cast("decimal(28,0)")).alias("total"))
    )
    moved = [list(c) for c in centroids]
    for row in added.collect():  # centroids times dimensions rows at most
        moved[row["cluster"]][row["place"]] = int(row["total"]) // int(row["n"])
    return moved


def centroid_clusters(
    df: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering:
    """Clusters of all vectors with ``dimensions`` finite components; others are left out.

    Centroids begin at the vectors with the smallest hashes of seed and id (equal ids, null included: by components),
    move ``rounds`` times, and every vector is assigned to the nearest at last. With fewer vectors than ``centroids``
    each of them begins as one; repeated vectors count as often as they are there; no vectors give empty
    tables. A component too large for distances of 64 bits ends the job with a message. Other columns are not read.
    """
    if centroids < 1 or dimensions < 1:
        raise ValueError("at least one centroid and one dimension")
    spark = df.sparkSession
    vectors = cut_lineage(integer_vectors(df, dimensions, scale, id_col, vector_col), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(digest, "v").select("v").limit(centroids).collect()
    at = [list(row["v"]) for row in first]
    if not at:
        nothing = spark.createDataFrame([], "cluster int, centroid array<bigint>, size bigint, inertia bigint")
        return Clustering(vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), nothing, 0)
    for _ in range(rounds):
        at = _moved(vectors, at)
    last = np.array(at, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = OrchardSearch(last)
        for batch in batches:
            cluster, distance, _ = search.nearest(_matrix(batch, dimensions))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    assigned = cut_lineage(vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    totals = {
        row["cluster"]: (row["n"], int(row["total"]))
        for row in assigned.groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(28,0)")).alias("total"))
        .collect()  # one row per centroid at most
    }
    rows = [(i, c, *totals.get(i, (0, 0))) for i, c in enumerate(at)]
    table = spark.createDataFrame(rows, "cluster int, centroid array<bigint>, size bigint, inertia bigint")
    return Clustering(assigned, table, sum(total for _, total in totals.values()))


def clustering_report(df: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    found = centroid_clusters(df)
    written = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    digests = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(written, 256).alias("centroid_sha256"))
    # One row per centroid, whatever the number of vectors.
    return found.assigned.join(F.broadcast(digests), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(found.inertia).cast("bigint").alias("inertia"), "centroid_sha256"
    )


def clustering_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """All distances, in plain SQL: one assignment and one move per round, and the last assignment."""
    step = """
), a{r} AS (
  SELECT k.row, min(d.distance * {k} + c.cluster) AS code
  FROM kept k, c{r} c, LATERAL (
    SELECT sum((k.v[i] - c.v[i]) * (k.v[i] - c.v[i])) AS distance FROM range(1, {d} + 1) t(i)) d
  GROUP BY k.row
), m{r} AS (
  SELECT cluster, list(q ORDER BY i) AS v FROM (
    SELECT code % {k} AS cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
    FROM kept JOIN a{r} USING (row), range(1, {d} + 1) t(i) GROUP BY 1, 2) GROUP BY cluster
), c{n} AS (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster)"""
    steps = "".join(step.format(r=r, n=r + 1, k=centroids, d=dimensions) for r in range(rounds + 1))
    return f"""
WITH kept AS (
  SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS row, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM kept ORDER BY h, v LIMIT {centroids}{steps}
), last AS (
  SELECT k.vec_id, CAST(a.code % {centroids} AS INTEGER) AS cluster, CAST(a.code // {centroids} AS BIGINT) AS distance
  FROM kept k JOIN a{rounds} a USING (row)
)
SELECT vec_id, l.cluster, distance, CAST(sum(distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON c.cluster = l.cluster
"""
