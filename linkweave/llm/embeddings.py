"""Embedding near-dedup: epsilon grid order join.

Unit vectors have cosine >= 0.95 when they are at most eps = sqrt(2 - 2 * 0.95) apart. Vectors are
turned into the principal axes of all data (a rotation, distances stay), sorted by the cells
of an eps grid on the leading axes, and cut into intervals of this sequence. Interval pairs
whose bounding boxes are more than eps apart are skipped; every other pair is a task, which
halves the longer interval again and again, skips halves that are provably too far apart,
counts halves that are provably near without comparing them, and compares the small rest.

A task returns one row per vector with links (how many) and edges that connect what it found
linked, never the pairs. Exact copies are one vector with a multiplicity throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import connected_components, spread
from linkweave.session import cut_and_count, cut_lineage

SIMILAR = 0.95
AXES = 4  # leading axes of the grid order
INTERVAL = 4096  # vectors of a sequence interval
LEAF = 512
_SURE = 1e-4  # single precision may differ by this much, and less than a tenth of it does


def epsilon(similar: float = SIMILAR) -> float:
    return math.sqrt(2 - 2 * similar)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), dim)


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (columns, by falling variance) of all unit vectors.

    Tasks add up their own moments; these are summed per entry by Spark, and dim * (dim + 3) / 2
    numbers at most come to the driver.
    """
    upper = np.triu_indices(dim)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for batch in batches:
            x = _unit(_matrix(batch.column(0), dim))
            first, second, n = first + x.sum(0), second + x.T @ x, n + len(x)
        if n:
            values = np.concatenate([[n], first, second[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    sums = vectors.select("embedding").mapInArrow(moments, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.array([r["value"] for r in sorted(sums.collect(), key=lambda r: r["at"])])
    mean = values[1:dim + 1] / values[0]
    second = np.zeros((dim, dim))
    second[upper] = values[dim + 1:] / values[0]
    second = second + second.T - np.diag(np.diag(second))
    _, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1])


class IntervalJoin:
    """Joins two intervals, or one with itself, by recursive halving."""

    def __init__(self, points: np.ndarray, times: np.ndarray, similar: float):
        self.x, self.x32, self.times, self.similar = points, points.astype(np.float32), times, similar
        self.eps = epsilon(similar)
        self.links = np.zeros(len(points), np.int64)
        self.parent = np.arange(len(points))
        self.bounds: dict[tuple[int, int], tuple] = {}

    def _bound(self, a: int, b: int) -> tuple:
        found = self.bounds.get((a, b))
        if found is None:
            part = self.x[a:b]
            centre = part.mean(0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(1)).max())
            found = self.bounds[a, b] = (part.min(0), part.max(0), centre, radius)
        return found

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Rows a to b with rows c to d; either the same range or disjoint."""
        low, high, centre, radius = self._bound(a, b)
        if (a, b) == (c, d):
            if 2 * radius < self.eps - 1e-6:
                self._all(a, b, a, b)
            elif b - a <= LEAF:
                self._compare(a, b, c, d)
            else:
                m = (a + b) // 2
                self.join(a, m, a, m), self.join(a, m, m, b), self.join(m, b, m, b)
            return
        low2, high2, centre2, radius2 = self._bound(c, d)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        apart = math.sqrt(float(((centre - centre2) ** 2).sum()))
        if (gap * gap).sum() > (self.eps + 1e-6) ** 2 or apart - radius - radius2 > self.eps + 1e-6:
            return
        if apart + radius + radius2 < self.eps - 1e-6:
            self._all(a, b, c, d)
        elif max(b - a, d - c) <= LEAF:
            self._compare(a, b, c, d)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d), self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m), self.join(a, b, m, d)

    def _all(self, a: int, b: int, c: int, d: int) -> None:
        if (a, b) == (c, d):
            self.links[a:b] += self.times[a:b].sum() - self.times[a:b]
            self._unite(np.full(b - a, a), np.arange(a, b))
        else:
            self.links[a:b] += self.times[c:d].sum()
            self.links[c:d] += self.times[a:b].sum()
            self._unite(np.full(d - c, a), np.arange(c, d))
            self._unite(np.full(b - a, c), np.arange(a, b))

    def _compare(self, a: int, b: int, c: int, d: int) -> None:
        near = self.x32[a:b] @ self.x32[c:d].T
        i, j = np.nonzero(near >= self.similar - _SURE)
        if not len(i):
            return
        close = np.flatnonzero(near[i, j] < self.similar + _SURE)
        if len(close):
            exact = (self.x[a + i[close]] * self.x[c + j[close]]).sum(1) >= self.similar
            keep = np.ones(len(i), bool)
            keep[close] = exact
            i, j = i[keep], j[keep]
        i, j = i + a, j + c
        if (a, b) == (c, d):
            keep = i < j
            i, j = i[keep], j[keep]
        np.add.at(self.links, i, self.times[j])
        np.add.at(self.links, j, self.times[i])
        self._unite(i, j)

    def _roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            self.parent[at] = self.parent[up]
            at = self.parent[up]

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self._roots(i), self._roots(j)
            open_ = x != y
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.links)
        return at, self.links[at], self._roots(at)


def _intervals(nodes: DataFrame, dim: int, similar: float) -> DataFrame:
    """``interval, low, high, nodes, times, vectors``: runs of the grid order with their boxes."""
    mean, axes = principal_axes(nodes, dim)
    axes_used = min(AXES, dim)
    eps = epsilon(similar)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = (_unit(_matrix(batch.column("embedding"), dim)) - mean) @ axes[:, :axes_used]
            cells = np.floor(turned / eps).astype(np.int32)
            fine = turned[:, 0]
            columns = [pa.array(cells[:, k]) for k in range(axes_used)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(fine)], names=[*batch.schema.names, *names, "fine"])

    names = [f"cell{k}" for k in range(axes_used)]
    schema = "node bigint, times bigint, embedding array<float>, " + ", ".join(f"{n} int" for n in names) + ", fine double"
    cells = cut_lineage(nodes.select("node", "times", "embedding").mapInArrow(ordered, schema), "cells")
    order = [*names, "fine", "node"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= 2 * INTERVAL:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, INTERVAL))
                held, rows = table.slice(INTERVAL).to_batches(), rows - INTERVAL
        if rows:
            table = pa.Table.from_batches(held)
            cuts = np.linspace(0, rows, -(-rows // INTERVAL) + 1).astype(int)
            for a, b in zip(cuts, cuts[1:]):
                yield packed(table.slice(a, b - a))

    def packed(table: pa.Table) -> pa.RecordBatch:
        raw = _matrix(table["embedding"], dim)
        turned = (_unit(raw) - mean) @ axes
        one = lambda x: [x]
        return pa.RecordBatch.from_arrays([
            pa.array(one(turned.min(0).tolist())), pa.array(one(turned.max(0).tolist())),
            pa.array(one(table["node"].to_numpy().astype(np.int64).tobytes()), pa.binary()),
            pa.array(one(table["times"].to_numpy().astype(np.int64).tobytes()), pa.binary()),
            pa.array(one(raw.tobytes()), pa.binary()),
        ], names=["low", "high", "nodes", "times", "vectors"])

    rows = cells.count()
    parts = max(1, min(spread(nodes.sparkSession), -(-rows // INTERVAL)))
    sequence = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "times", "embedding")
    made = sequence.mapInArrow(pack, "low array<double>, high array<double>, nodes binary, times binary, vectors binary")
    return cut_lineage(made.withColumn("interval", F.monotonically_increasing_id()), "intervals")


def _interval_pairs(intervals: DataFrame, similar: float) -> DataFrame:
    """``a, b`` with a <= b: intervals whose boxes come within eps, met in a cell of the first two axes."""
    eps = epsilon(similar)
    cell = lambda c, k: F.floor(F.element_at(c, k) / eps).cast("bigint")
    last = lambda k: F.least(F.size("low"), F.lit(k))
    box = intervals.select("interval", "low", "high")
    for name, extra in (("here", 0), ("there", 1)):
        for axis in (1, 2):
            box = box.withColumn(f"{name}{axis}", F.sequence(cell(F.col("low"), last(axis)) - extra, cell(F.col("high"), last(axis)) + extra))
    one = box.select(F.col("interval").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode("here1").alias("c1"), "here2")
    one = one.withColumn("c2", F.explode("here2")).drop("here2")
    two = box.select(F.col("interval").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode("there1").alias("c1"), "there2")
    two = two.withColumn("c2", F.explode("there2")).drop("there2")
    gaps = F.zip_with(
        F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"),
        lambda x, y: F.greatest(F.lit(0.0), x["low_a"] - y["high_b"], y["low_b"] - x["high_a"]),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    near = one.join(two, ["c1", "c2"]).where("a <= b").select("a", "b", apart.alias("apart"))
    return near.where(F.col("apart") <= (eps + 1e-6) ** 2).select("a", "b").distinct()


def _linked(nodes: DataFrame, dim: int, similar: float) -> DataFrame:
    """``node, links, root`` per vector and task that found links of it."""
    intervals = _intervals(nodes, dim, similar)
    pairs = cut_lineage(_interval_pairs(intervals, similar), "pairs")
    ends = F.explode(F.array_distinct(F.array("a", "b"))).alias("interval")
    sides = pairs.select("a", "b", ends).join(intervals.select("interval", "nodes", "times", "vectors"), "interval")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("interval")
        ids = [np.frombuffer(x, np.int64) for x in table["nodes"].to_pylist()]
        raw = [np.frombuffer(x, np.float32).reshape(-1, dim) for x in table["vectors"].to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.int64) for x in table["times"].to_pylist()])
        work = IntervalJoin(_unit(np.concatenate(raw)), times, similar)
        n = len(ids[0])
        work.join(0, n, 0, n) if len(ids) == 1 else work.join(0, n, n, n + len(ids[1]))
        node = np.concatenate(ids)
        at, links, root = work.rows()
        return pa.table({"node": node[at], "links": links, "root": node[root]})

    return sides.groupBy("a", "b").applyInArrow(join, "node bigint, links bigint, root bigint")


def embedding_links(vectors: DataFrame, similar: float = SIMILAR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor
    do rows without an id or vectors of different length; each is a component of its own.
    Rows with equal vectors are different vectors and link with each other, repeated rows
    too. ``kept`` holds where the id is the component's smallest (false without an id). An
    empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("embedding", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding")))
    good = rows.where("embedding is not null")
    nodes = cut_lineage(
        good.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("times"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    found = None
    for dim in sorted(r["dim"] for r in nodes.select(F.size("embedding").alias("dim")).distinct().collect()):
        part = cut_lineage(_linked(nodes.where(F.size("embedding") == dim), dim, similar), "linked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.lit(0).cast("bigint")
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found, "node", "root").withColumnRenamed("id", "node").withColumnRenamed("component_id", "group")
    named = nodes.join(links, "node", "left").join(components, "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = cut_lineage(named.select("embedding", "group", "least_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "named")
    least = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    named, many = cut_and_count(named.join(least, "group").select("embedding", "n_links", "component_id"), "named")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(named, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


EMBEDDING_LINKS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {SIMILAR}
), reach(vec_id, other) AS (
  SELECT x, y FROM links UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
  coalesce(other >= e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""
