import hashlib
import math
import random

import numpy as np
import pytest

from linkweave.llm.centroids import OrchardSearch, centroid_clusters, clustering_report, largest_component
from tests.llm.samples import rows

NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
SCHEMA = "vec_id bigint, embedding array<double>, cluster string, v string, distance string, label int"


def table(spark, data):
    return spark.createDataFrame([(i, e, "x", "y", "z", 0) for i, e in data], SCHEMA)


def plainly(data, centroids=16, rounds=3, dimensions=64):
    """Python integers, all distances."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in data
            if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:centroids]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for k in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == k]
            if mine:
                at[k] = [sum(column) // len(mine) for column in zip(*mine)]
    best = assign()
    inertia = [sum(d for d, c in best if c == k) for k in range(len(at))]
    made = [(i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, at[c])))) for (i, _), (d, c) in zip(kept, best)]
    return sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def vectors(n=300, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    data = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(n)]
    data += [(n + k, data[5][1]) for k in range(40)] + [(7, data[8][1]), (7, data[8][1]), (None, data[3][1]), (None, data[4][1])]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] + [1.0] * 63, [float("-inf")] + [1.0] * 63, [None] + [1.0] * 63]
    return data + [(5000 + k, v) for k, v in enumerate(bad)] + [(6000, [0.0] * 64), (6001, [-0.0] * 64), (6002, [-1e-9] * 64)]


def test_as_with_all_distances(spark):
    data = vectors()
    assert rows(clustering_report(table(spark, data)), *NAMES) == plainly(data)


def test_partitions_change_nothing(spark):
    data = vectors(120, 3)
    first = rows(clustering_report(table(spark, data).repartition(1)), *NAMES)
    assert first == rows(clustering_report(table(spark, data[::-1]).repartition(7)), *NAMES)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    data = vectors()[:n] + vectors()[-10:-3]
    assert rows(clustering_report(table(spark, data)), *NAMES) == plainly(data)


def test_many_equal_vectors_leave_clusters_empty(spark):
    data = [(i, [1.0] * 64) for i in range(200)] + [(200 + i, [float(i)] * 64) for i in range(4)]
    found = rows(clustering_report(table(spark, data)), *NAMES)
    assert found == plainly(data)
    sizes = {r["cluster"]: r["size"] for r in centroid_clusters(table(spark, data)).centroids.collect()}
    assert len(sizes) == 16 and sum(sizes.values()) == len(data) and 0 in sizes.values()


def test_other_parameters(spark):
    data = [(i, [float((i * 37 + j * 11) % 19) for j in range(3)]) for i in range(80)]
    found = centroid_clusters(table(spark, data), centroids=5, rounds=2, dimensions=3)
    expected = [r[:3] for r in plainly(data, 5, 2, 3)]
    assert rows(found.assigned, "vec_id", "cluster", "distance") == expected and found.inertia == sum(r[2] for r in expected)


def test_component_too_large(spark):
    largest = float(largest_component(64))
    for value in (largest / 64, -1e300):
        with pytest.raises(Exception, match="would not fit 64 bits"):
            clustering_report(table(spark, [(1, [value] + [0.0] * 63)])).collect()
    data = [(1, [(largest - 1) / 64] * 64), (2, [-(largest - 1) / 64] * 64), (3, [0.0] * 64)]
    assert rows(clustering_report(table(spark, data)), *NAMES) == plainly(data)


@pytest.mark.parametrize("seed", range(8))
def test_search_is_exact_and_skips(seed):
    """Small integers make many ties; the search begins anywhere."""
    rng = np.random.default_rng(seed)
    wide, k = (2, 3, 50)[seed % 3], (1, 2, 16, 40)[seed % 4]
    centroids = rng.integers(-wide, wide + 1, (k, 4)).astype(np.int64)
    points = rng.integers(-wide, wide + 1, (500, 4)).astype(np.int64)
    distance = ((points[:, None] - centroids) ** 2).sum(axis=2)
    search = OrchardSearch(centroids)
    for begin in (None, rng.integers(0, k, len(points))):
        cluster, best, measured = search.nearest(points, begin)
        assert cluster.tolist() == distance.argmin(axis=1).tolist() and best.tolist() == distance.min(axis=1).tolist()
        assert measured <= distance.size and (k < 40 or measured < 0.9 * distance.size)
