import math

import numpy as np

from linkweave.llm import embeddings
from linkweave.llm.embeddings import IntervalJoin, embedding_links
from tests.llm.samples import rows

NAMES = ("vec_id", "n_links", "component_id", "kept")


def brute(data):
    good = [k for k, (i, v) in enumerate(data) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = {k: np.array(data[k][1], np.float32).astype(float) for k in good}
    group, n = list(range(len(data))), [0] * len(data)
    for a in good:
        for b in good:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95:
                n[a], n[b] = n[a] + 1, n[b] + 1
                g, h = group[a], group[b]
                group = [min(g, h) if v in (g, h) else v for v in group]
    out = []
    for k, (i, _) in enumerate(data):
        c = min(data[j][0] for j in good if group[j] == group[k]) if k in x else i
        out.append((i, n[k], c, i is not None and i == c))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def vectors():
    rng = np.random.default_rng(5)
    data = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            data.append((len(data), (centre + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist()))
    data += [(900, data[3][1]), (901, data[3][1]), (901, data[3][1]), (902, [2 * v for v in data[4][1]]), (None, data[3][1])]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    data += [(1000 + k, v) for k, v in enumerate(bad)]
    return data + [(2000, [1.0, 0.0]), (2001, [1.0, 0.01]), (2002, [0.0, 1.0]), (2003, [5.0])]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in data], "vec_id bigint, embedding array<float>, label int, node int")


def test_against_all_pairs(spark):
    assert rows(embedding_links(frame(spark, vectors())), *NAMES) == brute(vectors())


def test_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "INTERVAL", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    assert rows(embedding_links(frame(spark, vectors())), *NAMES) == brute(vectors())


def test_empty_table_and_nothing_usable(spark):
    assert embedding_links(frame(spark, [])).collect() == []
    assert rows(embedding_links(frame(spark, [(1, None), (2, [])])), *NAMES) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_near_halves_are_counted_without_comparing():
    x = np.zeros((600, 3))
    x[:, 0], x[:, 1] = 1, np.linspace(0, 0.01, 600)
    x /= np.linalg.norm(x, axis=1)[:, None]
    work = IntervalJoin(x, np.ones(600, np.int64), 0.95)
    work._compare = None
    work.join(0, 600, 0, 600)
    at, links, root = work.rows()
    assert len(at) == 600 and (links == 599).all() and (root == 0).all()
