import hashlib
from collections import Counter

import pytest

from linkweave.llm import suffix_dedup
from linkweave.llm.suffix_dedup import LENGTH, merged, refined_repeats, repeated_runs
from tests.llm.samples import docs, prose, rows, texts


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + LENGTH] for _, b in data for k in range(len(b) - LENGTH + 1))
    out = []
    for i, b in data:
        spans = merged([(k, k + LENGTH) for k in range(len(b) - LENGTH + 1) if count[b[k:k + LENGTH]] > 1])
        gone = {k for a, e in spans for k in range(a, e)}
        kept = bytes(v for k, v in enumerate(b) if k not in gone)
        out.append((i, len(b), len(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_against_brute_force(spark):
    assert rows(repeated_runs(docs(spark)), *NAMES) == brute(texts())


def tangled():
    a, b, c = prose(21, 400), prose(22, 400), prose(23, 400)
    made = [(1, a + b + c), (2, a[:1500] + c[200:900] + b[300:]), (3, c[:450] + "|" + a[100:501] + "|" + a[100:499])]
    made += [(10 + i, prose(100 + i, 8) + c[200:700] + prose(200 + i, 8)) for i in range(12)]
    return made + [(50, a[:LENGTH]), (51, a[:LENGTH - 1]), (52, "é" * 450), (53, "aé" * 300)]


def test_borders_and_near_copies(spark):
    assert rows(repeated_runs(docs(spark, tangled())), *NAMES) == brute(tangled())


def test_hot_cores_are_dealt_by_string(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    assert rows(repeated_runs(docs(spark, tangled())), *NAMES) == brute(tangled())


def test_empty_table(spark):
    assert repeated_runs(docs(spark, [])).collect() == []


def test_refinement_alone():
    a = prose(31, 200).encode()
    flags = refined_repeats([a[:450], b"x" + a[10:440], a[5:404]])
    assert [f.sum() for f in flags] == [31, 31, 0]


@pytest.mark.parametrize("size", [2, 7, 256])
def test_window_minimum(size):
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64)
    assert suffix_dedup._least_in_window(keys, size).tolist() == [keys[i:i + size].min() for i in range(1000 - size + 1)]
