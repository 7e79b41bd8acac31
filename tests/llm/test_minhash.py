import numpy as np

from linkweave.llm import minhash
from linkweave.llm.common import connected_components, words_of
from linkweave.llm.minhash import dart_signatures, near_duplicates, shingle_sets, without_near_duplicates
from tests.llm.samples import docs, prose, rows, texts


def brute(data):
    """class_id and number of rows per row, by comparing all pairs."""
    sets = []
    for _, text in data:
        w = words_of(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(data):
        members = [data[k][0] for k in range(len(data)) if group[k] == group[i]]
        ids = [m for m in members if m is not None]
        out.append((doc_id, (min(ids) if ids else None) if sets[i] else doc_id, len(members) if sets[i] else 1))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def family(copies, changes, start):
    base = prose(77, 120).split()
    out = []
    for k in range(copies):
        words = list(base)
        for c in range(changes):
            words[(k * 7 + c * 31) % len(words)] = f"edit{k}x{c}"
        out.append((start + k, " ".join(words)))
    return out


def test_rows_against_all_pairs(spark):
    assert rows(near_duplicates(docs(spark)), "doc_id", "class_id", "class_rows") == brute(texts())


def test_family_of_near_copies(spark, monkeypatch):
    data = family(25, 2, 100) + family(1, 0, 300) + [(400 + i, prose(500 + i, 80)) for i in range(10)]
    expected = brute(data)
    assert rows(near_duplicates(docs(spark, data)), "doc_id", "class_id", "class_rows") == expected
    monkeypatch.setattr(minhash, "CHUNK", 4)  # buckets in many tasks
    assert rows(near_duplicates(docs(spark, data)), "doc_id", "class_id", "class_rows") == expected


def test_one_row_of_each_group_stays(spark):
    given = docs(spark)
    kept = without_near_duplicates(given)
    assert kept.columns == given.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15] and ids.count(None) == 2


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).collect() == []
    assert without_near_duplicates(docs(spark, [])).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    owner = np.repeat([0, 1], 300)
    found = [
        (lambda s: (s[0] == s[1]).mean())(dart_signatures(owner, np.tile(element, 2), np.concatenate([x, y]).astype(float), 2, 256, seed))
        for seed in range(8)
    ]
    assert abs(np.mean(found) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_signature_depends_on_the_set_alone():
    owner, element, _ = shingle_sets(["a b c d e f g", "short", None, "a b c d e f g"], {})
    s = dart_signatures(owner, element, np.ones(len(owner)), 4)
    assert (s[0] == s[3]).all() and (s[2] == 0).all() and (s[0] != s[1]).all()


def test_components_of_stars_and_paths(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3), (200, 199)], "a bigint, b bigint")
    found = {r["id"]: r["component_id"] for r in connected_components(edges, "a", "b").collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100} and found[200] == 199


def test_pair_that_only_looks_shared_in_an_earlier_band(spark):
    data = []
    for seed in (340, 604):  # a band before the first shared one agrees in its bytes, not in its key
        changed = prose(seed, 120).split()
        changed[30], changed[80] = "changedone", "changedtwo"
        data += [(seed, prose(seed, 120)), (2000 + seed, " ".join(changed))]
    sets = shingle_sets([t for _, t in data], {})
    darts = dart_signatures(sets[0], sets[1], np.ones(len(sets[0])), 4)
    keys, short = minhash._band_keys(darts), (darts % np.uint64(251)).reshape(4, minhash.BANDS, minhash.ROWS)
    for x, y in ((0, 1), (2, 3)):
        assert (short[x] == short[y]).all(1).argmax() < (keys[x] == keys[y]).argmax()
    assert rows(near_duplicates(docs(spark, data)), "doc_id", "class_id", "class_rows") == brute(data)
