import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from linkweave.llm.common import global_row_numbers
from linkweave.llm.sharding import ROUNDS, SEED, assign_shards, feistel
from tests.llm.samples import docs, rows, texts

NAMES = ("doc_id", "size", "text_crc32", "shard", "slot")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n, dtype=np.uint64)
    y = feistel(x, n)
    assert sorted(y.tolist()) == list(range(n))
    assert feistel(y.astype(np.uint64), n, inverse=True).tolist() == list(range(n))
    assert n < 100 or np.abs(y - np.arange(n)).mean() > n / 6


def test_large_numbers_walk_back():
    n = 10**15 + 7
    x = np.array([0, 1, n - 1, 12345678901234], np.uint64)
    assert feistel(feistel(x, n).astype(np.uint64), n, inverse=True).tolist() == x.astype(np.int64).tolist()


def test_shards_and_slots(spark):
    given = docs(spark)
    found = rows(assign_shards(given, shards=5), *NAMES)
    assert sorted(map(str, (r[:3] for r in found))) == sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in texts())
    counts = Counter(r[3] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s in range(5):
        assert sorted(r[4] for r in found if r[3] == s) == list(range(counts[s]))
    assert found == rows(assign_shards(given.repartition(3), shards=5), *NAMES)
    # the place can be computed from the row number alone
    for r in assign_shards(given, shards=5).collect():
        p = int(feistel(np.array([r["row_number"]], np.uint64), len(texts()))[0])
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (p % 5, p // 5, "rows", None)


def test_empty_table(spark):
    assert assign_shards(docs(spark, [])).collect() == []


def test_row_numbers(spark):
    numbered, total = global_row_numbers(spark.range(1000).selectExpr("id % 7 as place", "id"), ["place", "id"], "slab")
    found = sorted((r["slab"], r["place"], r["id"]) for r in numbered.collect())
    assert total == 1000 and [f[0] for f in found] == list(range(1000)) and [f[1:] for f in found] == sorted(f[1:] for f in found)


def plain_place(number, total, seed, rounds):
    """The permuted number by Python integers, from the description of the network alone."""
    bits = 1
    while 4**bits < total:
        bits += 1
    keys = []
    for i in range(rounds):
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        keys.append([int.from_bytes(digest[k:k + 8], "big") % (2**31 - 2) + 1 for k in (0, 8, 16)])
    while True:
        high, low = divmod(number, 2**bits)
        for a, b, c in keys:
            t = (low * a + b) % (2**31 - 1)
            t = (t * t + c) % (2**31 - 1)
            high, low = low, high ^ ((t ^ (t >> 13)) % 2**bits)
        number = high * 2**bits + low
        if number < total:
            return number


@pytest.mark.parametrize("total", [2, 3, 5, 17, 64, 65, 1000])
def test_permutation_by_plain_integers(total):
    got = feistel(np.arange(total, dtype=np.uint64), total).tolist()
    assert got == [plain_place(i, total, SEED, ROUNDS) for i in range(total)]


def test_places_by_a_plain_sort(spark):
    """Rows sorted in Python along id (null first), CRC-32 and size; where those are equal, places are a set."""
    data = texts() + [(i % 40, f"text {i % 30}") for i in range(200)]
    key = lambda i, t: (i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
    expected = {}
    for number, (i, t) in enumerate(sorted(data, key=lambda r: key(*r))):
        place = plain_place(number, len(data), SEED, ROUNDS)
        expected.setdefault(key(i, t), []).append((place % 7, place // 7))
    found = {}
    for r in assign_shards(docs(spark, data), shards=7).collect():
        at = (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
        found.setdefault(at, []).append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
