import re
from collections import defaultdict

from linkweave.llm.mixing import mix_report, mixed_copies
from tests.llm.samples import docs, prose, rows


def targets(sizes):
    """Shares by weight 5, 2, 1, never over three times the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - 3 * sum(sizes[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_sizes_and_targets(spark):
    given = docs(spark).select("doc_id", "text", "source")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in given.collect():
        sizes[r["source"]] += size(r["text"])
    aim = targets(sizes)
    found = rows(mix_report(docs(spark)), "doc_id", "size", "source_size", "target", "taken")
    expected = rows(given, "doc_id", "text", "source")
    assert sorted(r[1] for r in found) == sorted(size(r[1]) for r in expected)
    assert {round(r[3], 6) for r in found} == {round(v, 6) for v in aim.values()}
    assert all(r[4] % r[1] == 0 and r[4] <= 3 * r[1] for r in found if r[1]) and all(r[4] == 0 for r in found if not r[1])


def many(spark):
    data = [(i, prose(i, 5 + i % 60)) for i in range(600)]
    given = docs(spark, data)
    from pyspark.sql import functions as F

    return given.withColumn("source", F.expr("case when doc_id < 400 then 'hot' when doc_id < 402 then 'tiny' when doc_id < 500 then null else 'z' end"))


def test_taken_words_come_near_the_target(spark):
    given = many(spark)
    taken, target, largest = defaultdict(int), {}, 0
    source = {r["doc_id"]: r["source"] for r in given.select("doc_id", "source").collect()}
    first = rows(mix_report(given), "doc_id", "size", "target", "taken")
    for doc_id, size, t, n in first:
        taken[source[doc_id]] += n
        target[source[doc_id]] = t
        largest = max(largest, size)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1e-6 for s in target)
    assert first == rows(mix_report(given.repartition(7)), "doc_id", "size", "target", "taken")


def test_copies_are_the_mix(spark):
    given = many(spark)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_report(given).collect()}
    copies = defaultdict(int)
    made = mixed_copies(given)
    assert made.columns == given.columns
    for r in made.select("doc_id").collect():
        copies[r["doc_id"]] += 1
    assert {i: n for i, n in taken.items() if n} == dict(copies)


def test_empty_and_wordless_tables(spark):
    assert mix_report(docs(spark, [])).collect() == [] and mixed_copies(docs(spark, [])).collect() == []
    assert rows(mix_report(docs(spark, [(1, None), (2, " ")])), "size", "target", "taken") == [(0, 0.0, 0), (0, 0.0, 0)]


def test_rows_without_id_are_not_one_block(spark):
    """Targets are met by single rows where no row has an id; copies of one text go together."""
    given = docs(spark, [(None, prose(i, 20 + i % 30)) for i in range(300)] + [(None, prose(1000, 10))] * 200)
    from pyspark.sql import functions as F

    given = given.withColumn("source", F.when(F.pmod(F.xxhash64("text"), F.lit(3)) == 0, "a").otherwise("b"))
    found = mix_report(given).collect()
    for size in {r["source_size"] for r in found}:
        rows_of = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in rows_of) - rows_of[0]["target"]) <= 200 * 10
        assert len({r["taken"] // r["size"] for r in rows_of}) == 2
    assert len({r["taken"] for r in found if r["size"] == 10}) == 1
