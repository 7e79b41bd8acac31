import random

import pytest
from pyspark.sql import Window, functions as F

from linkweave.operators.chain import contiguity_violations
from linkweave.operators.ordered import block_cuts, in_blocks, with_order
from linkweave.operators.snapshots import change_points, snapshot_equality, stamp_diff


@pytest.mark.parametrize("hot_rows", [0, 3, 60, 10_000])
@pytest.mark.parametrize("seed", [1, 7])
def test_blocks_give_what_a_plain_window_gives(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(5), i, rng.choice(["a", "b", None])) for i in rng.sample(range(900), 300)]
    df = spark.createDataFrame(rows, "k long, n int, s string")
    ours = with_order(df, ["k"], ["n"], carry=["s"], hot_rows=hot_rows)
    w = Window.partitionBy("k").orderBy("n")
    plain = df.select(
        "*", F.row_number().over(w).cast("bigint").alias("position"), F.lag("s").over(w).alias("before_s")
    )
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_weights_count_as_rows(spark, hot_rows):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 9, 2)], "k long, n int, c long")
    placed = with_order(df, ["k"], ["n"], weight="c", hot_rows=hot_rows)
    assert {r.n: r.position for r in placed.collect()} == {1: 1, 2: 4, 9: 5}


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_contiguity_with_copies_and_gaps(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(with_order, "__defaults__", (*with_order.__defaults__[:-1], hot_rows))
    versions = [(1, 1), (1, 2), (1, 3), (2, 2), (3, 1), (3, 1), (3, 3), (4, 1), (4, 3)]
    got = contiguity_violations(spark.createDataFrame(versions, "chain_id long, version int"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (2, 2, 1, 1, 1), (3, 1, 2, 1, 1), (4, 3, 1, 2, 1),
    ]


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_change_points_fire_once_per_state(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(with_order, "__defaults__", (*with_order.__defaults__[:-1], hot_rows))
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None), (2, 2, None), (2, 3, "c")]
    df = spark.createDataFrame(rows, "k long, n int, s string")
    got = change_points(df, ["k"], ["n"], "s")
    assert sorted((r.k, r.n, r.previous_state) for r in got.collect()) == [
        (1, 1, None), (1, 3, "a"), (1, 4, "b"), (2, 1, None), (2, 3, None),
    ]


def test_stamps(spark):
    kind = "snapshot_id long, path string, modified_ms long, size long"
    one = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 1), (1, "c", 1, 1), (1, "d", 1, 1)], kind)
    two = spark.createDataFrame([(2, "a", 1, 1), (2, "b", 2, 1), (2, "c", 1, 2), (2, "e", 1, 1)], kind)
    assert {r.path: r.change for r in stamp_diff(one, two).collect()} == {
        "a": "same", "b": "modified", "c": "modified", "d": "removed", "e": "added",
    }
    assert tuple(snapshot_equality(one, two).first()) == (6, False)
    assert tuple(snapshot_equality(one, one).first()) == (0, True)
    assert tuple(snapshot_equality(one.limit(0), one.limit(0)).first()) == (0, True)


def test_hot_key_is_spread_over_tasks(spark):
    """A key with a third of the rows is cut; no task gets much more than its share."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("n")
    )
    placed = with_order(rows, ["k"], ["n"], carry=["n"], hot_rows=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("position"))
        sizes = [r["n"] for r in per_task.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 9_500
    hot = placed.where("k = 0")
    assert hot.where("position <> n / 3 + 1 or not before_n <=> if(n = 0, null, n - 3)").isEmpty()
    assert hot.count() == 10_000


def test_hot_hour_is_spread_over_tasks(spark):
    """Half of all rows are one key in one hour, with names of one prefix: cuts follow the rows."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id")).alias("ts"),
        F.format_string("000001-%07d.sql", F.col("id")).alias("name"),
        (F.col("id") % 7).alias("s"),
    )
    for order in (["ts"], ["name"], ["ts", "name"]):
        size = F.lit(1).cast("bigint")
        cuts = block_cuts(rows, ["k"], order, size, hot_rows=1000)
        blocks = [r["count"] for r in in_blocks(rows, cuts, ["k"], order).where("k = 0").groupBy("_block").count().collect()]
        assert sum(blocks) == 20_000 and len(blocks) > 50 and max(blocks) < 1_000
        assert in_blocks(rows, cuts, ["k"], order).where("k <> 0 and _block is not null").isEmpty()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            placed = with_order(rows, ["k"], order, carry=["s"], hot_rows=1000)
            tasks = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("position")).collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(tasks) == 4 and max(tasks) < 12_500
        number = F.unix_millis("ts") - F.lit(1_700_000_000_000)
        hot = placed.where("k = 0").withColumn("number", number)
        assert hot.where("position <> number / 2 + 1 or not before_s <=> if(number = 0, null, (number - 2) % 7)").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 100])
def test_blocks_count_the_cuts_up_to_a_place(spark, n):
    cuts = spark.createDataFrame([(1, [(10 * i,) for i in range(n)])], "k long, _cuts array<struct<n:long>>")
    rows = spark.createDataFrame([(1, v) for v in range(-5, 10 * n + 5)] + [(1, None), (2, 3)], "k long, n long")
    for r in in_blocks(rows, cuts, ["k"], ["n"]).collect():
        expected = None if r.k == 2 else 0 if r.n is None else sum(10 * i <= r.n for i in range(n))
        assert r["_block"] == expected, r


def test_without_hot_keys_there_is_one_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("n"))
    plan = with_order(rows, ["k"], ["n"], carry=["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("hot_rows", [0, 3, 10_000])
@pytest.mark.parametrize("weight", [None, "n"])
def test_copies_are_one_row(spark, hot_rows, weight):
    """Equal rows, null keys and hashes included, become one with their number, whether keys are hot or not."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, None]), f"{rng.randrange(9)}", rng.choice(["a" * 64, "F" * 64, "x", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k long, f string, h string")
    ours = with_order(df, ["k"], ["f", "h"], ["h"], weight, digests=["h"], copies="n", hot_rows=hot_rows)
    counted = df.groupBy("k", "f", "h").agg(F.count("*").alias("n"))
    theirs = with_order(counted, ["k"], ["f", "h"], ["h"], weight, digests=["h"])
    assert ours.columns == theirs.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))
