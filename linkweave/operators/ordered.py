"""Positions and predecessors inside a key, without one task for a hot key.

A plain window over a key sorts all rows of that key in a single task, so one key with a
third of all rows would decide how long the job takes. Keys are therefore counted first, on the
key columns alone. If none is hot the plain window is all there is. Else a prefix scan runs:

* cut points along the order are drawn from the rows of each hot key, a few per ``hot_rows`` rows,
  so they follow the data however it is named or spread over time;
* the window runs in each block between two cuts, so the blocks of a key go to many tasks;
* what crosses a border - how many rows came before, and the last row before - is one small
  row per block, added up along the blocks and joined back.

Any cut points give the right result, the sample only makes the blocks even. The cuts are stored,
so all readers of a plan, and reruns after a lost executor, see the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkweave.functions.text import packed, unpacked
from linkweave.session import cut_and_count

# Keys with more rows than this are cut into blocks.
HOT_ROWS = 500_000
# Blocks per so many rows: several, so that hashing deals a key's blocks out evenly.
BLOCKS = 4
# Rows drawn per block; the spread of block sizes falls with its square root.
DRAWN = 8
# Cut points are broadcast up to this size; there are (rows of hot keys / hot_rows * BLOCKS) of them.
BROADCAST_BYTES = 64 << 20
_CUT_BYTES = 128


def with_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str] = (),
    weight: str | None = None,
    counted_from: DataFrame | None = None,
    at_most: int | None = None,
    digests: Sequence[str] = (),
    copies: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``position`` (1-based) and, for each ``carry`` column, ``before_<column>``.

    ``before_*`` is null on the first row of a key. With ``weight``, a row stands for that many
    rows and ``position`` is the first place it takes; ``counted_from`` may then name the rows it
    was counted from, which saves counting twice. Keys are counted right away, unless the number
    of all rows is known to be ``at_most`` one that no key can be hot with. ``digests`` are columns that
    are shuffled as bytes; the window sees their texts. With ``copies``, equal rows become one, and that column, which
    ``weight`` may name, says how many they were. They are counted where the window is, after the one shuffle that it needs;
    only if a key is hot they are counted before it.
    """
    columns = [*df.columns, *([copies] if copies else [])]
    keys, order = list(keys), list(order)
    size = F.col(weight) if weight else F.lit(1).cast("bigint")
    single = F.lit(1).cast("bigint")
    rows, row_size = (df, size) if counted_from is None else (counted_from, single)
    known_small = at_most is not None and at_most <= hot_rows
    cuts = None if known_small else block_cuts(rows, keys, order, single if copies else row_size, hot_rows)

    if copies:
        if weight == copies:
            rows, row_size = df, single
        moved = packed(df, digests) if cuts is not None else packed(df, digests).repartition(*keys)
        counted = moved.groupBy(*df.columns).agg(F.count("*").alias(copies))
        df = unpacked(counted, digests).select(*columns)
        if weight != copies:
            rows, row_size = df, size
    place = [*keys] if cuts is None else [*keys, "_block"]
    blocked = df if cuts is None else in_blocks(df, cuts, keys, order)
    if digests and not (copies and cuts is None):
        blocked = unpacked(packed(blocked, digests).repartition(*place), digests)
    in_block = Window.partitionBy(*place).orderBy(*order)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.struct(F.lit(True).alias("_here"), *[F.col(c) for c in carry])
    local = blocked.select(
        *columns,
        *place[len(keys):],
        F.sum(size).over(so_far).alias("_upto"),
        *([F.lag(carried).over(in_block).alias("_before")] if carry else []),
    )
    position, before = F.col("_upto") - size + 1, F.col("_before")
    if cuts is not None:
        local = local.join(_borders(rows, row_size, cuts, keys, order, carry), place, "left")
        position = position + F.coalesce(F.col("_offset"), F.lit(0))
        before = F.coalesce(before, F.col("_border")) if carry else before
    return local.select(
        *[F.col(c) for c in columns],
        position.cast("bigint").alias("position"),
        *[before[c].alias(f"before_{c}") for c in carry],
    )


def block_cuts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Hot keys with their ``_cuts``, sorted places along the order; None if no key is hot."""
    hot = rows.groupBy(*keys).agg(F.sum(size).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot, n = cut_and_count(hot.select(*keys), "hot-keys")
    if not n:
        return None
    drawn = rows.join(broadcast_if_small(hot, n), [*keys]).where(F.rand(11) * hot_rows < DRAWN * BLOCKS)
    sample = F.array_sort(F.collect_set(F.struct(*order)))
    cuts = F.filter(sample, lambda _, i: i % DRAWN == DRAWN - 1)
    return cut_and_count(drawn.groupBy(*keys).agg(cuts.alias("_cuts")).where(F.size("_cuts") > 0), "cuts")[0]


def in_blocks(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_block``: the number of cuts at or before a row's place, null for keys without cuts."""
    bits = F.ceil(F.log2(F.size("_cuts") + F.lit(1.0))).cast("int")
    steps = cuts.select(*keys, "_cuts", F.sequence(F.lit(1), bits).alias("_steps"))
    joined = rows.join(broadcast_if_small(steps, _total_cuts(cuts)), [*keys], "left")
    block = F.when(F.col("_cuts").isNotNull(), _bisect(F.col("_cuts"), F.col("_steps"), F.struct(*order)))
    return joined.select(*rows.columns, block.alias("_block"))


def _bisect(cuts: Column, steps: Column, place: Column) -> Column:
    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        up = F.get(cuts, middle) <= place
        narrowed = F.struct(
            F.when(up, middle + 1).otherwise(at["low"]).alias("low"), F.when(up, at["high"]).otherwise(middle).alias("high")
        )
        return F.when(at["low"] < at["high"], narrowed).otherwise(at)

    whole = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(steps, whole, halve, lambda at: at["low"])


def _borders(
    rows: DataFrame, size: Column, cuts: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Per block of a hot key, ``_offset`` rows before it and the ``_border`` row before it.

    Aggregated before its shuffle: one row per block and task leaves, not the bulk again.
    """
    ends = [F.sum(size).alias("_size")]
    if carry:
        carried = F.struct(F.lit(True).alias("_here"), *[F.col(c) for c in carry])
        ends.append(F.max_by(carried, F.struct(*order)).alias("_last"))
    per_key = Window.partitionBy(*keys).orderBy("_block")
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    return (
        in_blocks(rows, cuts, keys, order)
        .where(F.col("_block").isNotNull())
        .groupBy(*keys, "_block")
        .agg(*ends)
        .select(
            *keys,
            "_block",
            F.sum("_size").over(earlier).alias("_offset"),
            *([F.lag("_last").over(per_key).alias("_border")] if carry else []),
        )
        .where(F.col("_offset").isNotNull())
    )


def _total_cuts(cuts: DataFrame) -> int:
    return cuts.agg(F.coalesce(F.sum(F.size("_cuts")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, entries: int) -> DataFrame:
    """A broadcast hint where the counted entries are small enough, else as it is, for AQE to decide."""
    return F.broadcast(df) if entries * _CUT_BYTES <= BROADCAST_BYTES else df
