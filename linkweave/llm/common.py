"""What several operators share: reading, global row numbers, connected components, words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkweave.session import cut_and_count, cut_lineage

# Fixed values of the word rule: every ASCII byte but 0-9 and a-z parts words, A-Z are lower-cased.
WORD_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_WORDS = bytes.maketrans(
    WORD_SEPARATORS, bytes(b + 32 if 65 <= b <= 90 else 32 for b in WORD_SEPARATORS)
)
SEPARATOR_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of letters a-z (A-Z lowered), digits and non-ASCII; null has none."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def small_batches(spark: SparkSession) -> None:
    """Have whole texts handed to Python in batches of about ``BATCH_BYTES``.

    A batch is there several times at once, in the executor and in its Python worker, and neither gives
    the memory back; Spark's default is 64 MB. The setting stays, since plans run later. A smaller one is left alone.
    """
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(_BATCH_SETTING).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def utf8_length(text: str | Column) -> Column:
    """Bytes of a text in UTF-8, null as 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def unused(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """Each name, lengthened until no column of ``df`` has it (whatever its case)."""
    columns = df.columns if isinstance(df, DataFrame) else list(df)
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def spread(spark: SparkSession, least: int = 8) -> int:
    """Partitions for data that is dealt out by hand: those of Spark's own shuffles."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def global_row_numbers(
    df: DataFrame, order: Sequence[str | Column], number: str, label: str = "rows"
) -> tuple[DataFrame, int]:
    """Number all rows from 0 along ``order``; also the number of rows.

    No single task sees all rows: they are range-partitioned and sorted, each partition
    counts its own rows, and the offsets come from one row per partition. The sorted rows
    are written first, so a lost executor cannot deal them out anew.
    """
    place, slab, shift = unused([*df.columns, number], "place", "slab", "shift")
    spark = df.sparkSession
    rows, total = cut_and_count(
        df.repartitionByRange(spread(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id()),
        label,
    )
    rows = rows.withColumn(slab, F.shiftright(place, 33))
    counts = rows.groupBy(slab).agg(F.count(F.lit(1)).alias(shift))
    starts, so_far = [], 0
    for at, n in sorted(counts.collect()):  # one row per partition, however large the table
        starts.append((at, so_far))
        so_far += n
    offsets = spark.createDataFrame(starts or [(0, 0)], f"{slab} bigint, {shift} bigint")
    numbered = rows.join(offsets, slab).withColumn(
        number, F.col(shift) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    )
    return numbered.drop(place, slab, shift), total


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``most_bytes``; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def groups_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        start = 0
        for cut in np.flatnonzero(new):
            if cut > start:
                held.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(links: DataFrame, left: str, right: str, label: str = "links") -> DataFrame:
    """``id, component_id`` of every id in ``links``: the smallest id that links reach.

    Contraction: every id moves to the least of its closed neighbourhood, links are renamed
    and made distinct, until none is left. Rounds alternate between the order of the ids
    (a star around its smallest id ends in one round) and an order drawn anew (a path loses
    a constant share of its ids per round). Each round is a stored table; nothing but the
    number of remaining links comes to the driver. Null ids and self links are dropped.
    """
    ends = links.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v"))
    pairs, left_over = cut_and_count(
        ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        label,
    )
    labels = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    labels = cut_lineage(labels.withColumn("now", F.col("id")), label)
    step = 0
    while left_over:
        rank = (lambda c: F.col(c)) if step % 2 == 0 else (lambda c, s=step: F.xxhash64(F.lit(s), F.col(c)))
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
        nearest = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v"))).alias("n"))
        moves = cut_lineage(
            nearest.select("u", F.least(F.struct(rank("u").alias("r"), F.col("u").alias("v")), F.col("n"))["v"].alias("to")),
            label,
        )
        renamed = (
            pairs.join(moves, "u").select(F.col("to").alias("a"), "v")
            .join(moves.select(F.col("u").alias("v"), "to"), "v")
            .where("a <> to")
            .select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v"))
            .distinct()
        )
        pairs, left_over = cut_and_count(renamed, label)
        labels = cut_lineage(
            labels.join(moves.select(F.col("u").alias("now"), "to"), "now", "left")
            .select("id", F.coalesce("to", "now").alias("now")),
            label,
        )
        step += 1
    least = labels.groupBy("now").agg(F.min("id").alias("component_id"))
    return labels.join(least, "now").select("id", "component_id")


def feistel_keys(seed: int, rounds: int) -> list[tuple[int, int, int]]:
    """Multiplier, addend and offset below 2^31 - 1 for each round, from the seed alone."""
    import hashlib

    found = []
    for i in range(rounds):
        digest = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        a, b, c = (int.from_bytes(digest[k:k + 8], "big") % (2**31 - 2) + 1 for k in (0, 8, 16))
        found.append((a, b, c))
    return found


def half_bits(total: int) -> int:
    """Bits of half a number, so that numbers of twice that many bits hold 0 to total - 1."""
    return max(1, math.ceil(max(1, (max(total, 2) - 1).bit_length()) / 2))
