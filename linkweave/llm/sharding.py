"""Sharding: a Feistel permutation of global row numbers gives each row its shard and slot.

Row numbers 0 to n - 1 (along id, then content) are permuted by a balanced Feistel network
over the next even power of two; numbers that fall outside walk on along their cycle until
they are back below n. The permuted number p lies in shard ``p mod shards`` at slot
``p div shards``, so shard sizes differ by one row at most, slots have no gaps, and anyone
who knows n and the seed can compute the place of a row, or the row at a place, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from linkweave.llm.common import feistel_keys, global_row_numbers, half_bits, utf8_length

SHARDS = 24
ROUNDS = 6
SEED = 20240229
_PRIME = 2**31 - 1  # fixed value: the field of the round function


def feistel(x: np.ndarray, total: int, seed: int = SEED, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 to total - 1 (below 2^62) at every ``x``, or its inverse."""
    if total <= 1:
        return x.copy()
    bits = half_bits(total)
    mask, prime = np.uint64((1 << bits) - 1), np.uint64(_PRIME)
    keys = [tuple(map(np.uint64, k)) for k in feistel_keys(seed, rounds)]

    def mix(r: np.ndarray, key: tuple) -> np.ndarray:
        t = (r % prime * key[0] + key[1]) % prime
        t = (t * t + key[2]) % prime
        return (t ^ (t >> np.uint64(13))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        high, low = v >> np.uint64(bits), v & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                high, low = low ^ mix(high, key), high
            else:
                high, low = low, high ^ mix(low, key)
        return high << np.uint64(bits) | low

    out = once(x.astype(np.uint64))
    outside = np.flatnonzero(out >= total)
    while outside.size:
        walked = once(out[outside])
        out[outside] = walked
        outside = outside[walked >= total]
    return out.astype(np.int64)


def with_permuted(df: DataFrame, number: str, total: int, name: str, seed: int = SEED) -> DataFrame:
    """Add the permuted row number, in Arrow batches; all other columns pass untouched."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(number)).to_numpy(zero_copy_only=False)
            moved = pa.array(feistel(x.astype(np.uint64), total, seed), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, moved], names=[*batch.schema.names, name])

    return df.mapInArrow(permute, StructType([*df.schema.fields, StructField(name, LongType())]))


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row of ``docs``; texts are read once and never shuffled.

    Rows are numbered along (id with nulls first, CRC-32, size, 64-bit hash of the text), so
    the result does not depend on how the table is split into files. Rows equal in all of
    these are interchangeable: each has a place of its own. A null or empty text has size 8
    and CRC 0 (they differ in nothing else); an empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_length(text_col) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    )
    order = ["doc_id", "text_crc32", "size", "text_hash"]
    numbered, total = global_row_numbers(narrow, order, "row_number", "shards")
    moved = with_permuted(numbered.drop("text_hash"), "row_number", total, "moved", seed)
    return moved.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("moved") % shards).cast("int").alias("shard"),
        F.floor(F.col("moved") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
