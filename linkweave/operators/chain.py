"""Hash chains: building, heads, and the checks on order and links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from linkweave.functions.text import DIGESTS, hash_matches, normalize, version_filename
from linkweave.operators.ordered import with_order
from linkweave.schemas import MAX_VERSION

_CHAIN_LINKS = "chain_id bigint, version int, body string, previous_hash string, hash string"
_CHAIN_HEADS = "chain_id bigint, links bigint, head_version int, head_hash string"


def build_chain(changes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Hash ``(chain_id, version, body)`` rows into complete change rows; ``carry`` names further columns to keep.

    Each hash needs the one before it, so one chain is sequential by definition and only
    chains run side by side. No chain is ever gathered: rows are shuffled once, sorted
    (spilling to disk if they must), and streamed past one running hash. Arrow hands the
    bodies over in batches and takes them back untouched.
    """
    kept = [f"{field.name} {field.dataType.simpleString()}" for field in changes.select(*carry).schema]
    return _in_chain_order(changes, carry).mapInArrow(_hash_links, ", ".join([_CHAIN_LINKS, *kept])).select(
        "chain_id",
        "version",
        version_filename("version").alias("filename"),
        "previous_hash",
        "hash",
        "body",
        *carry,
    )


def fold_heads(changes: DataFrame) -> DataFrame:
    """As ``chain_heads`` of the built chain, but only heads leave the Python workers."""
    return _in_chain_order(changes).mapInArrow(_hash_heads, _CHAIN_HEADS)


def _in_chain_order(changes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return (
        changes.select("chain_id", "version", normalize("body").alias("body"), *carry)
        .repartition("chain_id")
        .sortWithinPartitions("chain_id", "version")
    )


def _running_hashes(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[pa.RecordBatch, list[int], list[str | None], list[str]]]:
    chain, head = None, None
    for batch in batches:
        chains = batch.column("chain_id").to_pylist()
        previous, hashes = [], []
        for chain_id, body in zip(chains, batch.column("body").cast(pa.binary()).to_pylist()):
            if chain_id != chain:
                chain, head = chain_id, None
            previous.append(head)
            digest = hashlib.sha256(f"{head or ''}\n".encode())
            digest.update(body)
            head = digest.hexdigest()
            hashes.append(head)
        yield batch, chains, previous, hashes


def _hash_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, previous, hashes in _running_hashes(batches):
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(previous, pa.string()), pa.array(hashes, pa.string()), *batch.columns[3:]],
            names=["chain_id", "version", "body", "previous_hash", "hash", *batch.schema.names[3:]],
        )


def _hash_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head: tuple[int, int, int, str] | None = None
    for batch, chains, _, hashes in _running_hashes(batches):
        done = []
        for chain_id, version, link in zip(chains, batch.column("version").to_pylist(), hashes):
            if head is not None and head[0] != chain_id:
                done.append(head)
                head = None
            head = (chain_id, head[1] + 1 if head else 1, version, link)
        yield _heads(done)
    yield _heads([head] if head else [])


def _heads(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(columns, kinds)],
        names=["chain_id", "links", "head_version", "head_hash"],
    )


def chain_heads(changes: DataFrame) -> DataFrame:
    """Length, last version and last hash (lower case) of every chain; pre-aggregated before the shuffle."""
    return changes.groupBy("chain_id").agg(
        F.count("*").alias("links"),
        F.max("version").alias("head_version"),
        F.max_by(F.lower("hash"), "version").alias("head_hash"),
    )


def latest_change(changes: DataFrame) -> DataFrame:
    """The last change of every chain, body included.

    Spark turns this into a per-task top 1 before the shuffle, so a long chain sends one
    row per input task instead of all its bodies.
    """
    newest = Window.partitionBy("chain_id").orderBy(F.desc("version"), F.desc("hash"))
    return (
        changes.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    )


def next_versions(changes: DataFrame) -> DataFrame:
    """The version the next change of each chain would get; E37 when numbers run out."""
    full = F.col("links") >= MAX_VERSION
    return (
        changes.groupBy("chain_id")
        .agg(F.count("*").alias("links"))
        .select(
            "chain_id",
            F.when(~full, F.col("links") + 1).cast("int").alias("next_version"),
            F.when(full, "E37").alias("error_code"),
        )
    )


def verify_links(changes: DataFrame) -> DataFrame:
    """Add ``hash_ok``: row-local, so checking a chain needs no shuffle and no rebuild."""
    return changes.withColumn("hash_ok", hash_matches("previous_hash", "hash", "body"))


def positioned(changes: DataFrame, copies: str | None = None) -> DataFrame:
    """Changes in file-name order with their position and the hash of the one before; with ``copies``, equal rows are one."""
    return with_order(
        changes, ["chain_id"], ["filename", "hash"], ["hash"], weight=copies, digests=DIGESTS, copies=copies
    )


def not_contiguous(position: Column, version: Column) -> Column:
    return ~version.eqNullSafe(position.cast("int"))


def bad_genesis(position: Column, previous: Column) -> Column:
    return (position == 1) & previous.isNotNull()


def broken_link(position: Column, previous: Column, before: Column) -> Column:
    return (position > 1) & (previous.isNull() | ~previous.eqNullSafe(before))


def contiguity_violations(versions: DataFrame) -> DataFrame:
    """Versions of a chain that do not sit at their own rank.

    Takes ``(chain_id, version)``. Copies of one version are counted before the shuffle,
    so however many there are they travel as one row, which covers the ranks
    ``first_rank .. first_rank + n_rows - 1``.
    """
    counted = versions.groupBy("chain_id", "version").agg(F.count("*").alias("n_rows"))
    ranked = with_order(
        counted,
        ["chain_id"],
        ["version"],
        weight="n_rows",
        counted_from=versions,
    )
    on_rank = (F.col("version") >= F.col("position")) & (
        F.col("version") < F.col("position") + F.col("n_rows")
    )
    return ranked.select(
        "chain_id",
        "version",
        "n_rows",
        F.col("position").alias("first_rank"),
        (F.col("n_rows") - on_rank.cast("bigint")).alias("off_rank_rows"),
    ).where("off_rank_rows > 0")


def broken_links(changes: DataFrame) -> DataFrame:
    """Changes whose previous hash is not the hash of the change before them; hex case is ignored."""
    narrow = changes.select(
        "chain_id", "filename", F.lower("previous_hash").alias("previous_hash"), F.lower("hash").alias("hash")
    )
    return (
        positioned(narrow)
        .where(broken_link(F.col("position"), F.col("previous_hash"), F.col("before_hash")))
        .select(
            "chain_id", "filename", "position", "previous_hash",
            F.col("before_hash").alias("expected_previous"),
        )
    )


def genesis_violations(changes: DataFrame) -> DataFrame:
    """First changes that name a previous hash.

    Being first only takes the smallest file name of the chain, so no ranking is needed.
    """
    return (
        changes.groupBy("chain_id")
        .agg(F.min(F.struct("filename", "previous_hash")).alias("first"))
        .select("chain_id", "first.filename", "first.previous_hash")
        .where(F.col("previous_hash").isNotNull())
    )
