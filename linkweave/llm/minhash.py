"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification.

1. Texts with equal word sequences are one class; only classes are compared.
2. A class has a DartMinHash signature of ``BANDS`` bands of ``ROWS`` coordinates. Classes that
   agree in a band share a bucket; buckets with one class are dropped on narrow rows.
3. In a bucket, signatures are compared (one byte a coordinate). A pair is looked at in the first
   band it shares only, by the full band keys that make the buckets, and is a candidate if its
   estimated similarity is at least ``ESTIMATE``.
   First every class proposes its most similar earlier partner; these pairs, at most one per
   class and bucket, are verified on the shingle sets. Then only candidates whose classes are
   not connected yet are verified, all of them, inside the bucket's task: no pair is emitted
   but the links that connect something.
4. Links make connected components. Buckets over ``CHUNK`` classes are dealt into chunks, and
   every two chunks are a task of their own, so a large bucket costs more tasks, never a larger
   one, and loses no candidate.

What is lost by chance: a pair of similarity 0.8 agrees in no band with probability
(1 - 0.8^5)^25 = 5e-5, and falls below ``ESTIMATE`` with about 3.5e-3; one of 0.85 with 4e-7
and 9e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import (
    SEPARATOR_CLASS, connected_components, groups_of, sized_broadcast, small_batches, spread, unused, words_of,
)
from linkweave.session import cut_and_count, cut_lineage

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
ESTIMATE = 0.7
CHUNK = 2048
SEED = 5
_LOW = 4  # ranks below 2^-_LOW are one cell
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of SplitMix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingle_sets(texts: list[str | None], known: dict[bytes, int], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle; texts of fewer words are one shingle."""
    rows, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        lengths[i] = len(words)
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            rows.append(h)
    h = np.array(rows, np.uint64)
    o = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = np.minimum(lengths, size)[o]  # words of a shingle
    starts = np.flatnonzero(place + used <= lengths[o])
    used, s = used[starts], np.zeros(len(starts), np.uint64)
    for k in range(size):
        live = used > k
        s[live] = _mixed(s[live] * _U64(0x9E3779B97F4A7C15) + h[starts[live] + k])
    h, o = s + used.astype(np.uint64), o[starts]
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    return o[first], h[first], np.diff(np.append(first, len(h)))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES, seed: int = SEED) -> np.ndarray:
    """DartMinHash: k coordinates for each of n weighted sets; the empty set has zeros.

    Every element has darts in the plane (weight, rank), drawn from its hash alone: cells are
    dyadic in both axes, and a cell holds a Poisson number of darts by its area. A dart counts
    for a set if its weight lies below the element's weight there; it belongs to one of the k
    coordinates, where the dart of the lowest rank wins. Two sets agree in a coordinate with
    the probability of their weighted Jaccard similarity. Ranks are looked at from below, only
    as far as it takes to fill all coordinates: about (k ln k + 2 k) / |set| first, then twice
    as far for the sets with an open coordinate.
    """
    total = np.bincount(owner, weights=weight, minlength=n)
    best_rank, best_dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    open_sets = total > 0
    limit = np.where(open_sets, (k * math.log(max(k, 2)) + 2 * k) / np.maximum(total, 1e-9), 0.0)
    low, cell = 0.0, -_LOW
    salt = _U64(seed * 0x5851F42D4C957F2D % 2**64)
    while open_sets.any():
        high = 2.0**cell
        active = np.flatnonzero(open_sets[owner])
        if len(active):
            heaviest = float(weight[active].max())
            floor, ceil, slab = 0.0, 1.0, 0
            while floor < heaviest:
                here = active[weight[active] > floor]
                base = _mixed(element[here] + salt + _U64(((cell + 64) * 4096 + slab) * 0x9E3779B97F4A7C15 % 2**64))
                area = (high - low) * (ceil - floor)
                u, p = _uniform(base), math.exp(-area)
                reached, number = p, 0
                left = np.flatnonzero(u > reached)
                while len(left):
                    number += 1
                    at = here[left]
                    dart = _mixed(base[left] + _U64(number * 0xD1342543DE82EF95 % 2**64))
                    rank = low + (high - low) * _uniform(_mixed(dart + _U64(1)))
                    height = floor + (ceil - floor) * _uniform(_mixed(dart + _U64(2)))
                    counts = height < weight[at]
                    place = owner[at] * k + (_mixed(dart + _U64(3)) % _U64(k)).astype(np.int64)
                    _keep_lowest(best_rank, best_dart, place[counts], rank[counts], dart[counts])
                    p *= area / number
                    reached += p
                    left = left[u[left] > reached]
                    if number > 64 + 8 * area:
                        break
                floor, ceil, slab = ceil, ceil * 2, slab + 1
        low, cell = high, cell + 1
        done = open_sets & (limit <= high)
        if done.any():
            rows = np.flatnonzero(done)
            filled = np.isfinite(best_rank.reshape(n, k)[rows]).all(1)
            open_sets[rows[filled]] = False
            limit[rows[~filled]] *= 2
    return best_dart.reshape(n, k)


def _keep_lowest(best_rank: np.ndarray, best_dart: np.ndarray, place: np.ndarray, rank: np.ndarray, dart: np.ndarray) -> None:
    order = np.lexsort((dart, rank, place))
    place, rank, dart = place[order], rank[order], dart[order]
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    place, rank, dart = place[first], rank[first], dart[first]
    lower = rank < best_rank[place]
    best_rank[place[lower]], best_dart[place[lower]] = rank[lower], dart[lower]


# From documents to classes


_READ = pa.schema([
    ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("class_key", pa.binary()),
    ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
])
_READ_SQL = "doc_id bigint, k1 bigint, k2 int, class_key binary, size bigint, bands array<bigint>, signature binary"


def row_keys(id_col: str, text_col: str) -> list:
    """96 bits that tell rows of different id or text apart."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.hash(text_col, id_col).alias("k2")]


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _signed(batches: Iterator[pa.RecordBatch], weights: str) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        seen: set[bytes] = set()
        texts = batch.column("text").to_pylist()
        for a, b in _slices(texts):
            if len(known) > 200_000:
                known.clear()
            keys, new = [], []
            for i in range(a, b):
                words = words_of(texts[i])
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
                keys.append(key)
                if key is not None and key not in seen:
                    seen.add(key)
                    new.append(i)
            owner, element, count = shingle_sets([texts[i] for i in new], known)
            weight = count if weights == "count" else np.ones(len(count))
            darts = dart_signatures(owner, element, weight, len(new))
            sizes = np.bincount(owner, minlength=len(new))
            short = (darts % _U64(251)).astype(np.uint8)
            folded = _band_keys(darts)
            at = {i: j for j, i in enumerate(new)}
            rows = [at.get(i) for i in range(a, b)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([
                *[part.column(c) for c in ("doc_id", "k1", "k2")],
                pa.array(keys, pa.binary()),
                pa.array([None if j is None else int(sizes[j]) for j in rows], pa.int64()),
                pa.array([None if j is None else folded[j] for j in rows], pa.list_(pa.int64())),
                pa.array([None if j is None else short[j].tobytes() for j in rows], pa.binary()),
            ], schema=_READ)


def _band_keys(darts: np.ndarray) -> np.ndarray:
    """One 64-bit number per band: of its coordinates and its place."""
    grid = darts.reshape(len(darts), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2])
    for r in range(ROWS):
        key = _mixed(key * _U64(0x9E3779B97F4A7C15) + grid[:, :, r])
    return key.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets as sorted 4-byte hashes; a chance collision changes a set by one part in its size."""
    known: dict[bytes, int] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in _slices(texts):
            owner, element, _ = shingle_sets(texts[a:b], known)
            cuts = np.searchsorted(owner, np.arange(b - a + 1))
            short = (element >> _U64(32)).astype(np.uint32)
            made = [np.unique(short[x:y]).tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(made, pa.binary())], names=["node", "shingles"])
            if len(known) > 200_000:
                known.clear()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(x) + len(y) - common)


# In a bucket


class _Tile:
    """The classes of one bucket, or of two chunks of one, and which of their pairs it answers for."""

    def __init__(self, table: pa.Table):
        self.node = table["node"].to_numpy()
        order = np.argsort(self.node, kind="stable")
        self.order, self.node = order, self.node[order]
        self.size = table["size"].to_numpy()[order]
        self.chunk = table["chunk"].to_numpy()[order]
        width = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8)
        self.signature = width.reshape(len(order), COORDINATES)[order]
        self.band = int(table["band"][0].as_py())
        earlier = pa.concat_arrays(table["earlier"].chunks).flatten().to_numpy()
        self.earlier = earlier.reshape(len(order), self.band)[order]
        self.across = bool((self.chunk != self.chunk[0]).any()) or bool(table["across"][0].as_py())

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every class: the earlier ones it may be similar to, and the estimates."""
        for i in range(1, len(self.node)):
            equal = self.signature[:i] == self.signature[i]
            estimate = equal.mean(1)
            ok = estimate >= ESTIMATE
            ok &= np.minimum(self.size[:i], self.size[i]) >= SIMILAR * np.maximum(self.size[:i], self.size[i]) - 1e-9
            if self.across:
                ok &= self.chunk[:i] != self.chunk[i]
            at = np.flatnonzero(ok)
            if len(at) and self.band:
                at = at[~(self.earlier[at] == self.earlier[i]).any(1)]
            if len(at):
                yield i, at, estimate[at]


def _best_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups_of(batches, ["bucket", "tile"]):
        tile = _Tile(table)
        found = [(tile.node[i], tile.node[at[estimate.argmax()]]) for i, at, estimate in tile.candidates()]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a candidate in another component, for each bucket task."""
    for table in groups_of(batches, ["bucket", "tile"]):
        component = table["component"].to_numpy()
        if (component == component[0]).all():
            continue
        tile = _Tile(table)
        component, marked = component[tile.order], np.zeros(len(tile.node), bool)
        for i, at, _ in tile.candidates():
            other = at[component[at] != component[i]]
            if len(other):
                marked[i] = True
                marked[other] = True
        kept = np.flatnonzero(marked)
        if len(kept):
            yield table.take(pa.array(tile.order[kept])).combine_chunks().to_batches()[0].select(
                ["bucket", "band", "tile", "across", "chunk", "node", "component"]
            )


def _connecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between components; once two are connected, they are one."""
    for table in groups_of(batches, ["bucket", "tile"]):
        tile = _Tile(table)
        component = table["component"].to_numpy()[tile.order]
        shingles = table["shingles"].combine_chunks().take(pa.array(tile.order)).to_pylist()
        parent = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        for i, at, estimate in tile.candidates():
            for j in at[np.argsort(-estimate, kind="stable")]:
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y and jaccard(shingles[i], shingles[j]) >= SIMILAR:
                    parent[max(x, y)] = min(x, y)
                    found.append((tile.node[i], tile.node[j]))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [jaccard(x, y) >= SIMILAR for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _dealt(members: DataFrame, partitions: int) -> DataFrame:
    """One run of rows per bucket and pair of chunks."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return (
        members.withColumn("chunks", chunks)
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(others))
        .withColumn("tile", (low * F.col("chunks") + high).cast("bigint"))
        .withColumn("across", low != high)
        .drop("n", "chunks", "other")
        .repartition(partitions, "bucket", "tile")
        .sortWithinPartitions("bucket", "tile")
    )


def _with_signatures(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a tile compares; ``earlier`` has the keys of the bands before the member's own."""
    signed = members.join(wanted.select("node", "size", "signature", "bands"), "node")
    return signed.withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands")


def near_duplicate_rows(docs: DataFrame, weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, k1, k2, class_key`` of ``docs``, and per ``class_key`` the group it is in:
    ``group_id`` (smallest id) with ``g1, g2`` (row key of the row that stays) and ``group_rows``."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = spread(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", *row_keys("doc_id", "text"), "text")
    read = cut_lineage(keyed.mapInArrow(lambda b: _signed(b, weights), _READ_SQL), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    classes = cut_lineage(
        read.where(F.col("class_key").isNotNull())
        .groupBy("class_key")
        .agg(
            F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"),
            F.any_value("bands", True).alias("bands"), F.any_value("signature", True).alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(banded.join(shared, "bucket").select("bucket", "band", "n", "node"), "buckets")
    wanted = members.select("node").distinct().join(classes.select("node", "size", "signature", "bands", "first.*"), "node")
    wanted, many = cut_and_count(wanted, "wanted")
    told = sized_broadcast(wanted.select("node", "k1", "k2"), many, 60)
    texts = rows.select("text", *row_keys("doc_id", "text")).join(told, ["k1", "k2"]).select("node", "text")
    sets = cut_lineage(texts.mapInArrow(_sets, "node bigint, shingles binary").dropDuplicates(["node"]), "shingles")

    signed = _with_signatures(members, wanted)
    pairs = _dealt(signed, parts).mapInArrow(_best_partners, "a bigint, b bigint").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b"
    )
    links = cut_lineage(both.mapInArrow(_verified, "a bigint, b bigint"), "links")

    so_far = cut_lineage(connected_components(links, "a", "b"), "components")
    named = signed.join(so_far.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component_id", "node")).drop("component_id")
    left, open_rows = cut_and_count(
        _dealt(named, parts).mapInArrow(
            _undecided, "bucket bigint, band int, tile bigint, across boolean, chunk int, node bigint, component bigint"
        ),
        "undecided",
    )
    if open_rows:
        full = _with_signatures(left, wanted).join(sets, "node")
        dealt = full.repartition(parts, "bucket", "tile").sortWithinPartitions("bucket", "tile")
        more = cut_lineage(dealt.mapInArrow(_connecting, "a bigint, b bigint"), "links")
        so_far = cut_lineage(connected_components(links.unionByName(more), "a", "b"), "components")

    grouped = classes.select("class_key", "node", "first", "copies").join(so_far.withColumnRenamed("id", "node"), "node", "left")
    grouped = cut_lineage(grouped.withColumn("group", F.coalesce("component_id", "node")).drop("component_id"), "groups")
    heads = grouped.groupBy("group").agg(F.min("first").alias("head"), F.sum("copies").alias("group_rows"))
    groups = grouped.join(heads, "group").select(
        "class_key", F.col("head.doc_id").alias("group_id"), F.col("head.k1").alias("g1"), F.col("head.k2").alias("g2"), "group_rows"
    )
    return read.select("doc_id", "k1", "k2", "class_key"), cut_lineage(groups, "groups")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, class_rows, kept`` of every row: its group of near-duplicates.

    Rows are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8
    or more (``weights="count"`` makes candidates by counts of shingles instead); groups are
    connected components. A text of fewer than five words has one shingle, all its words.
    ``class_id`` is the smallest doc_id of the group; rows without an id come last. Texts
    without words (null, empty, signs only) link with nothing. Repeated rows are copies of
    each other; all rows that equal the first of a group in id and text are ``kept``. An
    empty table gives no rows.
    """
    rows, groups = near_duplicate_rows(docs, **options)
    alone = F.col("g1").isNull()
    return rows.join(groups, "class_key", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("class_id"),
        F.coalesce("group_rows", F.lit(1)).alias("class_rows"),
        (alone | ((F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per group, with all its columns; rows without words all stay.

    Rows to drop are found on narrow keys and joined back. Where the row that stays is there
    more than once, one of its copies is taken.
    """
    rows, groups = near_duplicate_rows(docs, id_col=id_col, text_col=text_col, **options)
    joined = rows.join(groups, "class_key")
    stays = (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    changed, many = cut_and_count(
        joined.groupBy("k1", "k2").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"),
        "changed",
    )
    repeated = changed.where("stays").limit(1).count()  # whether there are any
    k1, k2, stays_name = unused(docs, "k1", "k2", "stays")
    named = sized_broadcast(changed.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("stays").alias(stays_name)), many, 60)
    keys = row_keys(id_col, text_col)
    marked = docs.withColumns({k1: keys[0], k2: keys[1]}).join(named, [k1, k2], "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.where(F.col(stays_name).isNull()).select(*columns)
    if not repeated:
        return kept
    return kept.unionByName(marked.where(F.col(stays_name)).dropDuplicates([k1, k2]).select(*columns))


NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATOR_CLASS}') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, 1) + 1)]) AS shingle
  FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= {SIMILAR} * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT x, y FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), least AS (SELECT doc_id, min(other) AS other, count(DISTINCT other) AS members FROM reach GROUP BY doc_id)
SELECT w.doc_id, least(w.doc_id, coalesce(other, w.doc_id)) AS class_id, coalesce(members, 1)::BIGINT AS class_rows,
  coalesce(other >= w.doc_id, true) AS kept
FROM w LEFT JOIN least USING (doc_id)
"""
