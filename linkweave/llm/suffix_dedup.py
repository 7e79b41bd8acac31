"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement, spread over tasks.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else. Suffixes are
compared to that depth only, and only where they can be equal:

1. Anchors. The start x of a string is assigned the position with the least hash of 24 bytes
   among the 256 from x on. This depends on the string alone, so equal strings have equal
   anchors at equal offsets; neighbouring starts mostly share theirs. A segment is an anchor
   with its run of starts (about 128); its *core* are the bytes all its strings share, its
   *content* those any of them covers.
2. Buckets. Segments are dealt by core. A core met once cannot be part of a repeat. Segments
   with equal content repeat as a whole, whatever else is in the bucket; copies collapse in the
   task that reads them. What is left are buckets with different contents: the borders of
   repeats, and near copies.
3. Refinement, on the bytes of those segments, one piece per distinct content. All positions
   get a bucket for the next 100 bytes (doubled up from 8 by bucket identifiers of later
   offsets); sorting on the pairs of identifiers at i and i + 100 gives the buckets of 200
   bytes; starts that are alone there are done, the others are sorted on the updated
   identifiers at i and i + 200, which decides 400 bytes.
   A bucket with more than ``HOT`` contents is dealt out by the strings themselves (128-bit
   hashes of every start) instead, so no task has to hold it.
4. Removed runs are merged per document; documents with none never leave the task that
   reads them but for their size and digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import groups_of, sized_broadcast, spread, utf8_length
from linkweave.session import cut_and_count, cut_lineage

LENGTH = 400
GRAM, WINDOW = 24, 256  # bytes of an anchor, positions it is chosen from
CORE = LENGTH - WINDOW + 1
HOT = 16_000
_BUFFER = 4 << 20
_RUN_BYTES = 4 << 20
_U64 = np.uint64

_SEGMENTS = pa.schema([
    ("core", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()),
    ("start", pa.int32()), ("starts", pa.int32()), ("state", pa.int8()),
])
_SEGMENTS_SQL = "core bigint, c1 bigint, c2 bigint, k1 bigint, k2 int, start int, starts int, state tinyint"
_ALONE, _COPIED, _DONE = 0, 1, 2  # no copy met; a copy met in the same batch; such a copy, itself settled
_WANTED_SQL = "core bigint, k1 bigint, k2 int, start int, starts int, done boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)).copy()


def _least_in_window(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by minima from both ends of blocks."""
    n = len(keys) - size + 1
    padded = np.full(-(-len(keys) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, size)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[size - 1:size - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of the segments of texts laid end to end."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty
    u = _eights(data)
    n = len(data) - GRAM + 1
    h = _mixed(u[:n] * _U64(0x9E3779B97F4A7C15) + _mixed(u[8:8 + n] * _U64(0xD1342543DE82EF95) + u[16:16 + n]))
    keys = (h & _U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    anchor = (_least_in_window(keys, WINDOW) & _U64(0xFFFFFFFF)).astype(np.int64)[:len(data) - LENGTH + 1]
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int32)
    long_enough = ends - begins >= LENGTH
    inside[begins[long_enough]] += 1
    inside[ends[long_enough] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside)[:len(anchor)] > 0)
    if not len(starts):
        return empty, empty, empty
    at = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(new[1:], len(starts)) - 1
    return at[new], starts[new], starts[last]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """Texts in runs of about ``_BUFFER`` bytes: bytes end to end, their ends, and the rows."""
    for batch in batches:
        column = batch.column("text")
        first, size, texts = 0, 0, []
        for i, value in enumerate(column):
            texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
            size += len(texts[-1])
            if size >= _BUFFER or i + 1 == len(column):
                joined = b"".join(texts)
                yield np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in texts]), joined, batch.slice(first, len(texts))
                first, size, texts = i + 1, 0, []


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data, ends, joined, rows in _buffers(batches):
        anchor, first, last = segments(data, ends)
        if not len(anchor):
            continue
        doc = np.searchsorted(ends, first, "right")
        begin = np.concatenate([[0], ends[:-1]])[doc]
        view = memoryview(joined)
        core = [xxhash.xxh3_64_intdigest(view[p:p + CORE]) for p in anchor.tolist()]
        # The offset of the anchor belongs to the content: equal bytes, equal place in them.
        content = [
            xxhash.xxh3_128_intdigest(view[a:b + LENGTH], p - a & 0xFFFF) for p, a, b in zip(anchor.tolist(), first.tolist(), last.tolist())
        ]
        seen: dict[int, int] = {}
        state = np.zeros(len(anchor), np.int8)
        for i, c in enumerate(content):
            j = seen.setdefault(c, i)
            if j != i:
                state[i], state[j] = _DONE, _COPIED
        core = np.array(core, np.uint64)
        k1 = rows.column("k1").to_numpy()[doc]
        done = state == _DONE
        core[done] = _mixed(k1[done].view(np.uint64) + first[done].astype(np.uint64))  # dealt anywhere
        yield pa.RecordBatch.from_arrays([
            pa.array(core.view(np.int64)), pa.array([c >> 65 for c in content], pa.int64()),
            pa.array([(c & (1 << 63) - 1) for c in content], pa.int64()),
            pa.array(k1), pa.array(rows.column("k2").to_numpy()[doc]),
            pa.array((first - begin).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(state),
        ], schema=_SEGMENTS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of (core, content): those that are done, and those to look into.

    Streams: a run of equal contents is complete when the next begins, and of a core it is
    enough to know whether another content came before. ``done`` rows are repeats as a whole.
    Others are wanted: one row per content of a core with several contents, where null
    ``done`` marks a content that is only there to be compared with.
    """
    names = _SEGMENTS.names
    carry: list[np.ndarray] | None = None  # rows of the last, still open run
    core, seen, held = None, 0, None  # its core, contents before it, and a first one that may be alone

    def chunk(columns: list[np.ndarray], closed: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carry, core, seen, held
        n = len(columns[0])
        new = np.ones(n, bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
        runs = np.flatnonzero(new)
        if not closed:
            carry = [c[runs[-1]:] for c in columns]
            columns, runs = [c[:runs[-1]] for c in columns], runs[:-1]
            n = len(columns[0])
        if n:
            length = np.diff(np.append(runs, n))
            state = columns[7]
            settled = (length > 1) | (np.maximum.reduceat(state, runs) > 0)
            whole = np.repeat(settled, length)
            ready = [c[whole] for c in columns]
            if len(ready[0]):
                yield _wanted_batch(ready, np.ones(len(ready[0]), bool), None)
            first = [c[runs] for c in columns]
            keep = first[7] != _DONE  # their cores are made up
            first, settled = [c[keep] for c in first], settled[keep]
            if held is not None:
                first = [np.concatenate([h, c]) for h, c in zip(held[0], first)]
                settled = np.concatenate([held[1], settled])
                held = None
            if len(first[0]):
                cores = first[0]
                edge = np.flatnonzero(np.concatenate([[True], cores[1:] != cores[:-1]]))
                count = np.diff(np.append(edge, len(cores)))
                total = count.copy()
                if cores[0] == core:
                    total[0] += seen
                several = np.repeat(total > 1, count)
                if total[-1] == 1:
                    held = ([c[-1:] for c in first], settled[-1:])
                core, seen = cores[-1], 0 if total[-1] == 1 else int(total[-1])
                if several.any():
                    yield _wanted_batch([c[several] for c in first], np.zeros(int(several.sum()), bool), settled[several])

    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            if carry is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(carry, columns)]
                carry = None
            yield from chunk(columns, False)
    if carry is not None:
        yield from chunk(carry, True)


def _wanted_batch(columns: list[np.ndarray], done: np.ndarray, only_compared: np.ndarray | None) -> pa.RecordBatch:
    core, _, _, k1, k2, start, starts, _ = columns
    mask = only_compared if only_compared is not None else np.zeros(len(done), bool)
    return pa.RecordBatch.from_arrays(
        [pa.array(core), pa.array(k1), pa.array(k2), pa.array(start), pa.array(starts), pa.array(done, mask=mask)],
        names=["core", "k1", "k2", "start", "starts", "done"],
    )


def refined_repeats(pieces: list[bytes]) -> list[np.ndarray]:
    """For every piece: which of its starts have a string of LENGTH bytes that starts elsewhere too."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    n = len(data)
    ids = np.zeros(n, np.uint64)
    eights = _eights(data)
    ids[:len(eights)] = eights
    depth = 8
    while depth < LENGTH // 4:  # identifiers of the next 8, 16, 32, 64 and 100 bytes
        step = min(depth, LENGTH // 4 - depth)
        ids[:n - step] = _mixed(ids[:n - step] * _U64(0x9E3779B97F4A7C15) + _mixed(ids[step:] + _U64(depth)))
        depth += step
    quarter, half = LENGTH // 4, LENGTH // 2
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes to the end of the piece
    at = np.flatnonzero(left >= half)
    pair = _mixed(ids[at] * _U64(0xD1342543DE82EF95) + _mixed(ids[at + quarter]))
    _, bucket, many = np.unique(pair, return_inverse=True, return_counts=True)
    updated = np.full(n, -1, np.int64)
    updated[at] = bucket
    starts = np.flatnonzero((left >= LENGTH) & (updated >= 0))
    starts = starts[many[updated[starts]] > 1]
    final = updated[starts] * np.int64(len(many)) + updated[starts + half]
    _, inverse, count = np.unique(final, return_inverse=True, return_counts=True)
    repeated = np.zeros(n, bool)
    repeated[starts[count[inverse] > 1]] = True
    return [repeated[b:b + max(0, s - LENGTH + 1)] for b, s in zip(begin, sizes)]


_SPANS_SQL = "k1 bigint, k2 int, start int, stop int"


def _span_batch(k1: list, k2: list, start: list, stop: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1, pa.int64()), pa.array(k2, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
        names=["k1", "k2", "start", "stop"],
    )


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings in pieces that are sorted by core."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        table = pa.concat_tables(held)
        out = ([], [], [], [])
        flags = refined_repeats(table["piece"].to_pylist())
        compared = table["done"].to_pylist()
        for i, (k1, k2, first) in enumerate(zip(*(table[c].to_pylist() for c in ("k1", "k2", "start")))):
            if compared[i] is not None:  # a null one is settled already
                for a, b in zip(*_runs(flags[i])):
                    for column, v in zip(out, (k1, k2, first + int(a), first + int(b) - 1 + LENGTH)):
                        column.append(v)
        return _span_batch(*out)

    for table in groups_of(batches, ["core"]):
        held.append(table)
        size += table["piece"].nbytes
        if size >= _RUN_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per start of the pieces of hot cores: hash of its string; copies in a batch collapse."""
    for batch in batches:
        rows = []
        for k1, k2, first, done, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "start", "done", "piece"))):
            view = memoryview(piece)
            for a in range(len(piece) - LENGTH + 1):
                h = xxhash.xxh3_128_intdigest(view[a:a + LENGTH])
                rows.append((h >> 65, h & (1 << 63) - 1, k1, k2, first + a, done is None))
        columns = zip(*rows) if rows else [[] for _ in range(6)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["h1", "h2", "k1", "k2", "start", "settled"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the wanted segments of every text."""
    for batch in batches:
        out: list[tuple] = []
        for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", "text", "wanted"))):
            data = text.as_buffer().to_pybytes()
            for w in wanted.as_py() or ():
                out.append((w["core"], k1.as_py(), k2.as_py(), w["start"], w["done"], data[w["start"]:w["start"] + w["starts"] - 1 + LENGTH]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        columns = zip(*out) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["core", "k1", "k2", "start", "done", "piece"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, digests, kept_texts = [], [], [], []
        for text, whole, more in zip(*(batch.column(c) for c in ("text", "whole", "spans"))):
            data = text.as_buffer().to_pybytes()
            spans = [(s["start"], s["start"] + s["starts"] - 1 + LENGTH) for s in whole.as_py() or ()]
            spans = merged(spans + [(s["start"], s["stop"]) for s in more.as_py() or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            removed.append(sum(b - a for a, b in spans)), runs.append(spans), digests.append(kept.hexdigest())
        pairs = pa.array([[{"start": a, "stop": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pairs, pa.array(digests, pa.string())],
            names=["k1", "k2", "n_removed", "runs", "kept_sha256"],
        )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs`` of every row.

    ``runs`` are the removed byte ranges. Texts are whole and in UTF-8; null is empty. Strings
    never cross texts. Rows with equal texts are copies of each other, repeated rows too.
    Texts shorter than LENGTH lose nothing. An empty table gives no rows; other columns
    are not read.
    """
    parts = spread(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "text")

    found = rows.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text").mapInArrow(_find_segments, _SEGMENTS_SQL)
    ordered = found.repartition(parts, "core").sortWithinPartitions("core", "c1", "c2")
    settled = cut_lineage(ordered.mapInArrow(_settle, _WANTED_SQL), "segments")

    wanted = ~F.coalesce("done", F.lit(False))
    hot = settled.where(wanted).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("core")
    hot, hot_cores = cut_and_count(hot, "hot")
    per_row = settled.groupBy("k1", "k2").agg(
        F.collect_list(F.when(wanted, F.struct("core", "start", "starts", "done"))).alias("wanted"),
        F.collect_list(F.when(~wanted, F.struct("start", "starts"))).alias("whole"),
    )
    touched = cut_lineage(rows.select("k1", "k2", "text").join(cut_lineage(per_row, "touched"), ["k1", "k2"]), "texts")

    pieces = touched.where(F.size("wanted") > 0).select("k1", "k2", "text", "wanted").mapInArrow(
        _cut, "core bigint, k1 bigint, k2 int, start int, done boolean, piece binary"
    )
    plain = pieces
    if hot_cores:
        pieces = cut_lineage(pieces, "pieces")
        named = sized_broadcast(hot, hot_cores, 16)
        plain = pieces.join(named, "core", "left_anti")
    spans = plain.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_refine, _SPANS_SQL)
    if hot_cores:
        strings = cut_lineage(pieces.join(named, "core").mapInArrow(_strings, "h1 bigint, h2 bigint, k1 bigint, k2 int, start int, settled boolean"), "strings")
        twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        more = strings.join(cut_lineage(twice, "twice"), ["h1", "h2"]).where("not settled")
        spans = spans.unionByName(more.select("k1", "k2", "start", (F.col("start") + LENGTH).alias("stop")))
    per_text = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    last = touched.select("k1", "k2", "text", "whole").join(cut_lineage(per_text, "spans"), ["k1", "k2"], "left")
    last = last.where((F.size("whole") > 0) | F.col("spans").isNotNull())
    shorter = last.mapInArrow(
        _removed, "k1 bigint, k2 int, n_removed bigint, runs array<struct<start:bigint,stop:bigint>>, kept_sha256 string"
    )
    # Repeated rows have one key and equal results.
    shorter = cut_lineage(shorter.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("n_removed", "runs", "kept_sha256")]), "shorter")
    all_rows = rows.select("doc_id", "k1", "k2", utf8_length("text").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return all_rows.join(shorter, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("runs", none).alias("runs"),
    )


# Strings of 400 bytes as hexadecimal text, cut out of blocks of 500 starts.
REPEATED_RUNS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (
  SELECT doc_id, j * 500 + i AS i, md5(substr(piece, 2 * i + 1, 800)) AS k
  FROM (SELECT doc_id, j, piece, unnest(range(0, least(500, n - 399 - j * 500))) AS i
    FROM (SELECT doc_id, n, j, substr(h, 1000 * j + 1, 1798) AS piece
      FROM (SELECT doc_id, h, n, unnest(range(0, (n - 400) // 500 + 1)) AS j FROM d WHERE n >= 400)))
), r AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
g AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)
), s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
  UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id
), t AS (
  SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id
), c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
