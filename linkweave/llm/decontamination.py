"""Benchmark decontamination: Wu-Manber search for all windows of benchmark words at once.

The symbols are words. Windows of one length m share two tables keyed by a block of B words:
``shift`` tells how far the end of the search window may move when it ends in that block (a
block no window holds moves it m - B + 1 words), and blocks that end a window (shift 0) lead
to a bucket of the windows with that suffix, which are compared word by word. Windows of
fewer words than the standard length come from short items and have tables of their length.

The tables are made of the distinct windows and broadcast. Their size is measured first: up
to ``TABLE_BYTES`` they go out in one piece, beyond that they are dealt out by hash into as
many pieces as it takes, each searched on its own, and the hits are merged per document. A
document is searched as a whole in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import SEPARATOR_CLASS, small_batches, unused, words_of
from linkweave.session import cut_lineage

WINDOW = 10
BLOCK = 3
TABLE_BYTES = 64 << 20
_WINDOW_OVERHEAD = 2000  # bytes of Python objects that a window costs beside its own
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "n_words bigint, ranges array<struct<start:bigint,end:bigint>>, items array<string>"


class WuManber:
    """Finds every occurrence of any of the given word sequences."""

    def __init__(self, windows: Iterable[tuple[bytes, ...]]):
        by_length: dict[int, set[tuple[bytes, ...]]] = {}
        for window in windows:
            by_length.setdefault(len(window), set()).add(window)
        self.tables = [self._table(length, group) for length, group in sorted(by_length.items())]

    @staticmethod
    def _table(length: int, windows: set[tuple[bytes, ...]]) -> tuple:
        block = min(BLOCK, length)
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, set[tuple[bytes, ...]]] = {}
        for window in windows:
            for end in range(block, length + 1):
                key = b" ".join(window[end - block:end])
                shift[key] = min(shift.get(key, length), length - end)
            buckets.setdefault(key, set()).add(window)
        return length, block, shift, buckets

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and window of every occurrence; by length, then from left to right."""
        n = len(words)
        for length, block, shift, buckets in self.tables:
            farthest = length - block + 1
            end = length
            while end <= n:
                key = b" ".join(words[end - block:end])
                step = shift.get(key, farthest)
                if step == 0:
                    window = tuple(words[end - length:end])
                    if window in buckets[key]:
                        yield end - length, window
                    step = 1
                end += step


def item_windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item: every run of ``size`` words; all its words if it has fewer."""
    words = words_of(text)
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window, items``: the distinct windows, each with the ids of its items as strings."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = {
                (b" ".join(w).decode(), item)
                for text, item in zip(frame["text"], frame["item"])
                for w in item_windows(text)
            }
            yield pd.DataFrame(list(pairs), columns=["window", "item"])

    rows = benchmark.select(F.col(text_col).alias("text"), F.col(item_col).cast("string").alias("item"))
    return (
        rows.mapInPandas(windows, "window string, item string")
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _search(rows: DataFrame, columns: list[str], text: str, hits: list[str], table: dict[str, list[str]], only_hits: bool) -> DataFrame:
    """Add ``hits`` (n_words, ranges, items) to the named columns; optionally only rows with hits."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {tuple(w.encode().split(b" ")): items for w, items in sent.value.items()}
        finder = WuManber(table)
        for batch in batches:
            counts, ranges, items = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                words = words_of(value.as_py())
                spans: list[tuple[int, int]] = []
                found: set[str] = set()
                for start, window in finder.find(words):
                    spans.append((start, start + len(window)))
                    found.update(table[window])
                counts.append(len(words))
                ranges.append([{"start": a, "end": b} for a, b in _merged(spans)])
                items.append(sorted(found))
            made = [pa.array(x, k) for x, k in zip((counts, ranges, items), (pa.int64(), _RANGES, pa.list_(pa.string())))]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            out = pa.RecordBatch.from_arrays([*kept, *made], names=[*columns, *hits])
            yield out.filter(pa.array([bool(r) for r in ranges])) if only_hits else out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns]
    kinds += [f"`{n}` {k.split(' ', 1)[1]}" for n, k in zip(hits, _HITS.split(", "))]
    return rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text])]).mapInArrow(search, ", ".join(kinds))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``doc_id, n_words, ranges, items`` of every row: merged word ranges that are hit, and whose.

    Words are runs of a-z (A-Z lowered), digits and non-ASCII characters. Null and empty
    texts have no words and no hits; items without words have no window; windows of an item
    without an id hit words but count for no item. Repeated rows each give a row. Only the
    named columns are read. Without a benchmark nothing is hit.
    """
    windows = cut_lineage(benchmark_windows(benchmark), "windows")
    cost = windows.agg(F.sum(F.octet_length("window") + 40 * F.size("items") + _WINDOW_OVERHEAD)).first()[0] or 0
    pieces = max(1, -(-int(cost) // table_bytes))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    hits = ["n_words", "ranges", "items"]

    def piece(number: int) -> dict[str, list[str]]:
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(pieces)) == number) if pieces > 1 else windows
        return {r["window"]: r["items"] for r in part.collect()}  # at most table_bytes, measured above

    if pieces == 1:
        return _search(rows, ["doc_id"], "text", hits, piece(0), only_hits=False)

    # Rows with equal id and text have equal hits, so these two (the text by two hashes) tell rows apart.
    keyed = rows.select("doc_id", F.concat_ws(":", F.xxhash64("text"), F.hash("text"), F.octet_length("text")).alias("row"), "text")
    found = None
    for number in range(pieces):
        part = _search(keyed.dropDuplicates(["doc_id", "row"]), ["doc_id", "row"], "text", hits, piece(number), only_hits=True)
        part = cut_lineage(part, "hits")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "row").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged([(s["start"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
            ranges = pa.array([[{"start": a, "end": b} for a, b in row] for row in spans], _RANGES)
            names = ["doc_id", "row", "items"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), ranges], names=[*names, "ranges"])

    merged = merged.mapInArrow(
        merge, "doc_id bigint, row string, items array<string>, ranges array<struct<start:bigint,end:bigint>>"
    ).alias("r")
    counted = _search(keyed, ["doc_id", "row"], "text", ["n_words", "none", "nothing"], {}, only_hits=False).alias("l")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row") == F.col("r.row"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return counted.join(merged, same, "left").select(
        "l.doc_id",
        "l.n_words",
        F.coalesce("r.ranges", empty).alias("ranges"),
        F.coalesce("r.items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: words, words hit, items found and a digest of their ids."""
    found = find_benchmark(docs, benchmark, **options)
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    windows = cut_lineage(benchmark_windows(benchmark), "windows")
    cost = windows.agg(F.sum(F.octet_length("window") + 40 * F.size("items") + _WINDOW_OVERHEAD)).first()[0] or 0
    pieces = max(1, -(-int(cost) // table_bytes))
    hits = unused(docs, "n_words", "ranges", "items")
    columns = docs.columns
    for number in range(pieces):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(pieces)) == number)
        table = {r["window"]: [] for r in part.select("window").collect()}  # at most table_bytes
        docs = _search(docs, columns, text_col, hits, table, only_hits=False).where(F.size(hits[1]) == 0)
        docs = docs.select(*[F.col(f"`{c}`") for c in columns])
        if number + 1 < pieces:
            docs = cut_lineage(docs, "clean")
    return docs


CONTAMINATION_SQL = f"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '{SEPARATOR_CLASS}') AS w FROM documents, abc
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '{SEPARATOR_CLASS}') AS w FROM benchmark, abc
), items AS (
  SELECT item_id, unnest([array_to_string(w[i:i + {WINDOW - 1}], ' ') FOR i IN range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)]) AS win,
    least(len(w), {WINDOW}) AS n
  FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.n, p.i, items.item_id FROM places p JOIN items ON items.win = p.win AND items.n = p.n
), per_doc AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
