"""Byte-level BPE: texts to token ids and back, in padded numpy matrices.

1. A text is split by the pattern of the vocabulary; every match is encoded on its own. A worker
   keeps the ids of the pre-tokens it met last, so a pre-token is encoded once per worker and
   not once per occurrence.
2. New pre-tokens are sorted into buckets by their number of bytes and become rows of a padded
   matrix of ids. In each round every row merges its leftmost pair of minimum rank. A row
   gives up one cell a round, so the matrix is compacted to one column less; rows without a
   pair that merges leave it.
3. Which rank two neighbouring ids merge to is looked up in an open-addressing hash table of
   all pairs whose bytes together are in the vocabulary. After a merge only the two pairs
   beside it are looked up again.
4. Pre-tokens of more than ``WIDE`` bytes are first cut between bytes that stand side by side in
   no vocabulary entry, where no merge can ever cross. A part that is still long is merged as
   a row of its own, which in a round also merges the further occurrences of its minimum pair
   if that provably gives the same ids; so a long run of one character takes a few rounds.

Everything is local to a row: no shuffle, nothing through the driver. Text is taken in slices of
a bounded number of bytes (a single longer text is a slice).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

VOCABULARY = "byte_bpe_50k.tiktoken"
# Bytes of text taken at once, cells of a matrix, and pre-tokens a worker remembers.
SLICE_BYTES = 4 << 20
CELLS = 1 << 20
REMEMBERED = 1 << 18
# Longest row, in bytes, of a padded matrix.
WIDE = 64
NO_MERGE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
# Stand-ins of the four character classes that the splitting patterns know.
_CLASSES = {"letter": "ª", "number": "²", "space": " ", "other": "§"}
_CLASS_OF = [("letter", regex.compile(r"\p{L}")), ("number", regex.compile(r"\p{N}")), ("space", regex.compile(r"\s"))]


class PairTable:
    """Rank of two neighbouring ids, by hashing with linear probing; all look-ups are vectorized."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, (4 * len(rank) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.ranks = np.full(1 << bits, NO_MERGE, np.int32)
        keys = _pair_keys(left, right)
        rank, at = rank.astype(np.int32), self._home(keys)
        while len(keys):
            free = self.keys[at] == _EMPTY
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slots >= 0]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], rank[first]
            left_over = np.ones(len(keys), bool)
            left_over[first] = False
            keys, rank, at = keys[left_over], rank[left_over], (at[left_over] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NO_MERGE`` where there is none or an id is padding (negative)."""
        keys = _pair_keys(left, right)
        at = self._home(keys)
        found = self.ranks[at]
        off = np.flatnonzero(self.keys[at] != keys)
        found[off] = NO_MERGE
        off = off[self.keys[at[off]] != _EMPTY]
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            there = self.keys[at[off]]
            hit = there == keys[off]
            found[off[hit]] = self.ranks[at[off[hit]]]
            off = off[~hit & (there != _EMPTY)]
        found[(left < 0) | (right < 0)] = NO_MERGE
        return found


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)


class Vocabulary:
    """Ranks of byte strings with all that encoding and decoding need of them."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a, b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        columns = np.array(pairs or [(0, 0, NO_MERGE)], np.int64).T
        self.pairs = PairTable(*columns)
        self.beside = np.zeros((256, 256), bool)
        for token in ranks:
            cells = np.frombuffer(token, np.uint8)
            self.beside[cells[:-1], cells[1:]] = True
        top = max(ranks.values()) + 1
        lengths = np.zeros(top, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)


@functools.cache
def load_vocabulary(path: str) -> Vocabulary:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _probe():
    """An encoding in which a character's first byte joins the character before it, if one match holds both."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for before in b"A1!":
        ranks.update({bytes([before, b]): len(ranks) + b for b in range(256)})
    return tiktoken.Encoding("classes", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})


@functools.cache
def stand_in(character: str) -> str | None:
    """A character of the class that the encoding library gives ``character``, None if ours is the same.

    The libraries follow different versions of Unicode, so letters of the newest are none in the other.
    """
    ours = next((name for name, test in _CLASS_OF if test.match(character)), "other")
    size = len(character.encode())
    joins = (name for name, before in (("letter", "A"), ("number", "1"), ("other", "!")) if len(_probe().encode_ordinary(before + character)) == size)
    theirs = next(joins, "space")
    return None if ours == theirs else _CLASSES[theirs]


def split_text(text: str, pattern: regex.Pattern) -> list[str]:
    """Matches of the splitting pattern, characters in the classes of the encoding library."""
    if text.isascii():
        return pattern.findall(text)
    moved = {c: s for c in set(text) if c > "ɏ" and (s := stand_in(c)) is not None}
    if not moved:
        return pattern.findall(text)
    return [text[m.start():m.end()] for m in pattern.finditer(text.translate(str.maketrans(moved)))]


def _merge_rows(ids: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a matrix padded with -1: yields row numbers and their final cells as they get ready."""
    rows = np.arange(len(ids))
    ranks = pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        each = np.arange(len(rows))
        best = ranks[each, at] if ranks.shape[1] else np.full(len(rows), NO_MERGE)
        done = best == NO_MERGE
        if done.any():
            yield rows[done], ids[done]
            go = ~done
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            each = each[: len(rows)]
            if not len(rows):
                return
        ids[each, at] = best
        keep = np.ones(ids.shape, bool)
        keep[each, at + 1] = False
        ids = ids[keep].reshape(len(rows), -1)
        keep = np.ones(ranks.shape, bool)
        keep[each, at] = False
        ranks = ranks[keep].reshape(len(rows), -1)
        before = at > 0
        ranks[each[before], at[before] - 1] = pairs.find(ids[each[before], at[before] - 1], best[before])
        after = at < ranks.shape[1]
        ranks[each[after], at[after]] = pairs.find(best[after], ids[each[after], at[after] + 1])


def _merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One row of any length; further occurrences of the minimum pair merge in the same round.

    That gives the ids of one merge after another if no pair that comes up on the way ranks below
    the minimum; otherwise the round merges the leftmost pair only.
    """
    ranks = pairs.find(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NO_MERGE:
        at = np.flatnonzero(ranks == best)
        if len(at) > 1:
            run = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
        new = np.full(len(at), best)
        before, after = at[at > 0] - 1, at[at + 2 < len(ids)] + 2
        last = np.full(1, best)
        on_the_way = np.concatenate((
            pairs.find(ids[before], new[: len(before)]), pairs.find(new[: len(after)], ids[after]), pairs.find(last, last)
        ))
        if on_the_way.min() < best:
            at, new = at[:1], new[:1]
        ids[at] = new
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        keep = np.ones(len(ranks), bool)
        keep[at] = False
        ranks = ranks[keep]
        at = at - np.arange(len(at))
        left, right = at[at > 0] - 1, at[at < len(ranks)]
        ranks[left] = pairs.find(ids[left], ids[left + 1])
        ranks[right] = pairs.find(ids[right], ids[right + 1])
    return ids


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of every piece, and all ids in order of the pieces. Each piece is encoded on its own."""
    parts: list[np.ndarray | None] = [None] * len(pieces)
    rows: list[tuple[int, int, np.ndarray]] = []  # piece, part of it, bytes
    cut: dict[int, int] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            parts[i] = np.array([whole], np.int32)
            continue
        cells = np.frombuffer(piece, np.uint8)
        if len(piece) <= WIDE:
            rows.append((i, 0, cells))
            continue
        borders = np.flatnonzero(~vocabulary.beside[cells[:-1], cells[1:]]) + 1
        segments = np.split(cells, borders)
        cut[i] = len(segments)
        rows.extend((i, k, segment) for k, segment in enumerate(segments))
    made: dict[tuple[int, int], np.ndarray] = {}

    def settle(row: tuple[int, int, np.ndarray], ids: np.ndarray) -> None:
        if row[0] in cut:
            made[row[:2]] = ids
        else:
            parts[row[0]] = ids

    sizes = np.array([len(cells) for _, _, cells in rows], np.int64)
    order = np.argsort(sizes, kind="stable")
    buckets = np.ceil(np.log2(np.maximum(sizes[order], 2))).astype(int) if len(rows) else order
    for bucket in np.unique(buckets):
        inside = order[buckets == bucket]
        if sizes[inside[-1]] > WIDE:
            for j in inside:
                settle(rows[j], _merge_long(vocabulary.byte_ids[rows[j][2]], vocabulary.pairs))
            continue
        width = int(sizes[inside[-1]])
        for first in range(0, len(inside), max(1, CELLS // width)):
            some = inside[first:first + max(1, CELLS // width)]
            n = sizes[some]
            matrix = np.full((len(some), width), -1, np.int32)
            matrix[np.arange(width) < n[:, None]] = vocabulary.byte_ids[np.concatenate([rows[j][2] for j in some])]
            for done, cells in _merge_rows(matrix, vocabulary.pairs):
                ends = (cells >= 0).sum(axis=1)
                for j, ids, end in zip(some[done], cells, ends):
                    settle(rows[j], ids[:end])
    for i, n in cut.items():
        parts[i] = np.concatenate([made[i, k] for k in range(n)])
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return counts, np.concatenate(parts) if parts else np.zeros(0, np.int32)


class _Numbers(dict):
    """Pre-tokens by number; new ones get the next and are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.new.append(token)
        return number


class Encoder:
    """Encodes texts; remembers the pre-tokens of the last ones, ``REMEMBERED`` and one slice's at most."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.pattern, self.remembered = vocabulary, regex.compile(pattern), remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        if len(self.numbers) > self.remembered:
            self._forget()
        number, found = self.numbers.__getitem__, []
        for text in texts:
            tokens = split_text(text, self.pattern)
            found.append(np.fromiter(map(number, tokens), np.int32, len(tokens)))
        if self.numbers.new:
            counts, ids = encode_pieces([t.encode() for t in self.numbers.new], self.vocabulary)
            self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))
            self.numbers.new = []
        starts = np.cumsum(self.counts) - self.counts
        tokens = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        flat, bounds = _gather(self.ids, starts[tokens], self.counts[tokens])
        return flat, bounds[ends]


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start:start + count]`` one after another, and where each begins and ends."""
    bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return values[np.repeat(starts - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, and where each id's begin and end."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.lengths) or not vocabulary.lengths[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    return _gather(vocabulary.blob, vocabulary.starts[ids], vocabulary.lengths[ids])


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``most`` bytes at most, one row at least."""
    first = 0
    while first < len(sizes):
        end = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), most, side="right")))
        yield first, end
        first = end


def encode_texts(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, ids, packed`` of every row: the ids of its whole text as array<int>, and as little-endian 32-bit integers.

    Ids are those of the ranks in ``vocabulary`` (a path), each match of ``pattern`` encoded on its own; special
    strings are ordinary text. Null and empty texts have no ids. Rows are encoded apart whatever their id, repeated
    and null ones too; an empty table gives no rows; other columns are not read.
    """
    path, rule = vocabulary or vocabulary_path(), pattern or default_pattern()
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_vocabulary(path), rule)
        for batch in batches:
            texts = batch.column("text")
            for first, end in _slices(_byte_lengths(texts), SLICE_BYTES):
                flat, bounds = encoder.encode(texts.slice(first, end - first).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                packed = _binary(flat.astype("<u4").view(np.uint8), bounds * 4)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), ids, packed], ["doc_id", "ids", "packed"])

    return rows.mapInArrow(encode_batches, "doc_id bigint, ids array<int>, packed binary")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in ``out``; null ids give null, none give no bytes.

    A row with an id that the vocabulary lacks, or with a null id, ends the job: it was not made by it.
    """
    path = vocabulary or vocabulary_path()
    names = encoded.columns

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load_vocabulary(path)
        for batch in batches:
            lists = batch.column(ids_col)
            for first, end in _slices(_byte_lengths(lists), SLICE_BYTES):
                some = lists.slice(first, end - first)
                flat = some.flatten()
                if flat.null_count:
                    raise ValueError("an id is null")
                counts = np.asarray(some.value_lengths().fill_null(0)).astype(np.int64)
                data, bounds = decode(np.asarray(flat), known)
                made = _binary(data, bounds[np.concatenate(([0], np.cumsum(counts)))])
                if some.null_count:
                    made = pc.if_else(some.is_valid(), made, None)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), made], [*names, out])

    schema = StructType([*encoded.schema.fields, StructField(out, BinaryType())])
    return encoded.mapInArrow(decode_batches, schema)


def _byte_lengths(values: pa.Array) -> np.ndarray:
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        return np.asarray(pc.list_value_length(values).fill_null(0)).astype(np.int64) * 4
    return np.asarray(pc.binary_length(values).fill_null(0)).astype(np.int64)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(bounds.astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)]).cast(pa.binary())


def token_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded again."""
    decoded = decode_ids(encode_texts(docs, vocabulary), vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
