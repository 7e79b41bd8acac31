"""Token counts: pieces are counted once per distinct pre-token and summed per document.

1. Every text is cut at special strings and split into pre-tokens by the vocabulary's own
   splitting rule; each Arrow batch sends its distinct pre-tokens with the number of
   documents that hold them, Spark adds these up.
2. Every distinct pre-token is encoded once. Only the number of its pieces is kept.
3. The documents' pre-token frequencies are joined to these counts and summed. The most
   frequent pre-tokens, as many as fit a fixed number of bytes, are joined where the text is
   read (a broadcast whose size does not grow with the data); the frequencies of all others
   go through a shuffle join, summed per document.

No token id is ever produced per document, and no text leaves the task that reads it.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import utf8_length
from linkweave.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
# Bytes of pre-tokens that are joined where texts are read; all others are shuffled.
BROADCAST_BYTES = 32 << 20

# Fixed value: the splitting rule of byte-level BPE vocabularies.
_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Up to U+024F both regular expression libraries agree on every character class (all of
# these are assigned since Unicode 5.0); other texts are split by the vocabulary's library.
_BEYOND = regex.compile(r"[^\x00-\x1B\x20-\x84\x86-ɏ]")
_SPLIT = regex.compile(_RULE)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def _special(path: str) -> regex.Pattern | None:
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None


def pre_tokens(text: str, path: str) -> tuple[Counter, int]:
    """Frequencies of the pre-tokens of a text, and how many special strings it holds."""
    special = _special(path)
    pieces = special.split(text) if special else [text]
    found: Counter = Counter()
    for piece in pieces:
        if not piece:
            continue
        if _BEYOND.search(piece):
            spans = _tokenizer(path).pre_tokenizer.pre_tokenize_str(piece)
            found.update(piece[a:b] for _, (a, b) in spans)
        else:
            found.update(_SPLIT.findall(piece))
    return found, len(pieces) - 1


def piece_counts(tokens: list[str], path: str) -> list[int]:
    """Pieces of each pre-token, encoded on its own."""
    encoded = _tokenizer(path).encode_batch(tokens, add_special_tokens=False)
    return [len(e) for e in encoded]


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = LIMIT,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, whole texts.

    Null and empty texts have no tokens. Special strings inside a text are one token each,
    as the library takes them. Every row is counted apart, whatever its id: rows get numbers
    of their own when their frequencies are written. An empty table gives no rows; other
    columns are not read.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: Counter = Counter()
            for text in frame["text"]:
                held.update(pre_tokens(text, path)[0].keys())
            yield pd.DataFrame({"token": list(held.keys()), "docs": list(held.values())})

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["pieces"] = piece_counts(frame["token"].tolist(), path)
            yield frame

    held = rows.select("text").mapInPandas(distinct, "token string, docs bigint")
    held = held.groupBy("token").agg(F.sum("docs").alias("docs"))
    counts = cut_lineage(held.mapInPandas(encode, "token string, docs bigint, pieces bigint"), "pieces")

    frequent, least = _most_frequent(counts, broadcast_bytes)
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            sums, tokens, times = [], [], []
            for text in batch.column("text"):
                found, total = pre_tokens(text.as_py(), path)
                rest, often = [], []
                for token, n in found.items():
                    pieces = table.get(token)
                    if pieces is None:
                        rest.append(token)
                        often.append(n)
                    else:
                        total += pieces * n
                sums.append(total), tokens.append(rest), times.append(often)
            made = [pa.array(sums, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            names = ["row", "doc_id", "n_bytes"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *made], names=[*names, "n_known", "tokens", "times"])

    keyed = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", utf8_length("text").alias("n_bytes"), "text"
    )
    read = cut_lineage(
        keyed.mapInArrow(
            frequencies,
            "row bigint, doc_id bigint, n_bytes bigint, n_known bigint, tokens array<string>, times array<bigint>",
        ),
        "frequencies",
    )
    others = (
        read.where(F.size("tokens") > 0)
        .select("row", F.explode(F.arrays_zip("tokens", "times")).alias("f"))
        .select("row", F.col("f.tokens").alias("token"), F.col("f.times").cast("int").alias("times"))
        .join(counts.where(F.col("docs") <= least).select("token", F.col("pieces").cast("int").alias("pieces")), "token")
        .groupBy("row")
        .agg(F.sum(F.col("times").cast("bigint") * F.col("pieces")).alias("n_other"))
    )
    n_tokens = F.col("n_known") + F.coalesce(F.col("n_other"), F.lit(0))
    return read.join(others, "row", "left").select(
        "doc_id",
        "n_bytes",
        n_tokens.cast("bigint").alias("n_tokens"),
        (n_tokens > limit).alias("over_limit"),
    )


def _most_frequent(counts: DataFrame, most_bytes: int) -> tuple[dict[str, int], int]:
    """Pre-tokens of the most documents within ``most_bytes``, and the frequency below all of them.

    Bytes are added up per number of documents (rounded down to a power of 2^(1/4) so that
    there are a few hundred steps at any scale); whole steps are taken until the next would
    not fit. So what comes to the driver is bounded, whatever the texts hold.
    """
    step = F.floor(F.log2(F.col("docs").cast("double")) * 4)
    cost = F.octet_length("token") + 64  # with the dictionary's own overhead
    sizes = counts.groupBy(step.alias("step")).agg(F.sum(cost).alias("bytes")).collect()
    taken, cut = 0, None
    for row in sorted(sizes, key=lambda r: -r["step"]):
        if taken + row["bytes"] > most_bytes:
            break
        taken, cut = taken + row["bytes"], row["step"]
    if cut is None:
        return {}, 2**62
    rows = counts.where(step >= cut).select("token", "pieces", "docs").toArrow()
    return dict(zip(rows["token"].to_pylist(), rows["pieces"].to_pylist())), min(rows["docs"].to_pylist()) - 1
