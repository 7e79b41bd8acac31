import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.errors import PythonException

from linkweave.llm import byte_bpe
from linkweave.llm.byte_bpe import (
    Encoder, Vocabulary, decode, decode_ids, default_pattern, encode_pieces, encode_texts, load_vocabulary, token_report,
    vocabulary_path,
)
from tests.llm.samples import docs, rows, texts

ODD = [
    (200, "it's we'll  two   spaces\n\n\tand\r\ntabs nbsp em ​ zero\x1cfs\x85nel"), (201, "<|endoftext|> a<|endoftext|>"),
    (202, "日本語テキスト" * 100), (203, " " * 5000), (204, "x" * 3001), (205, "ab" * 4000 + "c"), (206, "á ² ½ ǅ ʰ 🙂👩‍👩‍👧"),
    (207, "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))),
]


@pytest.fixture(scope="module")
def library():
    ranks = load_vocabulary(vocabulary_path()).ranks
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})


def one_by_one(piece, ranks):
    """Ids of a piece by the rule alone: the leftmost pair of least rank merges until none is left."""
    parts = [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_as_the_library_and_back(spark, library):
    data = texts() + ODD
    expected = []
    for i, t in data:
        ids = library.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    expected.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(token_report(docs(spark, data)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_ids_and_packed_ids(spark, library):
    got = encode_texts(docs(spark, [(1, "two words"), (2, None)])).orderBy("doc_id").collect()
    assert got[0]["ids"] == library.encode_ordinary("two words") and got[1]["ids"] == []
    assert np.frombuffer(got[0]["packed"], "<u4").tolist() == got[0]["ids"] and got[1]["packed"] == b""


def test_empty_table(spark):
    assert token_report(docs(spark, [])).collect() == []


def test_decoding_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(1, [0, 1], "a"), (2, None, "b"), (3, [], "c")], "k int, ids array<int>, other string")
    ranks = {v: k for k, v in load_vocabulary(vocabulary_path()).ranks.items()}
    got = {r["k"]: (r["other"], r["decoded"]) for r in decode_ids(df).collect()}
    assert got == {1: ("a", ranks[0] + ranks[1]), 2: ("b", None), 3: ("c", b"")}


@pytest.mark.parametrize("ids", [[50256], [-1], [None]])
def test_ids_that_the_vocabulary_lacks(spark, ids):
    df = spark.createDataFrame([(1, ids)], "k int, ids array<int>")
    with pytest.raises(PythonException, match="an id is"):
        decode_ids(df).collect()


def test_small_vocabularies_merge_as_the_rule_says(monkeypatch):
    """Drawn vocabularies, also with entries that no merge reaches, on narrow and wide rows."""
    monkeypatch.setattr(byte_bpe, "WIDE", 12)
    rng = random.Random(5)
    for _ in range(60):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 25))}
        order = sorted(words)
        rng.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(order)}
        vocabulary = Vocabulary(ranks)
        pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(80)] + [b"a" * 33, b"ab" * 20]
        counts, ids = encode_pieces(pieces, vocabulary)
        expected = [one_by_one(p, ranks) for p in pieces]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
        assert decode(ids, vocabulary)[0].tobytes() == b"".join(pieces)


def test_every_entry_is_its_own_id():
    vocabulary = load_vocabulary(vocabulary_path())
    counts, ids = encode_pieces(list(vocabulary.ranks), vocabulary)
    assert (counts == 1).all() and ids.tolist() == list(vocabulary.ranks.values())


def test_forgetting_changes_nothing(library):
    encoder = Encoder(load_vocabulary(vocabulary_path()), default_pattern(), remembered=3)
    for text in ["one two three four five six", "one seven", "", "six five"] * 2:
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_letters_of_the_newest_unicode_split_as_in_the_library(library):
    """One character of each block of 64, and all that the two libraries class differently below U+3000."""
    encoder = Encoder(load_vocabulary(vocabulary_path()), default_pattern())
    for start in range(0, 0x30000, 0x1000):
        step = 1 if start < 0x3000 else 64
        for c in (chr(p) for p in range(start, start + 0x1000, step) if not 0xD800 <= p < 0xE000):
            text = f"A{c}1{c}! {c}"
            assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text), hex(ord(c))
