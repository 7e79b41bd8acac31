import pytest
from tokenizers import Tokenizer

from linkweave.llm.token_counts import VOCABULARY, count_tokens, vocabulary_path
from tests.llm.samples import docs, rows, texts

ODD = [
    (100, "it's we'll  two   spaces\n\n\tand\r\ntabs nbsp em ​ zero\x1cfs\x85nel"), (101, "<|endoftext|><|endoftext|> a<|endoftext|>"),
    (102, "日本語 テキスト १२३ ⅷ ² ½ ǅ ʰ"), (103, " " * 50), (104, "á combining é"), (105, "🙂👩‍👩‍👧"), (106, "ÀÉÎõü ß ſ"),
]


@pytest.mark.parametrize("broadcast_bytes", [0, 3000, 1 << 20])
def test_as_the_library_counts(spark, broadcast_bytes):
    tokenizer = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    data = texts() + ODD
    expected = []
    for i, t in data:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    expected.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
    found = count_tokens(docs(spark, data), broadcast_bytes=broadcast_bytes)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_empty_table(spark):
    assert count_tokens(docs(spark, [])).collect() == []
