import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linkweave.llm.fill_in_middle import MARKS, checked_marks, fill_in_middle, fill_in_middle_report, repeated, restored
from tests.llm.samples import docs, rows, texts

ODD = [
    (300, "a<P>b"), (301, "a<S>b"), (302, "x<M>"), (303, "<"), (304, "<S<M<P"), (305, "🙂👩‍👩‍👧é日本\x00\r\n"), (306, ">><<S >P<"),
    *((i, "<" * (i % 7) + "S" * (i % 3) + "<P" * (i % 4) + "<M") for i in range(400, 500)),
]


def plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_every_row_as_by_hand(spark):
    data = texts() + ODD
    expected = sorted(((i, *plainly(i, t)) for i, t in data), key=lambda r: tuple((v is None, str(v)) for v in r))
    got = fill_in_middle(docs(spark, data))
    assert rows(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_digests_and_texts_come_back(spark):
    data = texts() + ODD
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, sha(plainly(i, t)[-1]), sha(t or "")) for i, t in data]
    expected.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(fill_in_middle_report(docs(spark, data)), "doc_id", "output_sha256", "restored_sha256") == expected


def test_empty_table(spark):
    assert fill_in_middle_report(docs(spark, [])).collect() == []


def test_words_as_units(spark):
    rng = random.Random(2)
    data = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    got = fill_in_middle(docs(spark, data), unit=r"\s*\S+", plain_percent=0, spm_percent=50)
    got = got.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    by_id = dict(data)
    assert {r["form"] for r in got} == {"psm", "spm"}
    for r in got:
        text = by_id[r["doc_id"]]
        a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
        assert r["n"] == len(text.split()) and r["back"] == text
        assert all(c in (0, len(text)) or text[c] == " " for c in (a, b))
    broken = fill_in_middle(docs(spark, [(1, "ends with a space ")]), unit=r"\s*\S+", plain_percent=0).first()
    assert (broken["n"], broken["form"], broken["output"]) == (0, "plain", "ends with a space ")


def test_units_and_marks_that_cannot_work():
    for unit in ("a?", "(a)b"):
        with pytest.raises(ValueError):
            repeated(unit)
    for marks in (("<P>", "<S>"), ("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<<>", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            checked_marks(marks)
    assert checked_marks(MARKS) == MARKS
