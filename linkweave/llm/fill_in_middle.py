"""Fill-in-middle: documents cut into prefix, middle and suffix and put in a new order, and back.

One full match of ``(unit)*`` by a regular expression library that keeps every repetition of a
group finds all units of a text at once: ``match.ends(1)`` holds the end of each, so its length is
the number of units and two look-ups in it are the cuts. Nothing steps over the text.

Where the cuts fall and which form a document takes is drawn from its id, so it does not depend on
partitions or reruns. Rows are transformed on their own: no shuffle, nothing through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

# A unit is one code point.
UNIT = r"(?s:.)"
# Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SEED = "1"


def repeated(unit: str) -> regex.Pattern:
    """Pattern whose full match keeps the end of every unit in group 1."""
    if regex.fullmatch(unit, ""):
        raise ValueError("a unit must not be empty")
    pattern = regex.compile(f"({unit})*")
    if pattern.groups != 1:
        raise ValueError("a unit must not hold groups of its own")
    return pattern


def checked_marks(marks: Sequence[str]) -> tuple[str, str, str]:
    """Marks that can be found again: all begin with one character that none has a second time.

    Then no mark can begin inside another one or across the border of a part that holds none.
    """
    first = {m[:1] for m in marks}
    if len(marks) != 3 or len(set(marks)) != 3 or len(first) != 1 or "" in first or any(m[0] in m[1:] for m in marks):
        raise ValueError("three different marks that begin with a character of their own")
    if any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("no mark may begin with another")
    return tuple(marks)


def draw(seed: str, doc_id: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of a hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    unit: str = UNIT,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: str = SEED,
    marks: Sequence[str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row, whole texts.

    ``n`` is the number of units. ``form`` is plain (the text as it is), psm or spm (order of the parts).
    Lengths are in code points, null if plain. A null text is an empty one; empty texts, texts that hold a
    mark and texts that units do not cover whole (``n`` is 0 then) are plain. Rows with one id, null included, draw alike;
    repeated rows give repeated results, an empty table none. Other columns are not read.
    """
    units, (before_prefix, before_suffix, before_middle) = repeated(unit), checked_marks(marks)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.select("doc_id", "text", *(draw(seed, F.col("doc_id"), k).alias(f"h{k + 1}") for k in range(4)))

    def parts(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        whole = units.fullmatch(text)
        ends = whole.ends(1) if whole else []
        n = len(ends)
        if not n or h3 % 100 >= 100 - plain_percent or any(m in text for m in marks):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        prefix, middle, suffix = before_prefix + text[:a], before_middle + text[a:b], before_suffix + text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, suffix + prefix + middle
        return n, "psm", a, b - a, prefix + suffix + middle

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = batch.column("doc_id"), [batch.column(c) for c in ("text", "h1", "h2", "h3", "h4")]
            made = [parts(*(v.as_py() for v in row)) for row in zip(*columns)]
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    return rows.mapInArrow(
        transform, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``output`` of ``form`` was made from; null where either is null or the form is unknown."""
    before_prefix, before_suffix, before_middle = checked_marks(marks)

    def split_at(value: Column, mark: str) -> tuple[Column, Column]:
        at = F.instr(value, mark)
        return F.substr(value, F.lit(1), at - 1), F.substr(value, at + len(mark))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = split_at(F.substr(output, F.lit(len(first) + 1)), second)
        return (one, *split_at(rest, before_middle))

    prefix, suffix, middle = parts(before_prefix, before_suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(before_suffix, before_prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, the text restored from the output."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


FILL_IN_MIDDLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, text, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn
), forms AS (
  SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM forms
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
