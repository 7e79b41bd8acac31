"""Change files as text: header block, body, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkweave.functions.text import (
    HASH_SHAPE, let, normalize, to_lf, trim_space,
)

# How a header line looks.
HEADER_MARK = "--! "
HEADER_BLOCK = r"\A((?:--! [^\n]*+(?:\n|\z))*+)(\n*+)(--! )?"
HEADER_LINE_ANYWHERE = r"(?:\A|\n)--! "

PARSED = "struct<previous_hash:string,hash:string,body:string,error_code:string>"
_SEEN = "struct<previous:string,hash:string,code:string>"


def parse_change(text: Column | str) -> Column:
    """Split a change file into previous hash, hash and body, or the first error code.

    The headers of one file are folded once, left to right: whether a header is a repeat
    depends on those before it, and the first faulty one decides the error.
    """
    return let(
        to_lf(text),
        lambda lf: let(
            F.struct(
                lf.alias("text"),
                F.regexp_extract(lf, HEADER_BLOCK, 1).alias("block"),
                F.regexp_extract(lf, HEADER_BLOCK, 3).alias("late"),
            ),
            _parse_parts,
        ),
    )


def _parse_parts(parts: Column) -> Column:
    block = parts["block"]
    lines = F.filter(F.split(block, "\n"), lambda line: line != "")
    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("previous"), nothing.alias("hash"), nothing.alias("code"))
    read = F.struct(
        F.aggregate(lines, start, _take_header).alias("seen"),
        normalize(F.substr(parts["text"], F.length(block) + 1)).alias("body"),
    )

    def judge(read: Column) -> Column:
        seen, body = read["seen"], read["body"]
        return F.coalesce(
            seen["code"],
            F.when(block == "", F.lit("E10")),
            F.when(parts["late"] != "", F.lit("E03")),
            F.when(body == "", F.lit("E11")),
            F.when(seen["hash"].isNull(), F.lit("E12")),
        )

    def result(read: Column, code: Column) -> Column:
        sound = code.isNull()
        return F.struct(
            F.when(sound, read["seen"]["previous"]).alias("previous_hash"),
            F.when(sound, read["seen"]["hash"]).alias("hash"),
            F.when(sound, read["body"]).alias("body"),
            code.alias("error_code"),
        ).cast(PARSED)

    return let(read, lambda r: let(judge(r), lambda code: result(r, code)))


def _take_header(seen: Column, line: Column) -> Column:
    content = F.substr(line, F.lit(len(HEADER_MARK) + 1))
    colon = F.instr(content, ":")
    pair = F.struct(
        (colon > 0).alias("has_colon"),
        trim_space(F.substr(content, F.lit(1), colon - 1)).alias("key"),
        trim_space(F.substr(content, colon + 1)).alias("value"),
    )
    return F.when(seen["code"].isNotNull(), seen).otherwise(
        let(pair, lambda p: _judge_header(seen, p))
    )


def _judge_header(seen: Column, pair: Column) -> Column:
    key, value = pair["key"], pair["value"]
    is_hash = value.rlike(HASH_SHAPE)
    code = (
        F.when(~pair["has_colon"], "E04")
        .when(key == "Previous",
              F.when(seen["previous"].isNotNull(), "E05")
              .when((value != "") & ~is_hash, "E06"))
        .when(key == "Hash",
              F.when(seen["hash"].isNotNull(), "E07")
              .when(~is_hash, "E08"))
        .otherwise("E09")
    )
    return F.struct(
        F.coalesce(
            seen["previous"], F.when((key == "Previous") & (value != ""), F.lower(value))
        ).alias("previous"),
        F.coalesce(seen["hash"], F.when(key == "Hash", F.lower(value))).alias("hash"),
        code.alias("code"),
    ).cast(_SEEN)


def render_change(previous: Column, recorded: Column, body: Column) -> Column:
    """The text of a change file: two headers, a blank line, the normalised body."""
    return F.concat(
        F.lit("--! Previous: "), F.coalesce(previous, F.lit("")),
        F.lit("\n--! Hash: "), recorded,
        F.lit("\n\n"), normalize(body),
    )


def candidate_error(body: Column | str) -> Column:
    """E30 for a blank candidate, E31 for one with header lines, else null."""
    return let(
        normalize(to_lf(body)),
        lambda text: F.when(text == "", "E30").when(text.rlike(HEADER_LINE_ANYWHERE), "E31"),
    )

