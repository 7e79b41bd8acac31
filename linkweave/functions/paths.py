"""Include directives and the paths they name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkweave.functions.text import _col, trim_space

# Fixed value: an include line, its own line break with it. Lines end at LF only.
INCLUDE_LINE = r"(?dmU)^[\s&&[^\n]]*+--! include ([^\n]*\S)[^\n]*+(?:\n|\z)"
FRAGMENT_ROOT = "fixtures"


def include_paths(text: Column | str) -> Column:
    """The paths named by include lines, in order."""
    raw = F.regexp_extract_all(_col(text), F.lit(INCLUDE_LINE), F.lit(1))
    return F.transform(raw, trim_space)


def include_literals(text: Column | str) -> Column:
    """The stretches around the include lines: always one more than there are includes."""
    return F.split(_col(text), INCLUDE_LINE, -1)


def include_refs(text: Column | str) -> Column:
    """``array<struct<line, path>>``: include lines with their line number, from 1."""
    lines = F.split(_col(text), "\n", -1)
    marked = F.transform(
        lines,
        lambda content, i: F.struct((i + 1).alias("line"), trim_space(content).alias("content")),
    )
    found = F.filter(marked, lambda m: m["content"].startswith("--! include "))
    return F.transform(
        found,
        lambda m: F.struct(
            m["line"].alias("line"), trim_space(F.substr(m["content"], F.lit(13))).alias("path")
        ),
    )


def parent_folder(path: Column | str) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.regexp_extract(_col(path), r"\A([\s\S]*)/[^/]*\z", 1)


def fold_path(base: Column | str, relative: Column | str) -> Column:
    """``relative`` as seen from folder ``base``, with ``.`` and ``..`` folded away.

    Null when the path is absolute or climbs above the top: it must not be clamped there,
    or it could come back into a folder it has no business in.
    """
    relative = _col(relative)
    parts = F.split(F.concat_ws("/", _col(base), relative), "/")
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped")
    )

    def step(acc: Column, part: Column) -> Column:
        up = F.struct(
            F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0))).alias("stack"),
            (acc["escaped"] | (F.size(acc["stack"]) == 0)).alias("escaped"),
        )
        down = F.struct(
            F.array_append(acc["stack"], part).alias("stack"), acc["escaped"].alias("escaped")
        )
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    folded = F.aggregate(parts, start, step)
    return F.when(
        ~folded["escaped"] & ~relative.startswith("/"), F.array_join(folded["stack"], "/")
    )


def within(path: Column | str, root: str = FRAGMENT_ROOT) -> Column:
    """True when a folded path lies below ``root``; an escaped (null) path does not."""
    return F.coalesce(_col(path).startswith(root + "/"), F.lit(False))
