"""Placeholders in scripts and ``${...}`` in settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkweave.functions.text import _col, let

# Fixed value: how a script falls into stretches that stay (strings, comments, runs of
# colons, other text) and placeholders. A stretch is as long as possible, so a script
# gives only about two tokens per placeholder.
PLACEHOLDER = r":[_A-Z][_0-9A-Z]*+"
SCRIPT_TOKENS = (
    r"(?:'[^']*+(?:''[^']*+)*+'?"
    r"|--[^\n]*+"
    r"|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
    r"|::++"
    r"|[^'\-/:]++"
    r"|(?!:[_A-Z])[\s\S])++"
    r"|" + PLACEHOLDER
)
_IS_PLACEHOLDER = r"\A:[_A-Z][_0-9A-Z]*\z"

# Fixed value: stretches of a setting; an interpolation ends at the first closing brace.
SETTING_TOKENS = r"\$\{[^}]*+\}?|(?:[^$]|\$(?!\{))++"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SCRIPT_TOKENS), F.lit(0))


def placeholder_refs(text: Column | str) -> Column:
    """Names of the placeholders outside strings and comments, in order, with repeats."""
    names = F.filter(_tokens(_col(text)), lambda t: t.rlike(_IS_PLACEHOLDER))
    return F.transform(names, lambda t: F.substr(t, F.lit(2)))


def unresolved(text: Column | str, bindings: Column) -> Column:
    """Distinct placeholder names of ``text`` that ``bindings`` (a map) does not hold."""
    return F.filter(
        F.array_distinct(placeholder_refs(text)),
        lambda name: F.coalesce(~F.map_contains_key(bindings, name), F.lit(True)),
    )


def resolve(text: Column | str, bindings: Column, strict: bool = False) -> Column:
    """Put bound values in place of placeholders, in one pass (values are not rescanned).

    An unknown name makes the whole result null, or, with ``strict``, ends the job.
    """
    def fill(token: Column) -> Column:
        name = F.substr(token, F.lit(2))
        value = F.try_element_at(bindings, name)
        if strict:
            value = F.coalesce(
                value, F.raise_error(F.concat(F.lit("E36 unknown placeholder :"), name)).cast("string")
            )
        return F.when(token.rlike(_IS_PLACEHOLDER), value).otherwise(token)

    return let(
        F.transform(_tokens(_col(text)), fill),
        lambda filled: F.when(
            ~F.exists(filled, lambda piece: piece.isNull()), F.array_join(filled, "")
        ),
    )


def interpolate(text: Column | str, variables: Column) -> Column:
    """Put variables in place of ``${NAME}`` and ``${NAME:-default}``.

    Gives ``struct(value, error_code)``. A set but empty variable wins over the default.
    A default ends at the first closing brace, so an opening ``${`` inside a default
    that comes into use can never be closed.
    """
    tokens = F.regexp_extract_all(_col(text), F.lit(SETTING_TOKENS), F.lit(0))

    def read(token: Column) -> Column:
        inner = F.substr(token, F.lit(3), F.length(token) - 3)
        mark = F.instr(inner, ":-")
        name = F.when(mark > 0, F.substr(inner, F.lit(1), mark - 1)).otherwise(inner)
        found = F.struct(
            name.alias("name"),
            F.when(mark > 0, F.substr(inner, mark + 2)).alias("default"),
            F.try_element_at(variables, name).alias("value"),
        )
        plain = F.struct(token.alias("piece"), F.lit(None).cast("string").alias("code"))
        return F.when(token.startswith("${"), let(found, lambda f: judge(token, f))).otherwise(plain)

    def judge(token: Column, found: Column) -> Column:
        value, default = found["value"], found["default"]
        code = (
            F.when(~token.endswith("}"), "E60")
            .when(found["name"] == "", "E61")
            .when(value.isNull() & default.isNull(), "E62")
            .when(value.isNull() & default.contains("${"), "E60")
        )
        return F.struct(F.coalesce(value, default).alias("piece"), code.alias("code"))

    def join(pieces: Column) -> Column:
        codes = F.filter(F.transform(pieces, lambda p: p["code"]), lambda c: c.isNotNull())
        return let(
            F.try_element_at(codes, F.lit(1)),
            lambda code: F.struct(
                F.when(
                    code.isNull(), F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
                ).alias("value"),
                code.alias("error_code"),
            ),
        )

    return let(F.transform(tokens, read), join)
