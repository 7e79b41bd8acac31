"""Violation rows, and which of them would be reported first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkweave.schemas import CHECK_ORDER, VIOLATIONS


def violation_rows(df: DataFrame, *, code: Column, **columns: Column) -> DataFrame:
    """Shape ``df`` as violations; columns that are not given are null."""
    given = {**columns, "error_code": code}
    return df.select(
        *[
            given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in VIOLATIONS.fields
        ]
    )


def check_order(code: Column) -> Column:
    pairs = [F.lit(part) for pair in CHECK_ORDER.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(99))


def first_violation(violations: DataFrame) -> DataFrame:
    """Per chain, the violation met first: lowest file name, then the earliest check."""
    first = F.min(F.struct("filename", check_order(F.col("error_code")).alias("step"), "error_code"))
    return (
        violations.groupBy("chain_id")
        .agg(first.alias("first"))
        .select("chain_id", "first.filename", "first.error_code")
    )


def uniqueness_violations(rows: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Values of each of ``keys`` that are missing or occur more than once in ``scope``.

    Both keys are counted in one pass; copies collapse before the shuffle.
    """
    spread = rows.select(
        *scope,
        F.inline(
            F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key_value")) for k in keys])
        ),
    )
    return (
        spread.groupBy(*scope, "key_name", "key_value")
        .agg(F.count("*").alias("n_rows"))
        .where((F.col("n_rows") > 1) | F.col("key_value").isNull())
    )
