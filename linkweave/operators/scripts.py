"""Placeholders of script tables against tables of bindings.

A script row is ``(chain_id, script_id, text)``, a binding row ``(chain_id, name, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkweave.functions.templates import placeholder_refs, resolve
from linkweave.functions.text import is_binding_name

SCRIPT = ["chain_id", "script_id"]


def script_refs(scripts: DataFrame) -> DataFrame:
    """Distinct placeholder names per script."""
    return scripts.select(
        *SCRIPT, F.explode(F.array_distinct(placeholder_refs("text"))).alias("name")
    )


def unknown_placeholders(scripts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Names a script uses that its chain does not bind."""
    return script_refs(scripts).join(
        bindings.select("chain_id", "name"), ["chain_id", "name"], "left_anti"
    ).select(*SCRIPT, "name")


def repeated_bindings(bindings: DataFrame) -> DataFrame:
    """Names that a chain binds to more than one value (E65)."""
    return (
        bindings.groupBy("chain_id", "name")
        .agg(F.count_distinct(F.struct("value")).alias("n_values"))
        .where("n_values > 1")
        .select("chain_id", "name", F.lit("E65").alias("error_code"))
    )


def _settled(bindings: DataFrame) -> DataFrame:
    """One row per name with one value; equal repeats are one, contradicting ones none."""
    return (
        bindings.groupBy("chain_id", "name")
        .agg(F.min("value").alias("value"), F.count_distinct(F.struct("value")).alias("n_values"))
        .where("n_values = 1")
        .drop("n_values")
    )


def render(scripts: DataFrame, bindings: DataFrame, strict: bool = False) -> DataFrame:
    """Scripts with ``rendered`` text; null, with E36, where a name is not bound.

    A name bound twice to different values counts as not bound; ``repeated_bindings`` has it.

    Only names and values are looked up by the join; the map that comes out of it holds
    one script's own names, so it is bounded by that script and not by the chain.
    """
    looked_up = (
        script_refs(scripts)
        .join(_settled(bindings), ["chain_id", "name"])
        .groupBy(*SCRIPT)
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_values"))
    )
    nothing = F.create_map().cast("map<string,string>")
    values = F.coalesce(F.col("_values"), nothing)
    joined = scripts.join(looked_up, SCRIPT, "left")
    return joined.select(
        *[c for c in scripts.columns],
        resolve(F.col("text"), values, strict=strict).alias("rendered"),
    ).withColumn("error_code", F.when(F.col("rendered").isNull(), "E36"))


def invalid_bindings(bindings: DataFrame) -> DataFrame:
    """Bindings whose name could never be written as a placeholder (E64)."""
    return bindings.where(~F.coalesce(is_binding_name("name"), F.lit(False))).select(
        "chain_id", "name", F.lit("E64").alias("error_code")
    )
