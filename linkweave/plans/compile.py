"""From candidate to runnable text: includes first, then placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkweave.operators.includes import expand_includes
from linkweave.operators.scripts import render

CANDIDATE_PATH = "current.sql"


def expand_candidates(candidates: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with includes expanded as ``(chain_id, body)``, and the faults found."""
    roots = candidates.select(
        "chain_id", F.lit(CANDIDATE_PATH).alias("root"), F.col("body").alias("text")
    )
    expanded, faults = expand_includes(roots, fragments)
    return expanded.select("chain_id", F.col("text").alias("body")), faults


def compile_scripts(candidates: DataFrame, fragments: DataFrame, bindings: DataFrame) -> DataFrame:
    """Runnable text per candidate, or the code of the error that stops it."""
    expanded, faults = expand_candidates(candidates, fragments)
    scripts = expanded.select(
        "chain_id", F.lit(CANDIDATE_PATH).alias("script_id"), F.col("body").alias("text")
    )
    compiled = render(scripts, bindings).select("chain_id", F.col("rendered").alias("compiled"), "error_code")
    return compiled.unionByName(
        faults.select("chain_id", F.lit(None).cast("string").alias("compiled"), "error_code")
    )
