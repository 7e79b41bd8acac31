"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents:

* toxicity: rows that score as toxic go; the model is fitted on the labelled rows of the input;
* near_dedup: one row of each group of near-duplicates stays;
* decontamination: rows that hold a window of a benchmark item go;
* mixing: rows repeat as often as the mix takes them, some not at all;
* sharding: shard and slot of every row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm.common import table
from linkweave.llm.decontamination import without_benchmark
from linkweave.llm.minhash import without_near_duplicates
from linkweave.llm.mixing import mixed_copies
from linkweave.llm.sharding import assign_shards
from linkweave.llm.toxicity import without_toxic
from linkweave.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the cut. Null and empty texts score like padding; without labelled rows nothing is learned and a constant decides."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group. A text of fewer than five words is one shingle; texts without words are in no group and stay."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any occurrence; null and empty texts and items have no words, so they stay and match nothing."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of whole rows, repeated ids and null sources too; an empty table gives an empty mix."""
    return mixed_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place for every row, equal ones too; null texts count as empty."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# The toxicity model and the MinHash candidates have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
