"""One query per operator, with production parameters, over its whole table; SQL twins beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm.byte_bpe import token_report
from linkweave.llm.centroids import clustering_report, clustering_sql
from linkweave.llm.common import table
from linkweave.llm.decontamination import CONTAMINATION_SQL, contamination_report
from linkweave.llm.embeddings import EMBEDDING_LINKS_SQL, embedding_links
from linkweave.llm.fill_in_middle import FILL_IN_MIDDLE_SQL, fill_in_middle_report
from linkweave.llm.minhash import NEAR_DUPLICATES_SQL, near_duplicates
from linkweave.llm.mixing import MIX_SQL, mix_report
from linkweave.llm.secrets import SECRETS_SQL, find_secrets
from linkweave.llm.sharding import assign_shards
from linkweave.llm.suffix_dedup import REPEATED_RUNS_SQL, repeated_runs
from linkweave.llm.token_counts import count_tokens
from linkweave.llm.toxicity import toxicity_report
from linkweave.llm.warc import WARC_SQL, archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents")).drop("runs")


ORACLE["op1_suffix_dedup"] = REPEATED_RUNS_SQL


@query
def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op2_dart_minhash"] = NEAR_DUPLICATES_SQL


@query
def op3_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


ORACLE["op3_epsilon_grid"] = EMBEDDING_LINKS_SQL


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


ORACLE["op5_pareto_mix"] = MIX_SQL


@query
def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


ORACLE["op6_linked_secrets"] = SECRETS_SQL


@query
def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op7_benchmark_hits"] = CONTAMINATION_SQL


@query
def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


ORACLE["op8_warc_segments"] = WARC_SQL


@query
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_report(table(spark, sf_dir, "documents"))


ORACLE["op13_fill_in_middle"] = FILL_IN_MIDDLE_SQL


@query
def op12_orchard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering_report(table(spark, sf_dir, "embeddings"))


ORACLE["op12_orchard_centroids"] = clustering_sql()
