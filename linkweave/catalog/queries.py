"""The registered queries by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkweave.catalog import inputs as given
from linkweave.functions.headers import candidate_error, parse_change, render_change
from linkweave.functions.paths import include_refs as include_refs_of
from linkweave.functions.templates import interpolate
from linkweave.functions.text import (
    hash_matches, is_binding_name, is_identifier, is_valid_hash, link_hash, normalize, parse_version,
    packed, quote_ident, unpacked,
)
from linkweave.operators import chain, history, includes, scripts, snapshots, state, violations
from linkweave.plans import lifecycle
from linkweave.plans.audit import audit, audit_files as audit_of_files, log_violations
from linkweave.plans.compile import compile_scripts as compile_candidates
from linkweave.schemas import APPLIED_LOG, CANDIDATES
from linkweave.session import fresh_path
from linkweave.sources import files, tables
from linkweave.sources.committed import commit_changes
from linkweave.sources.files import parse_changes
from linkweave.sources.tables import applied_key_violations, current, put_candidates, read_bindings
from linkweave.streaming.apply import CHANGE_EVENTS, ContinuousApply, stream_change_files
from linkweave.streaming.common import DEFAULT_INTERVAL, triggered
from linkweave.streaming.detect import ChangeDetector
from linkweave.streaming.watch import FileWatcher

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Text and row-local checks


@query
def normalize_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    padded = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("\u3000\u00a0\t"), "text", F.lit("\r\n\u2003")))
        .when(kind == 2, F.concat(F.lit("\n\n"), "text", F.lit("\n\n\n")))
        .when(kind == 3, F.concat(F.lit(" \u0085\u2028\r\n"), F.translate("text", "aeiou", "\u2003\u2003\u2003\u2003\u2003"), F.lit("\t")))
        .otherwise(F.concat("text", F.lit("\u200b ")))
    )
    return given.table(spark, sf_dir, "documents").select("doc_id", normalize(padded).alias("body"))


@query
def link_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = F.when(F.col("n_chars") % 2 == 0, F.sha2("source", 256))
    return given.table(spark, sf_dir, "documents").select(
        "doc_id", link_hash(previous, F.col("text")).alias("hash")
    )


@query
def valid_hash_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, kind = F.sha2("text", 256), F.col("doc_id") % 5
    damaged = (
        F.when(kind == 1, F.upper(digest))
        .when(kind == 2, F.substring(digest, 1, 63))
        .when(kind == 3, F.concat(F.substring(digest, 1, 63), F.lit("g")))
        .when(kind == 4, F.concat(digest, F.lit("\n")))
        .otherwise(digest)
    )
    return (
        given.table(spark, sf_dir, "documents")
        .select("doc_id", damaged.alias("hash"))
        .where(is_valid_hash("hash"))
    )


@query
def parse_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    name = (
        F.when(kind == 1, F.concat(F.lpad(number, 6, "0"), F.lit(".SQL")))
        .when(kind == 2, F.concat(F.lpad(number, 7, "0"), F.lit(".sql")))
        .when(kind == 3, F.concat(number, F.lit(".sql")))
        .when(kind == 4, F.concat(F.lpad(number, 6, "0"), F.lit(".sql\n")))
        .otherwise(F.concat(F.lpad(number, 6, "0"), F.lit(".sql")))
    )
    return given.table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("filename"), parse_version(name).alias("version")
    )


@query
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = given.table(spark, sf_dir, "part")
    names = part.select(
        "p_partkey",
        F.explode(F.array(
            "p_name", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")),
            F.replace("p_brand", F.lit("#"), F.lit('"')), F.concat(F.lit("_"), F.col("p_size").cast("string")),
            F.concat(F.col("p_size").cast("string"), "p_type"), F.lit(""),
        )).alias("name"),
    )
    return names.select(
        "p_partkey", "name",
        is_identifier("name").alias("is_identifier"),
        is_binding_name("name").alias("is_binding_name"),
        quote_ident("name").alias("quoted"),
    )


@query
def candidate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.conversation_candidates(spark, sf_dir).select(
        "chain_id", candidate_error("body").alias("error_code")
    )


@query
def render_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.conversation_log(spark, sf_dir).select(
        "chain_id", "filename",
        render_change(F.col("previous_hash"), F.col("hash"), F.col("body")).alias("text"),
    )


@query
def parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered changes, damaged in one of fourteen ways, parsed back."""
    return _damaged_files(spark, sf_dir).select("chain_id", "version", parse_change("text").alias("parsed")).select(
        "chain_id", "version", "parsed.previous_hash", "parsed.hash", "parsed.body", "parsed.error_code"
    )


def _damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = render_changes(spark, sf_dir).withColumn("version", parse_version("filename"))
    text, kind = F.col("text"), (F.col("chain_id") * 3 + F.col("version")) % 14
    other = F.lit("d" * 64)
    damaged = (
        F.when(kind == 1, F.concat(F.lit("--! Previous: \n"), text))
        .when(kind == 2, F.concat(F.lit("--! Previous: "), other, F.lit("\n"), text))
        .when(kind == 3, F.concat(F.lit("--! Previous: 12\n"), text))
        .when(kind == 4, F.concat(F.lit("--! Hash: "), other, F.lit("\n"), text))
        .when(kind == 5, F.replace(text, F.lit("--! Hash: "), F.lit("--! Hash: 0")))
        .when(kind == 6, F.concat(F.lit("--! Author : me\n"), text))
        .when(kind == 7, F.concat(F.lit("--! \n"), text))
        .when(kind == 8, F.replace(text, F.lit("--! Hash"), F.lit("\n--! Hash")))
        .when(kind == 9, F.concat(F.lit(" "), text))
        .when(kind == 10, F.regexp_extract(text, r"\A[^\n]*\n[^\n]*", 0))
        .when(kind == 11, F.regexp_replace(text, r"\A([^\n]*)\n[^\n]*\n", "$1\n"))
        .when(kind == 12, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(kind == 13, F.concat(F.regexp_extract(text, r"\A[^\n]*\n[^\n]*\n", 0), F.lit("\n \t\n")))
        .otherwise(text)
    )
    return files.select("chain_id", "version", "filename", damaged.alias("text"))


def _file_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = given.stored(parse_changes(_damaged_files(spark, sf_dir).drop("version")))
    return audit_of_files(parsed, spark.createDataFrame([], APPLIED_LOG))


@query
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of damaged change files: of their headers, and of the log that is left."""
    return _file_faults(spark, sf_dir).select("chain_id", "version", "filename", "error_code")


@query
def first_violation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.first_violation(_file_faults(spark, sf_dir))


@query
def env_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.customer_settings(spark, sf_dir).select(
        "c_custkey", interpolate("setting", F.col("variables")).alias("filled")
    ).select("c_custkey", "filled.value", "filled.error_code")


@query
def invalid_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    name = (
        F.when(kind == 0, F.col("c_mktsegment"))
        .when(kind == 1, F.lower("c_mktsegment"))
        .when(kind == 2, F.col("c_name"))
        .otherwise(F.concat(F.lit("_"), F.col("c_nationkey").cast("string")))
    )
    bindings = given.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("chain_id"), name.alias("name"), F.col("c_name").alias("value")
    )
    return scripts.invalid_bindings(bindings)


@query
def filled_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings kept as JSON files, read back with variables filled in."""
    kind = F.col("c_custkey") % 3
    value = (
        F.when(kind == 0, F.concat(F.lit("${STAGE}_"), F.lower("c_mktsegment")))
        .when(kind == 1, F.concat(F.lit("${OWNER:-"), F.col("c_name"), F.lit("}/x")))
        .otherwise(F.concat(F.lit("${EMPTY:-y}${NATION_"), F.col("c_nationkey").cast("string"), F.lit("}")))
    )
    path = fresh_path(spark, "bindings")
    given.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("chain_id"), F.lit("SCHEMA_NAME").alias("name"), value.alias("value")
    ).write.json(path)
    return read_bindings(spark, path, variables={"STAGE": "test", "EMPTY": "", "NATION_7": "seven"})


# Projects as folders of files


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """A folder of projects: committed changes, candidates and fragments of all conversations."""
    root = fresh_path(spark, "projects")
    root = f"file://{root}" if root.startswith("/") else root
    place = lambda *parts: F.concat_ws("/", F.col("chain_id").cast("string"), *parts).alias("path")
    log = files.rendered_changes(given.conversation_log(spark, sf_dir))
    rows = log.select(place(F.lit("committed"), "filename"), "text").unionByName(
        given.conversation_candidates(spark, sf_dir).select(place(F.lit("current.sql")), F.col("body").alias("text"))
    ).unionByName(given.conversation_snippets(spark, sf_dir).select(place("path"), "text"))
    files.export_files(rows, root)
    return root


@query
def scanned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_changes(files.scan_changes(spark, _exported(spark, sf_dir)))


@query
def scanned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_candidates(spark, _exported(spark, sf_dir))


@query
def scanned_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_snippets(spark, _exported(spark, sf_dir))


@query
def scanned_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and place of every file of the projects; the change times are those of this run."""
    stamps = files.scan_stamps(spark, [_exported(spark, sf_dir)], 1)
    inside = F.regexp_extract("path", r"/linkweave-projects-[^/]*/(.*)\z", 1)
    return stamps.select(inside.alias("path"), "size", (F.col("modified_ms") > 0).alias("has_time"))


@query
def stamps_of_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As scanned_stamps, with a table of roots: every project folder is one, some are named twice."""
    root = _exported(spark, sf_dir)
    named = given.conversation_log(spark, sf_dir).select("chain_id").union(given.conversation_candidates(spark, sf_dir).select("chain_id"))
    named = named.union(given.conversation_snippets(spark, sf_dir).select("chain_id"))
    stamps = files.scan_stamps_of(named.select(F.concat_ws("/", F.lit(root), F.col("chain_id").cast("string")).alias("root")), 1)
    inside = F.regexp_extract("path", r"/linkweave-projects-[^/]*/(.*)\z", 1)
    return stamps.select(inside.alias("path"), "size", (F.col("modified_ms") > 0).alias("has_time"))


@query
def streamed_change_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change files of the projects as a stream delivers them."""
    stream = stream_change_files(spark, _exported(spark, sf_dir))
    out, log = fresh_path(spark, "arrived"), fresh_path(spark, "arrived-log")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", log)
    triggered(writer, True, DEFAULT_INTERVAL).start(out).awaitTermination()
    return parse_changes(spark.read.parquet(out))


@query
def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log committed as files in two commits, the second of which repeats part of the first, and scanned."""
    root, log = fresh_path(spark, "committed"), given.stored(given.conversation_log(spark, sf_dir))
    root = f"file://{root}" if root.startswith("/") else root
    commit_changes(log.where("version <= 4"), root)
    commit_changes(log.where("version >= 3"), root)
    return parse_changes(files.scan_changes(spark, root))


@query
def watched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of the candidates' files: as they were made, then some edited and some emptied, between polls."""
    root, out, roots = (fresh_path(spark, label) for label in ("watched", "watch", "roots"))
    uri = f"file://{root}" if root.startswith("/") else root
    path = F.concat_ws("/", F.col("chain_id").cast("string"), F.lit("current.sql")).alias("path")
    candidates = given.stored(given.conversation_candidates(spark, sf_dir))
    candidates.select(F.concat_ws("/", F.lit(uri), F.col("chain_id").cast("string")).alias("root")).write.parquet(roots)
    watcher = FileWatcher(out, roots if "://" in roots else f"file://{roots}")

    def poll(rows: DataFrame) -> None:
        files.export_files(rows.select(path, F.col("body").alias("text")), uri)
        watcher.start(spark, f"{out}/checkpoint", available_now=True).awaitTermination()

    poll(candidates)
    edited = F.when(F.col("chain_id") % 3 == 1, F.concat(F.lit("-- edited\n"), "body")).otherwise("")
    poll(candidates.where("chain_id % 3 > 0").withColumn("body", edited))
    return watcher.files(spark).select(
        F.regexp_extract("path", r"/([0-9]+)/current\.sql\z", 1).cast("bigint").alias("chain_id"),
        F.row_number().over(Window.partitionBy("path").orderBy("tick")).alias("state"),
        F.col("content").cast("string").alias("body"),
    )


@query
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as one table of rendered texts and parsed back."""
    out = fresh_path(spark, "change-table")
    files.write_change_table(given.conversation_log(spark, sf_dir), out)
    return parse_changes(spark.read.parquet(out))


# Chains


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.tampered(given.conversation_log(spark, sf_dir))


@query
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.conversation_log(spark, sf_dir)


@query
def chain_head_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.fold_heads(given.event_changes(spark, sf_dir))


@query
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chain_heads(given.conversation_log(spark, sf_dir))


@query
def verify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir).select(
        "chain_id", "filename", hash_matches("previous_hash", "hash", "body").alias("hash_ok")
    )


@query
def latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.latest_change(given.conversation_log(spark, sf_dir))


@query
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.next_versions(given.conversation_log(spark, sf_dir))


@query
def contiguity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = given.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("version")
    )
    return chain.contiguity_violations(lines)


@query
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = given.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("target_id"),
        F.lit(0).cast("bigint").alias("chain_id"),
        F.col("l_linenumber").cast("string").alias("filename"),
        F.nullif(F.col("l_shipdate").cast("date").cast("string"), F.lit("2000-04-04")).alias("hash"),
    )
    return applied_key_violations(lines)


@query
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.broken_links(given.stored(_tampered(spark, sf_dir)))


@query
def genesis_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.genesis_violations(_tampered(spark, sf_dir))


@query
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.first_violation(log_violations(given.stored(_tampered(spark, sf_dir))))


@query
def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, applied, _ = _fleet(spark, sf_dir)
    return audit(given.stored(given.tampered(log)), applied)


# Histories


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = given.stored(given.conversation_log(spark, sf_dir))
    return (
        log,
        given.stored(given.conversation_applied(spark, sf_dir, log)),
        given.conversation_targets(spark, sf_dir),
    )


@query
def history_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, applied, _ = _fleet(spark, sf_dir)
    return history.history_divergence(changes, applied)


@query
def orphan_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, applied, _ = _fleet(spark, sf_dir)
    return history.orphan_applied(changes, applied)


@query
def pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pending_changes(*_fleet(spark, sf_dir))


@query
def pending_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pending_by_offset(*_fleet(spark, sf_dir))


@query
def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, applied, targets = _fleet(spark, sf_dir)
    return lifecycle.fleet_status(
        changes, applied, given.conversation_candidates(spark, sf_dir), targets
    )


@query
def apply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, applied, targets = _fleet(spark, sf_dir)
    changes = given.stored(given.tampered(log))
    return lifecycle.apply_summary(lifecycle.gated_progress(changes, applied, targets))


@query
def uncommit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, applied, targets = _fleet(spark, sf_dir)
    return lifecycle.uncommit_latest(
        changes, applied, given.conversation_candidates(spark, sf_dir), targets
    )


@query
def restored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates after last changes were taken back into them."""
    changes, applied, targets = _fleet(spark, sf_dir)
    old = given.conversation_candidates(spark, sf_dir)
    taken = lifecycle.uncommit_latest(changes, applied, old, targets)
    root = fresh_path(spark, "candidates")
    put_candidates(
        taken.where(F.col("error_code").isNull()).select("chain_id", F.col("restored_body").alias("body")),
        old, root,
    )
    return current(spark, root, "candidates", CANDIDATES)


# Applied logs


@contextmanager
def _applied_table(spark: SparkSession, manage: bool = True) -> Iterator[str]:
    """The name of an applied log of its own, in the warehouse; what is read from it has to be stored before it goes."""
    name = f"linkweave_applied_{uuid.uuid4().hex}"
    if manage:
        tables.ensure_applied_log(spark, name)
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _conversation_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.stored(given.conversation_applied(spark, sf_dir, given.conversation_log(spark, sf_dir)))


@query
def applied_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories recorded in two appends, the second of which repeats the first, and read back."""
    applied = _conversation_applied(spark, sf_dir)
    with _applied_table(spark) as log:
        tables.record_applied(applied.where("filename < '000004.sql'"), log)
        tables.record_applied(applied, log)
        return given.stored(tables.read_applied(spark, log).drop("applied_at"))


@query
def applied_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name a recorded file with another hash, or a recorded hash under another name."""
    applied = _conversation_applied(spark, sf_dir)
    version = F.substring("filename", 1, 6).cast("int")
    other = applied.select(
        "target_id", "chain_id",
        F.when(version % 2 == 0, F.concat(F.lit("x"), "filename")).otherwise(F.col("filename")).alias("filename"),
        F.when(version % 2 == 1, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"),
        "previous_hash",
    )
    with _applied_table(spark) as log:
        tables.record_applied(applied, log)
        return tables.record_applied(other.unionByName(applied), log)


@query
def applied_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rows of the longer chains, read from the buckets of these chains."""
    applied = _conversation_applied(spark, sf_dir)
    longer = given.conversation_bodies(spark, sf_dir).where("version = 5").select("chain_id")
    with _applied_table(spark) as log:
        tables.record_applied(applied, log)
        return given.stored(tables.applied_of_chains(longer, log).drop("applied_at"))


@query
def applied_if_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rows per target; a log that is not there counts as empty."""
    applied = _conversation_applied(spark, sf_dir)
    with _applied_table(spark) as log, _applied_table(spark, manage=False) as missing:
        tables.record_applied(applied, log)
        rows = tables.read_applied_if_present(spark, missing).unionByName(tables.read_applied_if_present(spark, log))
        return given.stored(rows.groupBy("target_id", "chain_id").agg(F.count("*").alias("n_rows")))


@query
def applied_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the log is there and how many rows it has: before it is made, when it is required, made, filled."""
    applied = _conversation_applied(spark, sf_dir)
    states = []

    def note(step: str, log: str) -> None:
        rows = tables.read_applied_if_present(spark, log).agg(F.count("*").alias("n_rows"))
        row = rows.select(F.lit(step).alias("step"), F.lit(tables.log_exists(spark, log)).alias("is_there"), "n_rows")
        states.append(given.stored(row))

    with _applied_table(spark, manage=False) as log:
        note("1 missing", log)
        try:
            tables.ensure_applied_log(spark, log, manage=False)
        except ValueError as refused:
            note(f"2 required: {str(refused)[:3]}", log)
        tables.ensure_applied_log(spark, log)
        tables.ensure_applied_log(spark, log, manage=False)
        note("3 made", log)
        tables.record_applied(applied, log)
        note("4 filled", log)
    return reduce(DataFrame.unionByName, states)


# Scripts


@query
def placeholder_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.script_refs(given.document_scripts(spark, sf_dir))


@query
def unknown_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.unknown_placeholders(
        given.document_scripts(spark, sf_dir), given.document_bindings(spark, sf_dir)
    )


@query
def render_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.render(
        given.document_scripts(spark, sf_dir), given.document_bindings(spark, sf_dir)
    ).drop("text")


@query
def include_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.part_fragments(spark, sf_dir, damaged=True).select(
        "chain_id", F.col("path").alias("source"), F.inline(include_refs_of("text"))
    )


@query
def include_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.expand_includes(
        given.part_roots(spark, sf_dir), given.part_fragments(spark, sf_dir, damaged=False)
    )[0]


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return given.part_roots(spark, sf_dir), given.part_fragments(spark, sf_dir, damaged=True)


@query
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.traverse(*_damaged(spark, sf_dir)).closure()


@query
def include_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.traverse(*_damaged(spark, sf_dir)).violations()


@query
def duplicate_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.traverse(*_damaged(spark, sf_dir)).duplicates()


@query
def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include lines with the path they come to, and what is wrong with it."""
    return includes.include_edges(*_damaged(spark, sf_dir)).select(
        "chain_id", "source", "written", "path", "code"
    )


@query
def missing_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.missing_includes(includes.include_edges(*_damaged(spark, sf_dir)))


@query
def compile_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_candidates(*_candidate_tables(spark, sf_dir))


def _candidate_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        given.conversation_candidates(spark, sf_dir),
        given.conversation_snippets(spark, sf_dir),
        given.conversation_bindings(spark, sf_dir),
    )


@query
def shadow_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.shadow_validation(
        given.stored(_tampered(spark, sf_dir)), *_candidate_tables(spark, sf_dir)
    )


@query
def commit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.commit_candidates(
        given.stored(_tampered(spark, sf_dir)), *_candidate_tables(spark, sf_dir)
    ).added


@query
def commit_then_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed candidates with the faults an audit of the longer log finds in them.

    The bodies of some are edited after the commit; only these may be faulty.
    """
    log = given.stored(_tampered(spark, sf_dir))
    added = given.stored(lifecycle.commit_candidates(log, *_candidate_tables(spark, sf_dir)).added)
    edited = F.when(F.col("chain_id") % 5 == 2, F.concat("body", F.lit("edited\n"))).otherwise(F.col("body"))
    longer = log.unionByName(added.withColumn("body", edited))
    found = log_violations(longer).select("chain_id", "version", "error_code")
    return (
        added.select("chain_id", "version")
        .join(found, ["chain_id", "version"], "left")
        .groupBy("chain_id", "version")
        .agg(F.array_join(F.array_sort(F.collect_list("error_code")), ",").alias("error_codes"))
    )


# Snapshots and change points


@query
def stamp_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.stamp_diff(
        given.order_stamps(spark, sf_dir, 1), given.order_stamps(spark, sf_dir, 2)
    )


@query
def snapshot_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_equality(
        given.order_stamps(spark, sf_dir, 1), given.order_stamps(spark, sf_dir, 2)
    )


@query
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(given.order_snapshots(spark, sf_dir))


@query
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.change_points(
        given.event_rows(spark, sf_dir).drop("value", "props"),
        ["user_id"], ["ts", "event_id"], "event_type",
    )


@query
def change_points_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream to which the events arrive in four parts of the time they span.

    The second and the fourth part come before the one they follow, so half of the rows are late. Between
    the parts the stream stops and goes on from its checkpoint.
    """
    columns = ["user_id", "ts", "event_id", "event_type"]
    events = given.event_rows(spark, sf_dir).select(*columns)
    source, root = fresh_path(spark, "arrivals"), fresh_path(spark, "detect")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    lateness = f"INTERVAL {int((last - first).total_seconds() / 2) + 1 if first else 0} SECONDS"
    detector = ChangeDetector(root, ["user_id"], ["ts", "event_id"], "event_type", lateness)
    cuts = [first + (last - first) * k / 4 for k in range(5)] if first else []
    for k in (1, 0, 3, 2) if first else ():
        begin, end = (F.lit(str(t)).cast(events.schema["ts"].dataType) for t in cuts[k:k + 2])
        upto = F.col("ts") <= end if k == 3 else F.col("ts") < end
        events.where((F.col("ts") >= begin) & upto).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        detector.start(stream, f"{root}/checkpoint", available_now=True).awaitTermination()
    return detector.points(spark, events.schema)


# Replay


def _event_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event log and the effects of its changes, out of one stored table."""
    rows = given.stored(chain.build_chain(given.event_changes(spark, sf_dir), ["key", "value"]))
    return rows.drop("key", "value"), given.event_effects(rows)


def _replay(
    spark: SparkSession, sf_dir: str, log: DataFrame, effects: DataFrame, chains: DataFrame | None = None
) -> lifecycle.Applied:
    return lifecycle.apply_pending(
        log,
        effects,
        given.event_state(spark, sf_dir, effects),
        given.event_applied(spark, sf_dir, log),
        given.event_targets(spark, sf_dir),
        chains=chains,
    )


@query
def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_writes(given.event_effects(given.event_changes(spark, sf_dir)))


@query
def rebuild_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, effects = _event_history(spark, sf_dir)
    return lifecycle.rebuild(log, effects, given.event_targets(spark, sf_dir), force=True).state


@query
def apply_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, *_event_history(spark, sf_dir)).state


@query
def apply_with_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after pending changes whose placeholders are not all bound: the good ones before them count."""
    name = F.when((F.col("chain_id") % 3 == 1) & (F.col("version") % 23 == 0), " :MISSING_NAME").otherwise(" :SCHEMA_NAME")
    changes = given.stored(given.event_changes(spark, sf_dir).withColumn("body", F.concat("body", name)))
    log, effects = given.stored(chain.build_chain(changes)), given.event_effects(changes)
    bindings = changes.select("chain_id").distinct().select(
        "chain_id", F.lit("SCHEMA_NAME").alias("name"), F.lit("main").alias("value")
    )
    return lifecycle.apply_pending(
        log, effects, given.event_state(spark, sf_dir, effects), given.event_applied(spark, sf_dir, log),
        given.event_targets(spark, sf_dir), bindings,
    ).state


@query
def apply_pending_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, *_event_history(spark, sf_dir)).applied


@query
def rebuild_vs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differs exactly where an altered history kept a target from being brought up."""
    log, effects = _event_history(spark, sf_dir)
    chains = lifecycle.checked_chains(log)
    rebuilt = lifecycle.rebuild(log, effects, given.event_targets(spark, sf_dir), force=True, chains=chains)
    return lifecycle.rebuild_vs_incremental(
        _replay(spark, sf_dir, log, effects, chains).state, rebuilt.state
    )


@query
def run_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State with the candidates on top; those that do not compile, or to nothing, leave the committed state."""
    effects = given.event_rows(spark, sf_dir).groupBy(F.col("user_id").alias("chain_id"), F.col("event_type").alias("key")).agg(
        F.max("value").alias("value")
    )
    replayed = _replay(spark, sf_dir, *_event_history(spark, sf_dir))
    return lifecycle.run_compiled_candidate(
        replayed, effects, given.event_candidates(spark, sf_dir), given.event_fragments(spark, sf_dir),
        given.event_bindings(spark, sf_dir),
    )


def _altered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event log, and what a clean rebuild says about a state that was changed by hand."""
    log, effects = _event_history(spark, sf_dir)
    applied = lifecycle.apply_pending(
        log, effects, given.altered_state(given.event_state(spark, sf_dir, effects)),
        given.event_applied(spark, sf_dir, log), given.event_targets(spark, sf_dir),
    )
    return log, given.stored(lifecycle.shadow_verdicts(applied, effects))


@query
def shadow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _altered(spark, sf_dir)[1]


@query
def commit_after_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made of the candidates whose checks hold and whose state is that of a rebuild; the others' first error."""
    log, verdicts = _altered(spark, sf_dir)
    done = lifecycle.commit_candidates(
        log, given.event_candidates(spark, sf_dir), given.event_fragments(spark, sf_dir),
        given.event_bindings(spark, sf_dir), verdicts,
    )
    refused = done.violations.groupBy("chain_id").agg(F.array_join(F.array_sort(F.collect_set("error_code")), ",").alias("error_codes"))
    names = ["chain_id", "version", "previous_hash", "hash", "error_codes"]
    added = done.added.withColumn("error_codes", F.lit(None).cast("string")).select(*names)
    nothing = [F.lit(None).cast("int").alias("version"), *[F.lit(None).cast("string").alias(c) for c in names[2:4]]]
    return added.unionByName(refused.select("chain_id", *nothing, "error_codes"))


@query
def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.replay_counts(apply_pending(spark, sf_dir))


@query
def apply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the event chains came in as a stream of change rows, in ten micro-batches.

    Each chain arrives in ten parts of its length; every seventh change comes a part late, so that
    later ones wait for it, and every eleventh comes once more in the next part.
    """
    changes = given.event_changes(spark, sf_dir).where("chain_id is not null")
    counted = changes.withColumn("n", F.count("*").over(Window.partitionBy("chain_id")))
    rows = given.stored(chain.build_chain(counted, ["key", "value", "n"]))
    part = F.floor((F.col("version") - 1) * 10 / F.col("n"))
    late, again = F.when(F.col("version") % 7 == 0, 1).otherwise(0), F.when(F.col("version") % 11 == 0, part + 1)
    parts = F.array_compact(F.array(part + late, again))
    arrivals = rows.withColumn("part", F.explode(F.transform(parts, lambda p: F.least(p, F.lit(9)))))
    source, root = fresh_path(spark, "changes"), fresh_path(spark, "apply")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(10):
        dealt = packed(arrivals.where(F.col("part") == k).select(*CHANGE_EVENTS.fieldNames())).repartition(files)
        unpacked(dealt).write.mode("append").option("compression", "zstd").parquet(source)
    stream = spark.readStream.schema(CHANGE_EVENTS).option("maxFilesPerTrigger", files).parquet(source)
    targets = rows.select(F.col("chain_id").alias("target_id"), "chain_id").distinct()
    job = ContinuousApply(root, given.stored(targets))
    job.start(stream, f"{root}/checkpoint", available_now=True).awaitTermination()
    return job.state(spark)


@query
def evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given.event_rows(spark, sf_dir)
    first = events.where("event_type in ('click', 'view')").select("event_id", "user_id")
    second = events.where("event_type = 'error'").select("event_id", "user_id", "props")
    third = events.where("event_type in ('signup', 'purchase')").select("event_id", "value", "user_id")
    return state.evolve_union(first, second, third)
