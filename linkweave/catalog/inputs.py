"""Chains, targets, candidates, scripts and snapshots derived from the given tables.

Every input is an expression over whole tables, so it grows with them. Faults are put in
by rule, for the checks to find; no rows are left out to make anything cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkweave.functions.text import packed, parse_version, unpacked, version_filename
from linkweave.operators.chain import build_chain
from linkweave.operators.ordered import with_order
from linkweave.operators.state import STATE_KEY
from linkweave.session import cut_lineage

FAMILY = 31  # parts per include project: a full binary tree of depth five


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chain_id"),
        (F.col("turn") + 1).cast("int").alias("version"),
        F.col("text").alias("body"),
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain per conversation, one change per turn."""
    return build_chain(conversation_bodies(spark, sf_dir))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a stored table, as logs are in use; for inputs that a query reads twice."""
    return cut_lineage(df, "input")


def tampered(log: DataFrame) -> DataFrame:
    """A conversation log with misnamed, missing, edited and relinked changes."""
    chain, version = F.col("chain_id"), F.col("version")
    filename = (
        F.when((chain % 17 == 0) & (version == 3), "v3.sql")
        .when((chain % 19 == 4) & (version >= 3), version_filename(version + 1))
        .otherwise(F.col("filename"))
    )
    changed = log.select(
        "chain_id",
        filename.alias("filename"),
        F.when((chain % 13 == 0) & (version == 1), F.lit("a" * 64))
        .otherwise(F.col("previous_hash")).alias("previous_hash"),
        F.when((chain % 11 == 0) & (version == 2), F.lit("b" * 64))
        .when(chain % 23 == 1, F.upper("hash"))
        .otherwise(F.col("hash")).alias("hash"),
        F.when((chain % 7 == 0) & (version == 2), F.concat("body", F.lit("edited\n")))
        .otherwise(F.col("body")).alias("body"),
    )
    return changed.withColumn("version", parse_version("filename"))


def _slots(bodies: DataFrame, slots: int) -> DataFrame:
    """``slots`` targets per chain."""
    return (
        bodies.groupBy("chain_id").agg(F.count("*").alias("links"))
        .select("chain_id", "links", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        .withColumn("target_id", F.col("chain_id") * slots + F.col("slot"))
    )


def conversation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(conversation_bodies(spark, sf_dir), 3).select("target_id", "chain_id")


def conversation_applied(spark: SparkSession, sf_dir: str, log: DataFrame) -> DataFrame:
    """Histories of 0 to 8 changes per target, some longer than their chain, some altered."""
    planned = (
        _slots(conversation_bodies(spark, sf_dir), 3)
        .withColumn("prefix", ((F.col("chain_id") + F.col("slot") * 2) % 9).cast("int"))
        .where("prefix > 0")
        .select("target_id", "chain_id", "slot", F.explode(F.sequence(F.lit(1), F.col("prefix"))).alias("version"))
    )
    log = log.select("chain_id", "version", "hash", "previous_hash")
    unknown = F.sha2(F.concat_ws(":", F.col("chain_id").cast("string"), F.col("version").cast("string")), 256)
    altered = ((F.col("chain_id") + F.col("slot")) % 7 == 3) & (F.col("version") == 2)
    return planned.join(log, ["chain_id", "version"], "left").select(
        "target_id",
        "chain_id",
        version_filename("version").alias("filename"),
        F.when(altered, F.lit("c" * 64)).otherwise(F.coalesce("hash", unknown)).alias("hash"),
        "previous_hash",
    )


def _whole_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of each conversation as one text, which is one value by definition."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("chain_id")).agg(
        F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("text")
    )


def _quoted(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def conversation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per chain around its whole text: blanked out, sound, or faulty."""
    text = F.col("text")
    kind = F.col("chain_id") % 6
    body = (
        F.when(kind == 0, F.concat(F.regexp_replace("text", r"[^ \n]", " "), F.lit("\n\t")))
        .when(kind == 1, F.concat(
            F.lit("insert into :SCHEMA_NAME.notes select '"), _quoted(text),
            F.lit("'::TEXT; -- :IGNORED\n")))
        .when(kind == 2, F.concat(F.lit("--! Hash: 0\n"), text))
        .when(kind == 3, F.concat(F.lit("select :MISSING_NAME, '"), _quoted(text), F.lit("'")))
        .when(kind == 4, F.lit("--! include fixtures/base.sql\nselect 1 as one"))
        .otherwise(F.concat(
            text,
            F.lit("\r\n--! include fixtures/../fixtures/sub/more.sql\r\n"
                  "select :SCHEMA_NAME.a from b\r\n")))
    )
    return _whole_conversations(spark, sf_dir).select("chain_id", body.alias("body"))


def conversation_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments per chain; the second is missing for some."""
    base = F.struct(
        F.lit("fixtures/base.sql").alias("path"),
        F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" */")).alias("text"),
    )
    more = F.when(
        F.col("chain_id") % 4 != 1,
        F.struct(
            F.lit("fixtures/sub/more.sql").alias("path"),
            F.lit("--! include ../base.sql\nselect :SCHEMA_NAME.x").alias("text"),
        ),
    )
    return _whole_conversations(spark, sf_dir).select(
        "chain_id", F.inline(F.array_compact(F.array(base, more)))
    )


def conversation_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_conversations(spark, sf_dir).select(
        "chain_id",
        F.lit("SCHEMA_NAME").alias("name"),
        F.concat(F.lit("app_"), F.col("chain_id").cast("string")).alias("value"),
    )


def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per document, its whole text inside a string and inside a comment."""
    missing = F.when(F.col("n_chars") % 10 == 0, F.lit(" where x = :MISSING_1x")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chain_id"),
        F.lit("load").alias("script_id"),
        F.concat(
            F.lit("-- :LANG from "), F.col("source"),
            F.lit("\ninsert into :TARGET_SCHEMA.docs select :DOC_ID::BIGINT, '"),
            _quoted(F.col("text")),
            F.lit("', \":LANG\", a:::B /* :NOPE "),
            F.replace("text", F.lit("*/"), F.lit("")),
            F.lit(" */"), missing, F.lit(";\n"),
        ).alias("text"),
    )


def document_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def binding(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chain_id"),
        F.inline(F.array(
            binding("TARGET_SCHEMA", F.concat(F.lit("lang_"), "lang")),
            binding("DOC_ID", F.col("doc_id").cast("string")),
            binding("LANG", F.col("lang")),
        )),
    )


def customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting per customer in one of seven shapes, with the customer's variables."""
    kind = F.col("c_custkey") % 7
    setting = (
        F.when(kind == 0, F.lit("${NAME}/${SEGMENT:-x}"))
        .when(kind == 1, F.lit("a${EMPTY:-default}b$"))
        .when(kind == 2, F.lit("${UNSET:-d${NAME}"))
        .when(kind == 3, F.lit("${NAME}${UNSET}${"))
        .when(kind == 4, F.lit("{${:-x}}"))
        .when(kind == 5, F.lit("x${NAME"))
        .otherwise(F.lit("$${NAME:-a:-b}}${UNSET:-c:-d}$x"))
    )
    variables = F.create_map(
        F.lit("NAME"), F.col("c_name"), F.lit("SEGMENT"), F.col("c_mktsegment"),
        F.lit("EMPTY"), F.lit(""),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", setting.alias("setting"), variables.alias("variables")
    )


def part_fragments(spark: SparkSession, sf_dir: str, damaged: bool) -> DataFrame:
    """Fragments of include projects: 31 parts each, part *i* including 2i+1 and 2i+2."""
    part = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / FAMILY).alias("chain_id"),
        (F.col("p_partkey") % FAMILY).alias("local"),
        "p_partkey", "p_name", "p_type", "p_size",
    )
    deep = F.col("local") >= 15
    name = F.concat(F.when(deep, "deep/n").otherwise("n"), F.col("local").cast("string"), F.lit(".sql"))
    children = (
        part.where("local > 0")
        .select("chain_id", F.floor((F.col("local") - 1) / 2).alias("parent"), "local",
                F.concat(F.lit("--! include "), name, F.lit("\n")).alias("line"))
        .groupBy("chain_id", F.col("parent").alias("local"))
        .agg(F.array_sort(F.collect_list(F.struct("local", "line"))).alias("lines"))
        .select("chain_id", "local",
                F.array_join(F.transform("lines", lambda c: c["line"]), "").alias("includes"))
    )
    fault = F.lit("")
    if damaged:
        fault = (
            F.when(F.col("p_size") == 1,
                   F.concat(F.lit("\t--! include "), F.when(deep, "../n0.sql").otherwise("n0.sql"), F.lit(" \r\n")))
            .when(F.col("p_size") == 2, F.lit("--! include ./missing.sql\n"))
            .when(F.col("p_size") == 3, F.lit("--! include ../../current.sql\n"))
            .otherwise("")
        )
    text = F.concat(
        F.lit("-- "), F.col("p_name"), F.lit("\n"),
        F.coalesce("includes", F.lit("")), fault,
        F.lit("insert into parts values ("), F.col("p_partkey").cast("string"),
        F.lit(", '"), F.col("p_type"), F.lit("');"),
        F.when(F.col("p_size") % 2 == 0, "\n").otherwise(""),
    )
    return part.join(children, ["chain_id", "local"], "left").select(
        "chain_id", F.concat(F.lit("fixtures/"), name).alias("path"), text.alias("text")
    )


def part_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(F.floor(F.col("p_partkey") / FAMILY).alias("chain_id"))
        .distinct()
        .select(
            "chain_id",
            F.lit("current.sql").alias("root"),
            F.lit("begin;\n--! include fixtures/n0.sql\ncommit;").alias("text"),
        )
    )


def order_stamps(spark: SparkSession, sf_dir: str, snapshot: int) -> DataFrame:
    """Two snapshots of one stamp per order; orders come, go and change between them."""
    key = F.col("o_orderkey")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    size = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = table(spark, sf_dir, "orders").select(
        F.lit(snapshot).cast("bigint").alias("snapshot_id"),
        F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit("/"), key.cast("string")).alias("path"),
        millis.alias("modified_ms"),
        size.alias("size"),
        "o_orderkey", "o_orderpriority", "o_orderstatus",
    )
    if snapshot == 1:
        seen = orders.where("o_orderpriority <> '1-URGENT' or o_orderstatus <> 'O'")
    else:
        seen = orders.where("o_orderpriority <> '5-LOW' or o_orderstatus <> 'F'").withColumn(
            "modified_ms", F.when(key % 10 == 0, F.col("modified_ms") + 1).otherwise(F.col("modified_ms"))
        ).withColumn("size", F.when(key % 15 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return seen.select("snapshot_id", "path", "modified_ms", "size")


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven snapshots of one stamp per order; between some of them nothing changes."""
    key, k = F.col("o_orderkey"), F.col("snapshot_id")
    orders = table(spark, sf_dir, "orders").withColumn(
        "snapshot_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 3, 4, 6, 7, 8)]))
    )
    left_out = ((k >= 4) & (F.col("o_orderpriority") == "5-LOW")) | ((k < 8) & (key % 100 == 0))
    return orders.where(~left_out).select(
        "snapshot_id",
        F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit("/"), key.cast("string")).alias("path"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.when((k >= 3) & (key % 10 == 0), 1).otherwise(0)).alias("modified_ms"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") + F.when((k >= 6) & (key % 15 == 0), 1).otherwise(0)).alias("size"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type", "value", "props"
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event in its user's chain, numbered by time."""
    placed = with_order(event_rows(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return placed.select(
        F.col("user_id").alias("chain_id"),
        F.col("position").cast("int").alias("version"),
        F.concat_ws(" ", "event_type", "props").alias("body"),
        F.col("event_type").alias("key"),
        "value",
    )


def event_effects(changes: DataFrame) -> DataFrame:
    return changes.select("chain_id", "version", "key", "value")


def _event_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets per user: half applied, all applied, nothing applied."""
    bodies = event_rows(spark, sf_dir).select(F.col("user_id").alias("chain_id"))
    prefix = (
        F.when(F.col("slot") == 0, F.floor(F.col("links") / 2))
        .when(F.col("slot") == 1, F.col("links"))
        .otherwise(F.lit(0))
    )
    return _slots(bodies, 3).withColumn("prefix", prefix.cast("bigint"))


def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_slots(spark, sf_dir).select("target_id", "chain_id")


def event_applied(spark: SparkSession, sf_dir: str, log: DataFrame) -> DataFrame:
    """What the targets have applied; in some the first recorded hash was altered."""
    planned = _event_slots(spark, sf_dir).where("prefix > 0").select(
        "target_id", "chain_id", "slot",
        F.explode(F.sequence(F.lit(1), F.col("prefix").cast("int"))).alias("version"),
    )
    altered = (F.col("chain_id") % 10 == 3) & (F.col("slot") == 0) & (F.col("version") == 1)
    # The written out versions are many more than Spark takes them for: no broadcast.
    return unpacked(planned.hint("merge").join(
        packed(log.select("chain_id", "version", "filename", "hash", "previous_hash")),
        ["chain_id", "version"],
    )).select(
        "target_id", "chain_id", "filename",
        F.when(altered, F.lit("b" * 64)).otherwise(F.col("hash")).alias("hash"),
        "previous_hash",
    )


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per user: it includes a fragment, and uses an unknown name if a value is above 200."""
    lines = F.when(F.col("top") > 200, ", :MISSING_NAME").otherwise("")
    per_user = event_rows(spark, sf_dir).groupBy(F.col("user_id").alias("chain_id")).agg(F.max("value").alias("top"))
    return per_user.select(
        "chain_id",
        F.when(F.col("chain_id") % 20 == 6, F.lit(" \n"))
        .otherwise(F.concat(F.lit("--! include fixtures/base.sql\nselect :SCHEMA_NAME"), lines)).alias("body"),
    )


def event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragment of each user's candidate; some have none."""
    users = event_rows(spark, sf_dir).select(F.col("user_id").alias("chain_id")).distinct()
    return users.where("chain_id % 20 <> 5").select(
        "chain_id", F.lit("fixtures/base.sql").alias("path"), F.lit("-- base of :IGNORED").alias("text")
    )


def event_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = event_rows(spark, sf_dir).select(F.col("user_id").alias("chain_id")).distinct()
    return users.select("chain_id", F.lit("SCHEMA_NAME").alias("name"), F.lit("main").alias("value"))


def altered_state(state: DataFrame) -> DataFrame:
    """A state in which someone changed the clicks of some chains by hand."""
    touched = (F.col("chain_id") % 9 == 2) & (F.col("key") == "click")
    return state.withColumn("value", F.when(touched, F.col("value") + 1).otherwise(F.col("value")))


def event_state(spark: SparkSession, sf_dir: str, effects: DataFrame) -> DataFrame:
    """The state the applied changes left behind; the effects are too many to be broadcast, whatever their files compress to."""
    written = (
        _event_slots(spark, sf_dir)
        .where("prefix > 0")
        .select("target_id", "chain_id", "prefix")
        .join(effects.hint("merge"), "chain_id")
        .where("version <= prefix")
    )
    return written.groupBy(*STATE_KEY).agg(
        F.max("version").alias("version"), F.max_by("value", "version").alias("value")
    )
