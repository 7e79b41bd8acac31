"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A target of r times the source's size means that
every document is certain to be taken floor(r) times; one more copy goes to documents chosen
with inclusion probability p = r - floor(r). For this choice documents are ranked by

    q = (u / (1 - u)) / (p / (1 - p)),    u a fixed random number of the document,

and taken in that order until the words reach what is left of the target (fixed size; the
document on the border is taken if that comes nearer). Sources differ in p; within a source p
is one number, so q is monotone in u and the order is simple random order by u.

The border is found without sorting a source: ranks, mapped to (0, 1), are counted in 4096
buckets, the bucket on the border is counted in 4096 parts again, and only the rows of one
such part are put in order, equal rows as one. What joins back to the documents is one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkweave.llm.common import global_row_numbers, unused
from linkweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 7
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def fixed_uniform(doc_id: Column, text_hash: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the id and the seed; without an id from the text, so that such rows do not share one."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text_hash.cast("string")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / float(2**48)


def _ranked(docs: DataFrame, id_col: str, source_col: str, text_col: str, names: Sequence[str], seed: int) -> DataFrame:
    """``docs`` with what a decision needs: no_source, source_key, size, u, text_hash (as ``names``)."""
    no_source, source_key, size, u, text_hash = names
    source = F.col(source_col).cast("string")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumns({
        no_source: source.isNull(),
        source_key: F.coalesce(source, F.lit("")),
        size: word_count(text_col),
        u: fixed_uniform(F.col(id_col), hashed, seed),
        text_hash: hashed,
    })


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``no_source, source_key, source_size`` with ``target``: shares of all sizes by weight.

    Weights repeat along the sources by code point, the null source last. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is
    above. Each round is one aggregation of the sources; three numbers come to the driver.
    """
    ordered, _ = global_row_numbers(sizes, ["no_source", "source_key"], "place", "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ordered = cut_lineage(ordered.withColumn("weight", weight.cast("bigint")), "weights")
    words = ordered.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    capped: Column = F.lit(False)
    full = F.col("source_size") * most
    before = -1
    while True:
        held = ordered.agg(
            F.count_if(capped), F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if held[0] == before or not held[2]:
            break
        before = held[0]
        level = (words - (held[1] or 0)) / held[2]
        capped = F.lit(level) * F.col("weight") > full
    target = F.when(capped, full.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ordered.select("no_source", "source_key", "source_size", target.alias("target"))


def source_cuts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per source: size, target, certain copies, and the rank of the last extra copy."""
    names = ["no_source", "source_key", "size", "u", "text_hash"]
    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    ranked = cut_lineage(_ranked(narrow, "doc_id", "source", "text", names, seed).select("doc_id", *names), "ranks")
    sizes = ranked.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = cut_lineage(
        source_targets(sizes, weights, most)
        .withColumn("copies", F.floor(ratio).cast("bigint"))
        .withColumn("chance", ratio - F.floor(ratio))
        .withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size")),
        "targets",
    )
    key = ["no_source", "source_key"]
    rows = ranked.join(targets.where("chance > 0").select(*key, "chance", "missing"), key).withColumn("v", _pareto())
    in_source = Window.partitionBy(*key).orderBy("bucket")

    def on_border(parts: DataFrame) -> DataFrame:
        """The bucket of each source where the words reach what is missing."""
        counted = parts.groupBy(*key, "bucket").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
        upto = counted.withColumn("upto", F.sum("words").over(in_source.rowsBetween(Window.unboundedPreceding, 0)))
        reached = upto.where("upto >= missing").groupBy(*key)
        return reached.agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("words_before")), "bucket").alias("b")).select(*key, "b.*")

    first = cut_lineage(on_border(rows.withColumn("bucket", F.floor(F.col("v") * BUCKETS))), "border")
    inner = (
        rows.withColumn("bucket", F.floor(F.col("v") * BUCKETS))
        .join(first, [*key, "bucket"])
        .withColumn("missing", F.col("missing") - F.col("words_before"))
        .drop("words_before", "bucket")
        .withColumn("bucket", F.floor(F.col("v") * (BUCKETS * BUCKETS)))
    )
    second = cut_lineage(on_border(inner), "border")
    # Rows equal in id and text are taken or left together, so they are one row here, however many there are.
    equal = ["v", "u", "doc_id", "size", "text_hash"]
    last = inner.join(second, [*key, "bucket"]).groupBy(*key, *equal).agg(
        F.sum("size").alias("together"), F.first("missing").alias("missing"), F.first("words_before").alias("words_before")
    )
    rank = F.struct("v", "u", "doc_id", "size", "text_hash")
    within = Window.partitionBy(*key).orderBy(*equal).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("words_before") + F.col("upto")
    nearer = (upto - F.col("missing")) <= (F.col("missing") - (upto - F.col("together")))
    last = last.withColumn("upto", F.sum("together").over(within))
    cuts = last.groupBy(*key).agg(F.max(F.when(nearer, rank)).alias("cut"))
    # Nothing taken in the last part: all ranks below its start still are.
    starts = second.select(*key, (F.col("bucket") / float(BUCKETS * BUCKETS)).alias("start"))
    return targets.join(starts, key, "left").join(cuts, key, "left")


def _pareto() -> Column:
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.col("chance")
    return odds / (1 + odds)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names: size, source_size, target, copies.

    Null and empty texts have size 0. Null is a source of its own, the last one. Rows equal
    in id and text share one rank and are taken or left together. Sources without words
    have target 0 and take nothing. An empty table gives no rows. The join brings one row
    per source to the documents.
    """
    names = unused(docs, "no_source", "source_key", "size", "u", "text_hash")
    no_source, source_key, size, u, text_hash = names
    cuts = cut_lineage(source_cuts(docs, weights, most, seed, id_col, source_col, text_col), "cuts")
    given = unused([*docs.columns, *names], "found")[0]
    found = cuts.select(
        F.col("no_source").alias(no_source), F.col("source_key").alias(source_key),
        F.struct("source_size", "target", "copies", "chance", "start", "cut").alias(given),
    )
    joined = _ranked(docs, id_col, source_col, text_col, names, seed).join(found, [no_source, source_key])
    chance = F.col(f"{given}.chance")
    odds = F.col(u) / (1 - F.col(u)) * (1 - chance) / chance
    v = odds / (1 + odds)
    rank = F.struct(
        v.alias("v"), F.col(u).alias("u"), F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(size).alias("size"), F.col(text_hash).alias("text_hash"),
    )
    cut, start = F.col(f"{given}.cut"), F.col(f"{given}.start")
    below = F.floor(v * (BUCKETS * BUCKETS)) / float(BUCKETS * BUCKETS) < start
    extra = F.when(chance <= 0, F.lit(False)).when(start.isNull(), F.lit(True)).otherwise(
        F.coalesce(rank <= cut, F.lit(False)) | below
    )
    out = unused(docs, "size", "source_size", "target", "copies")
    return (
        joined.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.col(size).alias(out[0]),
            F.col(f"{given}.source_size").alias(out[1]),
            F.col(f"{given}.target").alias(out[2]),
            (F.col(f"{given}.copies") + extra.cast("bigint")).alias(out[3]),
        ),
        out,
    )


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    rows, (_, _, _, copies) = mix(docs, **options)
    again = unused(rows, "again")[0]
    times = F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies).cast("int"))).otherwise(F.array())
    return rows.withColumn(again, F.explode(times.cast("array<int>"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``."""
    rows, (size, source_size, target, copies) = mix(docs.select("doc_id", "source", "text"), **options)
    return rows.select(
        "doc_id",
        F.col(size).alias("size"),
        F.col(source_size).alias("source_size"),
        F.col(target).alias("target"),
        (F.col(size) * F.col(copies)).alias("taken"),
    )


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3.0 / weight, source) AS k,
    sum(source_size * 3) OVER (ORDER BY source_size * 3.0 / weight, source) - source_size * 3 AS full_before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size * 3.0 / weight, source) + weight AS weight_after,
    sum(source_size) OVER () AS words
  FROM s
), l AS (
  SELECT (words - full_before)::DOUBLE / weight_after::DOUBLE AS level FROM o
  WHERE (words - full_before)::DOUBLE / weight_after::DOUBLE * weight <= source_size * 3 ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN level * weight > source_size * 3 THEN (source_size * 3)::DOUBLE ELSE level * weight END AS target
  FROM o, l
), r AS (
  SELECT d.doc_id, d.size, d.u, t.source, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, target - copies * source_size AS missing,
    sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM r
)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN missing > 0 AND upto - missing <= missing - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
