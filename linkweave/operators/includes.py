"""Fragments including fragments: closure, faults, and the expanded text.

Roots are ``(chain_id, root, text)`` rows and fragments ``(chain_id, path, text)`` rows.
The traversal moves narrow rows only; text joins in once, when it is known what goes where.

Every occurrence of a fragment below a root has a key: the array of places on the way
down to it. Comparing keys is comparing depth-first positions. The literal stretches of a
text take the even places, its includes the odd ones between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window, functions as F

from linkweave.functions.paths import (
    INCLUDE_LINE, fold_path, include_literals, include_paths, parent_folder, within,
)
from linkweave.session import cut_lineage, fresh_path

ROOT = ["chain_id", "root"]
OCCURRENCE = [*ROOT, "key", "source", "path", "code"]


def include_edges(roots: DataFrame, fragments: DataFrame) -> DataFrame:
    """All include lines: ``(chain_id, source, place, path, code)``.

    ``code`` is E35 for a path that leaves the fragment folder and E34 for one nothing
    is stored under.
    """
    # A root below the fragment folder is among the fragments already.
    outside = roots.where(~within("root"))
    texts = outside.select("chain_id", F.col("root").alias("source"), "text").unionByName(
        fragments.select("chain_id", F.col("path").alias("source"), "text")
    )
    lines = texts.select(
        "chain_id",
        "source",
        F.posexplode(include_paths("text")).alias("index", "written"),
    ).select(
        "chain_id",
        "source",
        (F.col("index") * 2 + 1).alias("place"),
        "written",
        fold_path(parent_folder("source"), "written").alias("path"),
    )
    stored = fragments.select("chain_id", "path", F.lit(True).alias("stored"))
    return lines.join(stored, ["chain_id", "path"], "left").select(
        "chain_id",
        "source",
        "place",
        "written",
        "path",
        F.when(~within("path"), "E35").when(F.col("stored").isNull(), "E34").alias("code"),
    )


def missing_includes(edges: DataFrame) -> DataFrame:
    """Include lines that name a fragment which does not exist."""
    return edges.where("code = 'E34'").select("chain_id", "source", "path")


@dataclass
class Traversal:
    """What was found below the roots."""

    occurrences: DataFrame  # chain_id, root, key, source, path, code
    edges: DataFrame

    def closure(self) -> DataFrame:
        """Distinct fragments below each root."""
        return self.occurrences.where("code is null").select(*ROOT, "path").distinct()

    def duplicates(self) -> DataFrame:
        """Fragments that the root and its fragments name more than once, with the count."""
        starts = self.occurrences.select(*ROOT, F.col("root").alias("source")).distinct()
        members = self.closure().select(*ROOT, F.col("path").alias("source"))
        return (
            starts.unionByName(members.where("source <> root"))
            .join(self.edges.where("code is null"), ["chain_id", "source"])
            .select(*ROOT, "path")
            .groupBy(*ROOT, "path")
            .agg(F.count("*").alias("uses"))
            .where("uses > 1")
        )

    def violations(self) -> DataFrame:
        """Per faulty root, the fault that comes first in depth-first order."""
        repeat = Window.partitionBy(*ROOT, "path").orderBy("key")
        again = (
            self.occurrences.where("code is null")
            .withColumn("nth", F.row_number().over(repeat))
            .where("nth <= 2")
            .where((F.col("nth") == 2) | (F.col("path") == F.col("root")))
            .withColumn("code", F.when(F.col("path") == F.col("root"), "E32").otherwise("E33"))
        )
        faults = self.occurrences.where("code is not null").unionByName(again.drop("nth"))
        first = F.min(F.struct("key", "code", "path"))
        return (
            faults.groupBy(*ROOT)
            .agg(first.alias("first"))
            .select(*ROOT, F.col("first.code").alias("error_code"), "first.path")
        )


def traverse(roots: DataFrame, fragments: DataFrame) -> Traversal:
    """Follow includes level by level until no root has anything new below it.

    A repeated fragment is followed again only from a place that comes earlier in
    depth-first order than any before. That ends cycles and keeps the work per root at
    its number of fragments, yet everything ahead of a root's first fault is seen.

    A level writes its occurrences and, of these, the places that are new or earlier than before; nothing that
    earlier levels wrote is written again. Its places are looked up in the earlier ones by (root, path).
    """
    edges = cut_lineage(include_edges(roots, fragments), "edges")
    frontier = roots.select(
        *ROOT, F.array().cast("array<int>").alias("key"), F.col("root").alias("path")
    )
    spark, place = roots.sparkSession, fresh_path(roots.sparkSession, "occurrences")
    firsts, depth = fresh_path(spark, "first-places"), 0
    while True:
        found = (
            frontier.withColumnRenamed("path", "source")
            .join(edges, ["chain_id", "source"])
            .select(
                *ROOT, F.array_append("key", F.col("place")).alias("key"), "source", "path", "code"
            )
        )
        rows = Observation()
        observed = found.observe(rows, F.count(F.lit(1)).alias("rows"))
        observed.write.parquet(f"{place}/depth={depth}")
        if not rows.get["rows"]:
            break
        level = spark.read.schema(found.schema).parquet(f"{place}/depth={depth}")
        places = _earlier_places(level, spark.read.schema(frontier.schema).parquet(firsts) if depth else None)
        places.write.parquet(f"{firsts}/depth={depth}")
        frontier = spark.read.schema(frontier.schema).parquet(f"{firsts}/depth={depth}")
        depth += 1
    # One table of all levels, however many there are.
    return Traversal(spark.read.schema(found.schema).parquet(place).select(*OCCURRENCE), edges)


def _earlier_places(level: DataFrame, before: DataFrame | None) -> DataFrame:
    """The first place in ``level`` of each fragment that has none in ``before``, or only later ones.

    Faulty places and the root itself are not followed.
    """
    columns = [*ROOT, "key", "path"]
    found = level.where("code is null and path <> root").groupBy(*ROOT, "path").agg(F.min("key").alias("key"))
    if before is None:
        return found.select(*columns)
    known = (
        before.join(found.select(*ROOT, "path"), [*ROOT, "path"], "left_semi")
        .groupBy(*ROOT, "path").agg(F.min("key").alias("known"))
    )
    return found.join(known, [*ROOT, "path"], "left").where("known is null or key < known").select(*columns)


def expand_includes(roots: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expanded roots ``(chain_id, root, text)`` and the faults of those left out."""
    nested = roots.where(F.col("text").rlike(INCLUDE_LINE))
    flat = roots.where(~F.col("text").rlike(INCLUDE_LINE))
    walk = traverse(nested, fragments)
    faults = walk.violations()
    sound = nested.join(faults, ROOT, "left_anti")

    places = (
        walk.occurrences.where("code is null")
        .join(faults, ROOT, "left_anti")
        .select(*ROOT, "key", "path")
        .join(fragments.select("chain_id", "path", "text"), ["chain_id", "path"])
        .select(*ROOT, "key", "text", F.lit(False).alias("is_root"))
        .unionByName(
            sound.select(
                *ROOT, F.array().cast("array<int>").alias("key"), "text",
                F.lit(True).alias("is_root"),
            )
        )
    )
    pieces = places.select(
        *ROOT, "key", "is_root", include_literals("text").alias("literals")
    ).select(
        *ROOT, "key", "is_root",
        F.size("literals").alias("n"),
        F.posexplode("literals").alias("index", "piece"),
    )
    unfinished = (
        ~F.col("is_root")
        & (F.col("index") == F.col("n") - 1)
        & (F.col("piece") != "")
        & ~F.col("piece").endswith("\n")
    )
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.array_append("key", F.col("index") * 2).alias("place"),
                F.when(unfinished, F.concat("piece", F.lit("\n"))).otherwise(F.col("piece")).alias("piece"),
            )
        )
    )
    expanded = pieces.groupBy(*ROOT).agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text")
    )
    return flat.select(*ROOT, "text").unionByName(expanded), faults
