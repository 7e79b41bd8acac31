import hashlib

import pytest
from pyspark.sql import functions as F

from linkweave.functions.headers import render_change
from linkweave.operators import chain
from linkweave.operators.violations import first_violation, uniqueness_violations
from linkweave.plans.audit import log_violations
from linkweave.sources.files import change_log, parse_changes, parse_violations

BODIES = "chain_id long, version int, body string"


def links(bodies):
    head, out = None, []
    for body in bodies:
        previous = head
        head = hashlib.sha256(f"{previous or ''}\n{body.strip()}\n".encode()).hexdigest()
        out.append((previous, head))
    return out


@pytest.fixture(scope="module")
def log(spark):
    rows = [(c, v, f"select {c}, {v};") for c in (1, 2, 3) for v in range(1, 6)]
    return chain.build_chain(spark.createDataFrame(rows, BODIES))


def codes(violations):
    return sorted((r.chain_id, r.filename, r.error_code) for r in violations.collect())


def test_long_and_short_chains_equal_a_loop(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        bodies = {7: [f"body {i} é" for i in range(1500)], 8: ["x"], 9: [" a \n", "b\r\nc"]}
        rows = [(c, i + 1, b) for c, bs in bodies.items() for i, b in reversed(list(enumerate(bs)))]
        df = spark.createDataFrame(rows, BODIES).repartition(8)
        built = chain.build_chain(df).collect()
        heads = {r.chain_id: tuple(r)[1:] for r in chain.fold_heads(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, bs in bodies.items():
        got = [(r.previous_hash, r.hash) for r in sorted(built, key=lambda r: r.version) if r.chain_id == c]
        assert got == links(bs)
        assert heads[c] == (len(bs), len(bs), got[-1][1])
    assert {r.filename for r in built if r.chain_id == 9} == {"000001.sql", "000002.sql"}


def test_sound_chain_has_no_violations(log):
    assert codes(log_violations(log)) == []


@pytest.mark.parametrize("version", [1, 3, 5])
def test_one_edited_character_is_found_at_its_version(log, version):
    hit = (F.col("chain_id") == 2) & (F.col("version") == version)
    edited = log.withColumn("body", F.when(hit, F.translate("body", ";", ".")).otherwise(F.col("body")))
    assert codes(log_violations(edited)) == [(2, f"{version:06}.sql", "E13")]


def test_gap(log):
    short = log.where("not (chain_id = 1 and version = 1)")
    found = codes(log_violations(short))
    assert (1, "000002.sql", "E14") in found and (1, "000002.sql", "E15") in found
    assert [tuple(r) for r in first_violation(log_violations(short)).collect()] == [(1, "000002.sql", "E14")]


def test_copies_count_as_places(log):
    doubled = log.unionByName(log.where("chain_id = 1 and version = 2"))
    assert codes(log_violations(doubled)) == [
        (1, "000002.sql", "E17"), (1, "000003.sql", "E14"), (1, "000004.sql", "E14"), (1, "000005.sql", "E14"),
    ]


def test_genesis_with_previous_hash(log):
    changed = log.withColumn(
        "previous_hash", F.when(F.col("version") == 1, F.lit("c" * 64)).otherwise(F.col("previous_hash"))
    )
    assert {r.chain_id for r in chain.genesis_violations(changed).collect()} == {1, 2, 3}
    assert chain.genesis_violations(log).isEmpty()


def test_broken_link_is_seen_even_when_hashes_hold(spark, log):
    relinked = log.withColumn(
        "previous_hash", F.when((F.col("chain_id") == 3) & (F.col("version") == 4), None).otherwise(F.col("previous_hash"))
    )
    assert [(r.chain_id, r.position) for r in chain.broken_links(relinked).collect()] == [(3, 4)]
    assert (3, "000004.sql", "E16") in codes(log_violations(relinked))


def test_bad_name_comes_first_for_its_file(log):
    renamed = log.withColumn("filename", F.when(F.col("version") == 2, "000002.sq").otherwise(F.col("filename")))
    first = {tuple(r) for r in first_violation(log_violations(renamed)).collect()}
    assert first == {(c, "000002.sq", "E01") for c in (1, 2, 3)}


def test_heads_latest_and_next(log):
    heads = {r.chain_id: (r.links, r.head_version) for r in chain.chain_heads(log).collect()}
    assert heads == {c: (5, 5) for c in (1, 2, 3)}
    assert {(r.chain_id, r.body) for r in chain.latest_change(log).collect()} == {
        (c, f"select {c}, 5;\n") for c in (1, 2, 3)
    }
    assert {r.next_version for r in chain.next_versions(log).collect()} == {6}


@pytest.mark.parametrize("links_, expected", [(999_998, (999_999, None)), (999_999, (None, "E37"))])
def test_sequence_limit(spark, links_, expected):
    row = chain.next_versions(spark.range(links_).select(F.lit(1).alias("chain_id"))).first()
    assert (row.next_version, row.error_code) == expected


def test_rendered_files_parse_back_to_the_log(log):
    files = log.select("chain_id", "filename", render_change(F.col("previous_hash"), F.col("hash"), F.col("body")).alias("text"))
    parsed = parse_changes(files)
    assert parse_violations(parsed).isEmpty()
    back = change_log(parsed)
    assert sorted(map(tuple, back.select(*log.columns).collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)


def test_crlf_file_keeps_its_hash(spark, log):
    files = log.select("chain_id", "filename", F.replace(
        render_change(F.col("previous_hash"), F.col("hash"), F.col("body")), F.lit("\n"), F.lit("\r\n")).alias("text"))
    assert log_violations(change_log(parse_changes(files))).isEmpty()


def test_uniqueness(spark):
    rows = [(1, "a", "h1"), (1, "a", "h2"), (1, "b", "h2"), (2, "a", None), (2, "b", "h1")]
    df = spark.createDataFrame(rows, "target_id long, filename string, hash string")
    got = uniqueness_violations(df, ["target_id"], ["filename", "hash"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [
        (1, "filename", "a", 2), (1, "hash", "h2", 2), (2, "hash", None, 1),
    ]))
