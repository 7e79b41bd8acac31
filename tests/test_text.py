import hashlib

from pyspark.sql import functions as F

from linkweave.functions import text as T

GOLDEN = "25f048318278a4e1670bffb6bdd9de29acec798dcb8e00bff69ac48ec3dfdb3c"


def test_normalize_trims_unicode_and_ends_with_one_break(column):
    cases = {
        " select 1; \n\n": "select 1;\n",
        "　 a b\u0085": "a b\n",
        " \r\n\t ": "",
        "": "",
        "a​": "a​\n",
        "﻿a": "﻿a\n",
    }
    assert column(list(cases), T.normalize("x")) == list(cases.values())
    assert column([None], T.normalize("x")) == [None]


def test_every_white_space_code_point_is_trimmed(column):
    points = list(T.WHITE_SPACE)
    assert len(points) == 25
    assert set(column([f"{p}x{p}" for p in points], T.trim_space("x"))) == {"x"}


def test_golden_hash(column):
    assert column(["select 1;", " select 1;\n\n"], T.link_hash(F.lit(None), F.col("x"))) == [GOLDEN] * 2


def test_hash_covers_the_previous_hash(column):
    expected = hashlib.sha256(f"{GOLDEN}\nselect 2;\n".encode()).hexdigest()
    assert column(["select 2;"], T.link_hash(F.lit(GOLDEN), F.col("x"))) == [expected]


def test_hash_matches_in_either_case(column):
    upper = T.hash_matches(F.lit(None), F.upper(F.lit(GOLDEN)), F.col("x"))
    assert column(["select 1;", "select 2;"], upper) == [True, False]


def test_valid_hash(column):
    cases = ["a" * 64, "A" * 64, "a" * 63, "a" * 65, "g" * 64, "a" * 64 + "\n", "١" * 64, ""]
    assert column(cases, T.is_valid_hash("x")) == [True, True] + [False] * 6


def test_version_from_filename(column):
    cases = {
        "000001.sql": 1, "999999.sql": 999999, "000000.sql": 0, "1.sql": None, "0000001.sql": None,
        "00000a.sql": None, "000001.SQL": None, "000001.sql ": None, "+00001.sql": None, "000001": None,
    }
    assert column(list(cases), T.parse_version("x")) == list(cases.values())


def test_names(column):
    names = ["abc", "_A9", "9a", "", "a-b", "a b", "A_1", "éa", 'a"b']
    assert column(names, T.is_identifier("x")) == [True, True, False, False, False, False, True, False, False]
    assert column(names, T.is_binding_name("x")) == [False, True, False, False, False, False, True, False, False]
    assert column(['a"b'], T.quote_ident("x")) == ['"a""b"']


def test_status_code(spark):
    rows = spark.createDataFrame(
        [(p, c) for p in (False, True) for c in (False, True)], "p boolean, c boolean"
    ).select(T.status_code("p", "c").alias("code"))
    assert [r.code for r in rows.collect()] == [0, 2, 1, 3]


def test_has_changes_counts_comments(column):
    assert column([" \n", "-- note", ""], T.has_changes("x")) == [False, True, False]


def test_packed_digests_come_back(spark):
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:63], digest + "0", digest + "\n", digest[:63] + "g", "", "x" * 31, "\0" * 33, "é", None]
    texts += [bytes.fromhex(digest).decode("latin-1"), "a" * 64, "f" * 64]
    rows = spark.createDataFrame([(i, t, texts[-i]) for i, t in enumerate(texts)], "i int, hash string, previous_hash string")
    assert sorted(map(repr, T.unpacked(T.packed(rows)).collect())) == sorted(map(repr, rows.collect()))
    assert T.packed(rows).select("hash").distinct().count() == len(texts)
    assert T.packed(rows).where("length(hash) = 32").count() == 3
