import pytest
from pyspark.sql import functions as F

from linkweave.functions.headers import candidate_error, parse_change, render_change

A, B = "a" * 64, "b" * 64

CASES = {
    "plain": (f"--! Previous: {A}\n--! Hash: {B}\n\nselect 1;\n", (A, B, "select 1;\n", None)),
    "empty previous": (f"--! Previous: \n--! Hash: {B}\n\nselect 1;", (None, B, "select 1;\n", None)),
    "no previous": (f"--! Hash: {B}\n\nselect 1;", (None, B, "select 1;\n", None)),
    "other order": (f"--! Hash: {B}\n--! Previous: {A}\n\nselect 1;", (A, B, "select 1;\n", None)),
    "upper case": (f"--! Previous: {A.upper()}\n--! Hash: {B.upper()}\n\nx", (A, B, "x\n", None)),
    "no blank line": (f"--! Hash: {B}\nselect 1;", (None, B, "select 1;\n", None)),
    "white line starts body": (f"--! Hash: {B}\n \n--! Hash: {A}\nx", (None, B, f"--! Hash: {A}\nx\n", None)),
    "header lines in body": (f"--! Hash: {B}\n\nx\n--! Hash: 1\n", (None, B, "x\n--! Hash: 1\n", None)),
    "crlf": (f"--! Hash: {B}\r\n\r\na\r\nb\r\n", (None, B, "a\nb\n", None)),
    "spaces around": (f"--!  Hash :\t{B}  \n\nx", (None, B, "x\n", None)),
    "empty previous twice": (f"--! Previous:\n--! Previous: {A}\n--! Hash: {B}\nx", (A, B, "x\n", None)),
    "E03": (f"--! Previous: \n\n--! Hash: {B}\nx", "E03"),
    "E04": (f"--! Hash {B}\n\nx", "E04"),
    "E04 bare": (f"--! \n--! Hash: {B}\n\nx", "E04"),
    "E05": (f"--! Previous: {A}\n--! Previous:\n--! Hash: {B}\nx", "E05"),
    "E06": (f"--! Previous: 12\n--! Hash: {B}\nx", "E06"),
    "E07": (f"--! Hash: {B}\n--! Hash: 1\nx", "E07"),
    "E08": ("--! Hash: \n\nx", "E08"),
    "E09": (f"--! hash: {B}\n\nx", "E09"),
    "E10": ("select 1;", "E10"),
    "E10 indented": (f" --! Hash: {B}\n\nx", "E10"),
    "E10 blank": ("", "E10"),
    "E10 leading break": (f"\n--! Hash: {B}\n\nx", "E10"),
    "E11": (f"--! Hash: {B}\n\n \n", "E11"),
    "E11 at end": (f"--! Hash: {B}", "E11"),
    "E11 before E12": ("--! Previous: \n\n", "E11"),
    "E12": (f"--! Previous: {A}\n\nx", "E12"),
    "first faulty header wins": (f"--! Hash: 1\n--! Other: 2\n\n--! Hash: {B}", "E08"),
    "header fault before late header": ("--! Other: 2\n\n--! Hash: 1", "E09"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in CASES.items()], "name string, x string")
    return {r.name: r.p for r in rows.select("name", parse_change("x").alias("p")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_parse(parsed, name):
    expected = CASES[name][1]
    got = parsed[name]
    if isinstance(expected, str):
        assert tuple(got) == (None, None, None, expected)
    else:
        assert tuple(got) == expected


def test_render_is_the_golden_text_and_parses_back(spark):
    row = (
        spark.createDataFrame([("create table users (id integer primary key);",)], "body string")
        .withColumn("text", render_change(F.lit(None), F.lit(A), F.col("body")))
        .withColumn("p", parse_change("text"))
        .first()
    )
    assert row.text == (
        f"--! Previous: \n--! Hash: {A}\n\ncreate table users (id integer primary key);\n"
    )
    assert tuple(row.p) == (None, A, "create table users (id integer primary key);\n", None)


def test_candidate_guard(column):
    cases = {
        "": "E30", " \n": "E30", "select 1;": None, "--! Hash: 1\nx": "E31", "x\n--! y": "E31",
        "  --! y": "E31", "x\n --! y": None, "--!x": None, "x\r\n--! y": "E31", "--! include": "E31",
    }
    assert column(list(cases), candidate_error("x")) == list(cases.values())
