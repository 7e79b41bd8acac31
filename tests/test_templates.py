import pytest
from pyspark.sql import functions as F

from linkweave.functions.templates import interpolate, placeholder_refs, resolve, unresolved
from linkweave.operators.scripts import invalid_bindings, render, unknown_placeholders

VALUES = {"ABC": "1", "S": ":ABC", "_X9": "$0\\", "E": ""}


def bound(values):
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


RESOLVED = {
    "select * from :S.t": "select * from :ABC.t",
    ":ABClow": "1low",
    ":ABC:S": "1:ABC",
    "x::ABC :::ABC": "x::ABC :::ABC",
    ":ABC::S": "1::S",
    "':ABC' \":ABC\"": "':ABC' \"1\"",
    "'it''s :ABC' :ABC": "'it''s :ABC' 1",
    "-- :ABC\n:ABC": "-- :ABC\n1",
    "/* :ABC */:ABC": "/* :ABC */1",
    "/* /* */ :ABC */": "/* /* */ 1 */",
    "/*/ :ABC */ :ABC": "/*/ :ABC */ 1",
    "'open :ABC": "'open :ABC",
    "/* open :ABC": "/* open :ABC",
    "a - b / c : d :9 :abc :É": "a - b / c : d :9 :abc :É",
    ":_X9;:E;": "$0\\;;",
    "": "",
    "''':ABC'':ABC": "''':ABC'':ABC",
    "-":  "-", "/": "/", ":": ":",
    "-:ABC/:ABC": "-1/1",
    "'a'::ABC": "'a'::ABC",
    "':':ABC": "':'1",
}


def test_resolve(column):
    assert column(list(RESOLVED), resolve("x", bound(VALUES))) == list(RESOLVED.values())


def test_resolve_with_unknown_name_gives_nothing(column):
    assert column([":ABC :NOPE", "':NOPE'"], resolve("x", bound(VALUES))) == [None, "':NOPE'"]
    assert column([":B :NOPE :B :ABC"], unresolved("x", bound(VALUES))) == [["B", "NOPE"]]


def test_strict_resolve_ends_the_job(column):
    with pytest.raises(Exception, match="E36 unknown placeholder :NOPE"):
        column([":NOPE"], resolve("x", bound(VALUES), strict=True))


def test_refs_keep_order_and_repeats(column):
    assert column([":B 'x :C' :A -- :D\n:B"], placeholder_refs("x")) == [["B", "A", "B"]]


def test_long_texts_do_not_overflow(column):
    long = "select 'a''b' -- c\n" * 30_000 + ":ABC" + "''" * 50_000 + "\n" * 50_000
    assert column([long], resolve("x", bound(VALUES))) == [long.replace(":ABC", "1")]


SETTINGS = {
    "a": ("a", None), "": ("", None), "${A}": ("1", None), "x${A}y${A}$": ("x1y1$", None),
    "${E:-d}": ("", None), "${N:-d}": ("d", None), "${N:-}": ("", None), "${N:-a:-b}": ("a:-b", None),
    "${N}": (None, "E62"), "${}": (None, "E61"), "${:-x}": (None, "E61"), "${A": (None, "E60"),
    "$A $$": ("$A $$", None), "$${A}": ("$1", None), "${A}}": ("1}", None),
    "${N:-${A}}": (None, "E60"), "${A:-${A}}": ("1}", None), "${N}${": (None, "E62"),
    "${N:-$A}": ("$A", None), "${R}": ("${A}", None), "${A:b}": (None, "E62"),
}


def test_interpolate(column):
    variables = bound({"A": "1", "E": "", "R": "${A}"})
    got = column(list(SETTINGS), interpolate("x", variables))
    assert [tuple(g) for g in got] == list(SETTINGS.values())


def test_tables_of_scripts_and_bindings(spark):
    scripts = spark.createDataFrame(
        [(1, "a", ":X :Y :X"), (1, "b", "none"), (2, "a", ":X"), (3, "a", ":X")],
        "chain_id long, script_id string, text string",
    )
    bindings = spark.createDataFrame(
        [(1, "X", "x1"), (1, "Y", "y1"), (2, "Y", "y2"), (3, "X", "x3")],
        "chain_id long, name string, value string",
    )
    assert [tuple(r) for r in unknown_placeholders(scripts, bindings).collect()] == [(2, "a", "X")]
    rendered = {(r.chain_id, r.script_id): (r.rendered, r.error_code) for r in render(scripts, bindings).collect()}
    assert rendered == {
        (1, "a"): ("x1 y1 x1", None), (1, "b"): ("none", None),
        (2, "a"): (None, "E36"), (3, "a"): ("x3", None),
    }
    bad = spark.createDataFrame([(1, "x", ""), (1, "X-", ""), (1, None, ""), (1, "X", "")], "chain_id long, name string, value string")
    assert {r.name for r in invalid_bindings(bad).collect()} == {"x", "X-", None}
