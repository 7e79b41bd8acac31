import pytest
from pyspark.sql import functions as F

from linkweave.functions.paths import fold_path, include_literals, include_paths, include_refs, within
from linkweave.operators.includes import expand_includes, include_edges, missing_includes, traverse
from linkweave.plans.compile import compile_scripts

INC = "--! include "


def test_include_lines(column):
    cases = {
        f"{INC}a.sql": ["a.sql"],
        f" \t{INC} a b.sql \r\nx\n{INC}c": ["a b.sql", "c"],
        f"x {INC}a": [],
        "--! include\n--! include \n": [],
        f"'\n{INC}a\n'": ["a"],
        f"a\r{INC}b {INC}c": [],
        "": [],
    }
    assert column(list(cases), include_paths("x")) == list(cases.values())
    refs = column([f"a\n {INC}b \n\n{INC}c"], include_refs("x"))[0]
    assert [tuple(r) for r in refs] == [(2, "b"), (4, "c")]


def test_literals_surround_includes(column):
    text = f"a\n{INC}b\n{INC}c\nd"
    assert column([text, "x", f"{INC}b"], include_literals("x")) == [["a\n", "", "d"], ["x"], ["", ""]]


def test_paths(column):
    cases = {
        "a.sql": "fixtures/a.sql", "./b//c.sql": "fixtures/b/c.sql", "x/../a.sql": "fixtures/a.sql",
        "../current.sql": "current.sql", "../fixtures/a": "fixtures/a", "../../fixtures/a": None,
        "a/../../../fixtures/x": None, "/fixtures/a": None, "..": "",
    }
    assert column(list(cases), fold_path(F.lit("fixtures"), F.col("x"))) == list(cases.values())
    assert column(["fixtures/a", "fixtures", "fixturesx/a", None], within("x")) == [True, False, False, False]


def tables(spark, projects):
    """Roots and fragments of ``[(root, {path: text})]``, numbered as chains."""
    roots = [(i, root, texts[root]) for i, (root, texts) in enumerate(projects)]
    rows = [(i, p, t) for i, (_, texts) in enumerate(projects) for p, t in texts.items() if p.startswith("fixtures/")]
    return (
        spark.createDataFrame(roots, "chain_id long, root string, text string"),
        spark.createDataFrame(rows, "chain_id long, path string, text string"),
    )


EXPANDED = {
    "nested": ({
        "current.sql": f"-- top\n{INC}fixtures/users.sql\nselect 1;\n",
        "fixtures/users.sql": f"{INC}shared/base.sql\ncreate view v;",
        "fixtures/shared/base.sql": "create table t;\n",
    }, "-- top\ncreate table t;\ncreate view v;\nselect 1;\n"),
    "no include": ({"current.sql": "select 1;", "fixtures/a": "x"}, "select 1;"),
    "empty fragment": ({"current.sql": f"a\n{INC}fixtures/e\nb", "fixtures/e": ""}, "a\nb"),
    "missing line ends": ({
        "current.sql": f"{INC}fixtures/a\n{INC}fixtures/b", "fixtures/a": f"1\n{INC}c", "fixtures/b": "2",
        "fixtures/c": "3"}, "1\n3\n2\n"),
    "order of many": ({
        "current.sql": "".join(f"{INC}fixtures/{i}\n" for i in range(12)),
        **{f"fixtures/{i}": f"{i}" for i in range(12)}}, "".join(f"{i}\n" for i in range(12))),
    "up and down": ({
        "current.sql": f"{INC}fixtures/d/a", "fixtures/d/a": f"{INC}../b\nA", "fixtures/b": "B"}, "B\nA\n"),
}

FAULTY = {
    "duplicate": ({"current.sql": f"{INC}fixtures/a\n{INC}fixtures/./a", "fixtures/a": "x"}, ("E33", "fixtures/a")),
    "duplicate deep": ({
        "current.sql": f"{INC}fixtures/a\n{INC}fixtures/b", "fixtures/a": f"{INC}b", "fixtures/b": "x"},
        ("E33", "fixtures/b")),
    "cycle is a duplicate": ({
        "current.sql": f"{INC}fixtures/a", "fixtures/a": f"{INC}b", "fixtures/b": f"{INC}a"},
        ("E33", "fixtures/a")),
    "self": ({"current.sql": f"{INC}fixtures/a", "fixtures/a": f"{INC}a"}, ("E33", "fixtures/a")),
    "missing": ({"current.sql": f"{INC}fixtures/zz", "fixtures/a": "x"}, ("E34", "fixtures/zz")),
    "outside": ({"current.sql": f"{INC}other/a", "fixtures/a": "x"}, ("E35", "other/a")),
    "missing before duplicate": ({
        "current.sql": f"{INC}fixtures/a\n{INC}fixtures/a", "fixtures/a": f"{INC}b", "fixtures/b": f"{INC}zz"},
        ("E34", "fixtures/zz")),
    "late first visit is followed": ({
        # c is met at depth 1 first, but deeper and earlier in depth-first order.
        "current.sql": f"{INC}fixtures/a\n{INC}fixtures/c", "fixtures/a": f"{INC}b",
        "fixtures/b": f"{INC}c", "fixtures/c": f"{INC}../../x"}, ("E35", None)),
}


CYCLE = {"fixtures/a": f"{INC}b", "fixtures/b": f"{INC}a"}


@pytest.fixture(scope="module")
def outcomes(spark):
    """All projects in one traversal; they must not disturb each other."""
    cases = {**EXPANDED, **FAULTY}
    projects = [("current.sql", texts) for texts, _ in cases.values()] + [("fixtures/a", CYCLE)]
    expanded, faults = expand_includes(*tables(spark, projects))
    rows = expanded.collect() + faults.collect()
    assert len(rows) == len(projects)
    by_chain = {r.chain_id: tuple(r)[2:] for r in rows}
    return {name: by_chain[i] for i, name in enumerate([*cases, "root in a cycle"])}


@pytest.mark.parametrize("name", EXPANDED)
def test_expand(outcomes, name):
    assert outcomes[name] == (EXPANDED[name][1],)


@pytest.mark.parametrize("name", FAULTY)
def test_first_fault(outcomes, name):
    assert outcomes[name] == FAULTY[name][1]


def test_cycle_through_a_root_that_is_a_fragment(outcomes):
    assert outcomes["root in a cycle"] == ("E32", "fixtures/a")


def test_reports_over_all_fragments(spark):
    texts = {
        "current.sql": f"{INC}fixtures/a\n{INC}fixtures/b", "fixtures/a": f"{INC}b\n{INC}zz",
        "fixtures/b": "x", "fixtures/lonely": f"{INC}b",
    }
    inputs = tables(spark, [("current.sql", texts)])
    walk = traverse(*inputs)
    assert {r.path for r in walk.closure().collect()} == {"fixtures/a", "fixtures/b"}
    assert [tuple(r)[2:] for r in walk.duplicates().collect()] == [("fixtures/b", 2)]
    edges = include_edges(*inputs)
    assert [(r.source, r.path) for r in missing_includes(edges).collect()] == [("fixtures/a", "fixtures/zz")]


def test_compile_expands_then_resolves(spark):
    candidates = spark.createDataFrame(
        [(1, f"{INC}fixtures/a\nselect ':S' from :S.t"), (2, "select :NOPE"), (3, f"{INC}fixtures/b")],
        "chain_id long, body string")
    fragments = spark.createDataFrame([(1, "fixtures/a", "use :S;")], "chain_id long, path string, text string")
    bindings = spark.createDataFrame([(1, "S", "main")], "chain_id long, name string, value string")
    got = compile_scripts(candidates, fragments, bindings)
    assert {r.chain_id: (r.compiled, r.error_code) for r in got.collect()} == {
        1: ("use main;\nselect ':S' from main.t", None), 2: (None, "E36"), 3: (None, "E34"),
    }


def test_levels_write_what_is_new(spark, monkeypatch):
    """Two roots above one chain of fragments and a loop back: each place below a root is written once."""
    folders = []
    from linkweave.operators import includes as module
    monkeypatch.setattr(module, "fresh_path", lambda s, label, keep=module.fresh_path: folders.append(keep(s, label)) or folders[-1])
    depth = 12
    fragments = [(1, f"fixtures/f{i}.sql", f"{INC}f{i + 1}.sql\n" if i + 1 < depth else f"{INC}f3.sql\nend") for i in range(depth)]
    roots = spark.createDataFrame([(1, r, f"{INC}fixtures/f0.sql") for r in ("a.sql", "b.sql")], "chain_id long, root string, text string")
    walk = traverse(roots, spark.createDataFrame(fragments, "chain_id long, path string, text string"))
    assert walk.closure().count() == 2 * depth
    occurrences, firsts = folders[-2:]
    assert spark.read.parquet(firsts).count() == 2 * depth
    assert spark.read.parquet(occurrences).count() == 2 * (depth + 1)
    assert {r.error_code for r in walk.violations().collect()} == {"E33"}
