"""Code units, imports, names and small expressions."""

import pytest
from pyspark.sql import functions as F

from tabletrail.functions import numbers, text
from tabletrail.operators import lineage
from tabletrail.operators.names import name_lint
from tabletrail.sinks.manifests import merged, merged_records, unit_hash
from tabletrail.sources.catalog import Producer, code_units


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("from sample_pkg.work import summarize", ["sample_pkg.work", "sample_pkg.work.summarize"]),
        ("from sample_pkg import work", ["sample_pkg", "sample_pkg.work"]),
        ("import a.b as c, d", ["a.b", "d"]),
        ("from . import x\nfrom ..y import z", []),
        ("def f():\n    import inner", ["inner"]),
        ("this is not python (", []),
        (None, []),
    ],
)
def test_imported_names(code, names):
    assert lineage.imported_names(code) == names


def test_code_deps(spark):
    units = spark.createDataFrame(
        [(1, "from sample_pkg.work import summarize"), (2, "from sample_pkg import work"), (3, "import numpy\nfrom tabletrail import Project"), (4, "not python (")],
        "unit int, code string",
    )
    modules = spark.createDataFrame(
        [("sample_pkg", "sample_pkg/__init__.py", "a"), ("sample_pkg.work", "sample_pkg/work.py", "b"), ("numpy", ".venv/lib/site-packages/numpy/__init__.py", "c"),
         ("tabletrail", "tabletrail/__init__.py", "d"), ("os", "/usr/lib/os.py", "e")],
        "module string, path string, sha256 string",
    )
    got = sorted((r["unit"], r["path"]) for r in lineage.code_deps(units, ["unit"], modules).collect())
    assert got == [(u, p) for u in (1, 2) for p in ("sample_pkg/__init__.py", "sample_pkg/work.py")]


def test_code_units_keep_every_unnamed_one():
    source = "import x\n@x.cell\ndef _():\n    pass\n\ndef _():\n    return 1\n\ndef named():\n    pass\n"
    units = code_units(source)
    assert [n for n, _ in units] == ["_", "_", "named"]
    assert units[0][1] == "@x.cell\ndef _():\n    pass\n"
    assert code_units("def broken(") == [] and code_units(None) == []


def test_producer_of_a_function_matches_its_file():
    producer = Producer.of(test_code_units_keep_every_unnamed_one, "tests/test_lineage.py")
    units = dict(code_units(open(__file__).read()))
    assert unit_hash(units[producer.name]) == unit_hash(producer.code)


def test_code_hash_ignores_edges(spark):
    df = spark.createDataFrame([("x = 1\n",), ("x = 1",), ("\t  x = 1\r\n",), ("x = 2",)], "c string")
    hashes = [r[0] for r in df.select(text.code_hash(F.col("c"))).collect()]
    assert hashes[0] == hashes[1] == hashes[2] == unit_hash("x = 1\n") and hashes[3] != hashes[0]


def test_name_lint(spark):
    names = ["", " x", "../escape", "a/b", ".hidden", "x.csv", "Figure 2b", "fig-2b", "2b", "good_name", "été", "/abs", None]
    rows = {r["n"]: r for r in name_lint(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert {n for n in names if rows[n]["table_problem"] is None} == {"Figure 2b", "fig-2b", "2b", "good_name", "été"}
    assert {n for n in names if rows[n]["unit_problem"] is None} == {"good_name", "été"}
    assert {n for n in names if rows[n]["external_problem"]} == {"../escape", "/abs"}
    for n in names:
        if n is not None:
            assert (rows[n]["unit_problem"] is None) == n.isidentifier()


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.Tar.GZ",), ("plain",), (".hidden",), ("/abs/x.csv",)], "p string")
    got = df.select(text.stem(F.col("p")), text.suffix(F.col("p")), text.base_name(F.col("p")), text.parent(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c.Tar", ".gz", "c.Tar.GZ", "a/b"), ("plain", "", "plain", ""), (".hidden", "", ".hidden", ""), ("x", ".csv", "x.csv", "/abs")]


def test_ancestors(spark):
    df = spark.createDataFrame([("a.b.c",), ("a",), ("",)], "n string")
    assert [r[0] for r in df.select(text.ancestors(F.col("n"))).collect()] == [["a", "a.b"], [], []]


def test_small_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0, True), (None, 2.0, None), (float("nan"), 2.0, False)], "a double, b double, c boolean")
    rows = df.select(
        numbers.ratio(F.col("a"), F.col("b")), numbers.label_if(F.col("c"), "y", "n"), numbers.is_missing(F.col("a")), text.base_type(F.lit("decimal(10,2)"))
    ).collect()
    assert [tuple(r)[1:3] for r in rows] == [("y", False), (None, True), ("n", True)]
    assert rows[0][0] is None and rows[0][3] == "decimal"


def test_merged_records(spark):
    assert merged([{"path": "b", "v": 1}, {"path": "a", "v": 1}], [{"path": "b", "v": 2}], "path") == [{"path": "a", "v": 1}, {"path": "b", "v": 2}]
    df = spark.createDataFrame([("b", 1, 0), ("a", 1, 0), ("b", 2, 1)], "path string, v int, seq int")
    assert sorted(map(tuple, merged_records(df, ["path"], "seq").collect())) == [("a", 1, 0), ("b", 2, 1)]


def test_described_inputs(spark):
    declared = spark.createDataFrame([("data/external/x.csv",), ("data/shared/t.csv",), ("data/shared/u.csv",), ("notes.md",), ("gone.md",)], "path string")
    files = spark.createDataFrame([("data/external/x.csv", 3, "a"), ("data/shared/u.csv", 4, "b"), ("notes.md", 5, "c"), ("data/shared/t.csv", 9, "x")], "path string, size bigint, sha256 string")
    published = spark.createDataFrame([("data/shared/t.csv", "v")], "path string, sha256 string")
    got = {r["path"]: (r["kind"], r["name"], r["size"], r["sha256"], r["problem"]) for r in lineage.describe_inputs(declared, files, published).collect()}
    assert got == {
        "data/external/x.csv": ("external", None, 3, "a", None),
        "data/shared/t.csv": ("shared", "t", None, "v", None),
        "data/shared/u.csv": ("shared", "u", None, None, "no manifest records it"),
        "notes.md": ("file", None, 5, "c", None),
        "gone.md": ("file", None, None, None, "does not exist"),
    }
