from pyspark.sql import functions as F

from codestrata.operators import extract as X
from codestrata.operators import graph as G


def analyze(files, rows):
    return X.analyze_files(files(rows))


def test_simple_function(files):
    a = analyze(files, [("sample.py", "def hello():\n    return 'world'\n")])
    fn = X.functions(a).collect()
    assert [r.name for r in fn] == ["hello"]
    assert fn[0].signature == "hello() -> None"


def test_empty_class_imports_and_errors(files):
    a = analyze(
        files,
        [
            ("c.py", "class MyClass:\n    pass\n"),
            ("i.py", "import os\nfrom pathlib import Path\n"),
            ("bad.py", "def broken(\n"),
            ("empty.py", ""),
        ],
    )
    s = {r.path: r for r in X.file_summary(a).collect()}
    assert s["c.py"].n_classes == 1
    assert s["i.py"].n_imports == 2
    assert s["bad.py"].error.startswith("Syntax error")
    assert s["empty.py"].error is None and s["empty.py"].n_functions == 0
    assert X.syntax_errors(a).count() == 1


def test_signature_params_and_methods(files):
    src = (
        "def greet(name: str, times: int = 1) -> str:\n    return name * times\n\n"
        "class Calculator:\n    def add(self, a, b):\n        return a + b\n    def subtract(self, a, b):\n        return a - b\n"
    )
    a = analyze(files, [("s.py", src)])
    f = X.functions(a).first()
    assert f.signature == "greet(name: str, times: int) -> str"
    ps = X.params(a).orderBy("position").collect()
    assert [(p.name, p.default, p.required) for p in ps] == [("name", None, True), ("times", "1", False)]
    ms = X.methods(a).orderBy("line").collect()
    assert [m.name for m in ms] == ["add", "subtract"]
    assert ms[0].signature == "add(a, b) -> None"


def test_decorators_and_third_party(files):
    src = "from dataclasses import dataclass\n@dataclass\nclass Point:\n    x: int = 0\n\n@staticmethod\ndef helper():\n    pass\n"
    a = analyze(files, [("d.py", src), ("t.py", "import pandas\nimport numpy\nimport flask\nimport textwrap\n")])
    s = {r.path: r for r in X.file_summary(a).collect()}
    assert "dataclass" in s["d.py"].decorators_used and "staticmethod" in s["d.py"].decorators_used
    assert s["t.py"].third_party == ["flask", "numpy", "pandas"]
    assert X.attributes(a).first().name == "x"


def test_import_graph_and_cycles(spark, files):
    a = analyze(
        files,
        [
            ("a.py", "from b import helper\n"),
            ("b.py", "def helper(): pass\n"),
            ("app.py", "import os\nimport json\n"),
        ],
    )
    edges = {(r.src, r.dst) for r in G.import_edges(a).collect()}
    assert edges == {("a", "b")}
    adj = {r.module: r.deps for r in G.import_adjacency(a).collect()}
    assert adj["app"] == [] and adj["a"] == ["b"]


def _cycles(spark, edges, split=False):
    df = spark.createDataFrame([("p", s, d) for s, d in edges], "project string, src string, dst string")
    return sorted(tuple(r.cycle) for r in G.circular_dependencies(df, by_component=split).collect())


def test_cycles_small_graphs(spark):
    assert _cycles(spark, [("a", "b"), ("b", "c")]) == []
    assert _cycles(spark, [("a", "b"), ("b", "a")]) == [("a", "b", "a")]
    assert _cycles(spark, [("a", "a")]) == [("a", "a")]
    assert _cycles(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [("a", "b", "c", "a")]
    ring = [(f"m{i:02d}", f"m{(i + 1) % 20:02d}") for i in range(20)]
    got = _cycles(spark, ring)
    assert len(got) == 1 and len(got[0]) == 21 and got[0][0] == "m00"


def test_cycles_by_component_give_the_same_answer(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f")]
    assert _cycles(spark, edges, split=True) == [("a", "b", "a"), ("c", "d", "e", "c")]
    branching = [("a", "d"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "c"), ("x", "x"), ("y", "z")]
    assert _cycles(spark, branching) == _cycles(spark, branching, split=True) == [("b", "c", "d", "b"), ("x", "x")]
    ring = [(f"m{i:02d}", f"m{(i + 1) % 20:02d}") for i in range(20)]
    assert _cycles(spark, ring, split=True) == _cycles(spark, ring)


def test_project_rollup(spark, files):
    f = files([("main.py", "import json\nfrom utils import helper\n\ndef main():\n    return helper()\n"), ("utils.py", "def helper():\n    return 42\n")])
    a = X.analyze_files(f.withColumn("n_lines", G.line_count(F.col("text"))), carry=["n_lines"])
    r = G.project_rollup(f, a).first()
    assert (r.total_files, r.total_functions, r.stdlib_deps) == (2, 2, 1)


def test_non_python_files_are_error_rows(files):
    a = X.analyze_files(files([("notes.txt", "def f(): pass\n"), ("ok.py", "x = 1\n")]))
    s = {r.path: r.error for r in X.file_summary(a).collect()}
    assert s["notes.txt"].startswith("Not a Python file") and s["ok.py"] is None


def test_relative_imports_resolve(files):
    a = X.analyze_files(
        files([("pkg/__init__.py", "from .core import run\n"), ("pkg/core.py", "from .util import h\nfrom ..top import t\n"), ("pkg/util.py", "def h(): pass\n")])
    )
    raw = {(r.src, r.dst) for r in G.import_edges(a).collect()}
    assert raw == {("pkg", "core"), ("pkg.core", "util"), ("pkg.core", "top")}
    res = {(r.src, r.dst) for r in G.import_edges(a, resolve_relative_imports=True).collect()}
    assert res == {("pkg", "pkg.core"), ("pkg.core", "pkg.util"), ("pkg.core", "top")}
