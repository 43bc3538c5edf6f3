from pyspark.sql import functions as F

from codestrata.operators import accounting as A
from codestrata.operators import docs as H
from codestrata.operators import extract as X
from codestrata.operators import packages as P


def test_docstring_parsers(spark):
    docs = [
        ("sphinx", "Do it.\n\n:raises ValueError: when bad\n:raises KeyError: when missing\n"),
        ("google", "Do it.\n\nRaises:\n    ValueError: If the value\n        is bad.\n    TypeError: If wrong.\n\nReturns:\n    x\n"),
        ("empty", ""),
        ("none", None),
        ("plain", "Just text.\n\n>>> add(1, 2)\n3\n"),
    ]
    df = spark.createDataFrame(docs, "name string, doc string")
    r = {x.name: x for x in df.select("name", H.doc_raises(F.col("doc")).alias("r"), H.doc_examples(F.col("doc")).alias("e")).collect()}
    assert [e.exception for e in r["sphinx"].r] == ["ValueError", "KeyError"]
    assert [(e.exception, e.description) for e in r["google"].r] == [("ValueError", "If the value is bad."), ("TypeError", "If wrong.")]
    assert r["empty"].r == [] and r["none"].r == [] and r["plain"].r == []
    assert [(e.code, e.expected) for e in r["plain"].e] == [("add(1, 2)", "3")]


def test_docs_related_exports_budget(spark, files):
    src = "def parse(x):\n    '''Parse.'''\n\ndef parse_all(xs):\n    pass\n\ndef other():\n    pass\n\nclass Parser:\n    def __init__(self, a, b=1):\n        pass\n    def _hidden(self):\n        pass\n    def run(self):\n        pass\n"
    a = X.analyze_files(files([("pkg/mod.py", src)]))
    docs = H.api_docs(a)
    rel = {r.name: r.related for r in H.related(docs).collect()}
    assert rel["pkg.mod.parse"] == ["pkg.mod.Parser", "pkg.mod.parse_all"]
    ex = H.module_exports(a).first().exports
    assert ex == ["Parser", "other", "parse", "parse_all"]
    cls = docs.where("name = 'pkg.mod.Parser'").first()
    assert cls.signature == "Parser(a, b)" and cls.methods == ["__init__", "run"]
    short = H.apply_budget(docs.withColumn("found", F.lit(True)), "short")
    assert "returns" not in short.columns and "parameters" in short.columns
    g = H.apply_goal(docs.withColumn("found", F.lit(True)), "refactor", "short")
    assert "source_file" not in g.columns and "task_goal" in g.columns
    pk = spark.createDataFrame([("e", "mypkg", "1.0", ["pkg"], [], [], None)], "env string, name string, version string, import_names array<string>, requires array<string>, files array<string>, top_level string")
    me = P.main_exports(H.module_exports(a).withColumnRenamed("module", "m").withColumn("module", F.lit("pkg")).drop("m"), pk).first()
    assert me.main_exports[:2] == ["Parser", "other"]


def test_packages_from_metadata(spark):
    rows = [
        ("e", "site/foo-1.0.dist-info/METADATA", "Metadata-Version: 2.1\nName: foo-bar\nVersion: 1.0\nRequires-Dist: requests>=2; extra == 'x'\nRequires-Dist: a~=1\n"),
        ("e", "site/foo-1.0.dist-info/RECORD", "foo_bar/__init__.py,sha256=x,1\n_foo/x.py,,\ntests/t.py,,\nfoo-1.0.dist-info/METADATA,,\n"),
        ("e", "site/baz-2.0.dist-info/METADATA", "Name: Baz\nVersion: 2.0\n"),
        ("e", "site/baz-2.0.dist-info/top_level.txt", "baz\nbaz_ext\n"),
    ]
    p = {r.name: r for r in P.packages_from_metadata(spark.createDataFrame(rows, "env string, path string, text string")).collect()}
    assert p["foo-bar"].import_names == ["foo_bar"] and p["foo-bar"].dependencies == ["requests", "a"]
    assert p["Baz"].import_names == ["baz", "baz_ext"]


def test_project_and_doc_representations(spark, files):
    f = files([("a.py", "x = 1\n"), ("b.py", "y = 2\n")])
    pj = spark.createDataFrame([("p", '{"files": 2}')], "project string, json string")
    r = {x.side: x for x in A.project_representations(f, pj).collect()}
    assert r["without"].text_length == 13 and r["with"].tokens == 3
    a = X.analyze_files(f)
    docs = H.api_docs(a)
    est = A.doc_representations(docs, H.apply_budget(docs.withColumn("found", F.lit(True)), "short"))
    cmp = A.compare(est).collect()
    assert len(cmp) == docs.count()


def test_related_see_also_and_completions(spark, files):
    from codestrata.operators import symbols as S

    src = "def load(x):\n    '''Load.\n\n    See Also\n    --------\n    dump : the inverse\n    '''\n\ndef load_all():\n    pass\n\ndef dump():\n    pass\n"
    a = X.analyze_files(files([("m.py", src)]))
    docs = H.api_docs(a)
    rel = {r.name: r.related for r in H.related(docs).collect()}
    assert rel["m.load"] == ["dump", "m.load_all"]
    req = spark.createDataFrame([(1, "p", "m", "lo"), (2, "p", "m", ""), (3, "p", "m", "zz")], "request_id int, project string, module string, prefix string")
    got = sorted((r.request_id, r.name) for r in S.completions(S.symbols(a), req).collect())
    assert got == [(1, "load"), (1, "load_all"), (2, "dump"), (2, "load"), (2, "load_all")]


def test_search_report_and_builtins(spark, files):
    from codestrata.operators import search as S

    f = files([("a.py", "k\nk\nk\n"), ("b.py", "k\n")])
    rep = S.search_report(f, "k", max_results=2)
    assert rep["matches"].count() == 2
    s = rep["summary"].first()
    assert s.match_count == 2 and s.truncated
    a = X.analyze_files(files([("m.py", "def f():\n    pass\n")]))
    docs = H.api_docs(a).unionByName(H.builtin_docs(spark))
    req = spark.createDataFrame([(1, "len"), (2, "m.f"), (3, "nope.x")], "request_id int, object_name string")
    r = {x.request_id: x for x in H.resolve_names(docs, req).collect()}
    assert r[1].found and r[1].doc.import_statement == "# Built-in: len"
    assert r[2].found and r[2].doc.import_statement == "from m import f"
    assert not r[3].found


def test_long_names_are_related_and_raises_need_no_colon(spark, files):
    long = "n" * 69 + "x"
    a = X.analyze_files(files([("m.py", f"def {long}():\n    pass\n\n\ndef {long}_b():\n    pass\n\n\ndef _{long}():\n    pass\n\n\nclass C:\n    def {long}_c(self):\n        pass\n")]))
    rel = {r.name: r.related for r in H.related(H.api_docs(a)).collect()}
    assert rel == {f"m.{long}": [f"m.{long}_b"], f"m.{long}_b": [f"m.{long}"]}
    assert H._raises("x\n\nRaises:\n    ValueError\n        when bad\n    KeyError: no key\n") == [{"exception": "ValueError", "description": "when bad"}, {"exception": "KeyError", "description": "no key"}]


def test_markers_are_reduced_per_folder(spark):
    from codestrata.operators import packages as P

    mk = spark.createDataFrame([("a", "poetry.lock", "")] * 50 + [("a", "uv.lock", ""), ("b", "x", "")], "dir string, file string, text string")
    req = spark.createDataFrame([(1, "a/b/c"), (2, "b")], "request_id int, dir string")
    assert {r.request_id: r.manager for r in P.detect_manager(mk, req).collect()} == {1: "uv", 2: "pip"}


def test_raises_under_an_underlined_heading():
    assert H._raises("x\n\nRaises\n------\n    OSError\n        why\n") == [{"exception": "OSError", "description": "why"}]
