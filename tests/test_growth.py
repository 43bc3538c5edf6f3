"""Steps whose tasks must not grow with the tables, and work done once."""

import ast
import os
import re

import numpy as np
from pyspark.sql import functions as F

from codestrata.functions import pyast
from codestrata.operators import docs as H
from codestrata.operators import extract as X
from codestrata.operators import symbols as S
from codestrata.operators import trigrams as I
from codestrata.plans import q_code, q_docs, q_layout, q_logs
from codestrata.sources import corpus

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_more_files_are_dealt_over_more_partitions(spark):
    keys = spark.range(10).withColumnRenamed("id", "k")
    assert corpus._dealt(keys, "k", 100 * corpus.PARTITION_FILES).rdd.getNumPartitions() == max(100, 2 * corpus._parallelism(spark))
    assert corpus._dealt(keys, "k", 10).rdd.getNumPartitions() == 2 * corpus._parallelism(spark)


def test_a_corpus_read_once_is_not_kept_and_one_read_often_is(spark):
    spark.catalog.clearCache()
    assert "InMemoryRelation" not in _plan(q_code.parse_errors(spark, SF))
    assert "InMemoryRelation" not in _plan(q_docs.module_exports(spark, SF))
    assert "InMemoryRelation" in _plan(q_layout.lookup_errors(spark, SF))


def test_files_of_runs_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    suppliers = spark.range(40).select(F.col("id").alias("s_suppkey"))
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(q_logs, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    got = q_logs.loaded_runs(spark, str(tmp_path)).collect()
    assert sorted(r.tests_total for r in got) == [k for k in range(40) if k % 7 and k % 11]
    names = [n for n in os.listdir(tmp_path / "run-files") if n.startswith("part-")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1


def test_postings_hold_no_paths(spark, files, tmp_path):
    rows = [(f"a/{k}.txt", f"text {k} License" if k % 3 else "other") for k in range(30)]
    I.build_index(files(rows), f"{tmp_path}/i", buckets=8)
    postings = spark.read.parquet(f"{tmp_path}/i/grams")
    assert sorted(postings.columns) == ["bucket", "file", "gram"]
    assert postings.where(F.col("bucket") != F.pmod("file", F.lit(8))).isEmpty()
    assert sorted(r.path for r in I.search_index(spark, f"{tmp_path}/i", "License").collect()) == sorted(p for p, t in rows if "License" in t)
    assert np.array_equal(I._grams("abcab"), I.grams_of("abcab"))


def test_import_targets_are_written_once(spark, files):
    """The rounds and the branches read them; no plan holds their joins again."""
    a = X.analyze_files(files([("m.py", "def f(a):\n    return a\n"), ("n.py", "from m import f\n\nf(1)\n"), ("o.py", "import n\n\nn.f(2)\n")]))
    refs, defs = S.references(a), S.definitions(a)
    assert "explode(attribute_uses" not in _plan(refs) and "explode(attribute_uses" not in _plan(defs)
    found = S.resolve_import_targets(a.select("project", F.lit("m.f").alias("target")), a.limit(0).select("project", F.lit("").alias("target"), F.lit("").alias("next_target")))
    assert "MapInArrow" not in _plan(found)
    assert sorted((r.path, r.line, r.kind) for r in refs.where("full_name = 'm.f'").collect()) == [("m.py", 1, "definition"), ("n.py", 1, "import"), ("n.py", 3, "use"), ("o.py", 3, "use")]
    assert sorted((r.path, r.def_path) for r in defs.where("def_name = 'f'").collect()) == [("n.py", "m.py"), ("o.py", "m.py")]


def test_a_task_reads_few_files():
    assert corpus.PARTITION_FILES <= 5_000


def test_the_visitor_goes_through_nodes_as_its_base_does():
    seen = {"base": [], "own": []}

    class Base(ast.NodeVisitor):
        def generic_visit(self, node):
            seen["base"].append(node)
            super().generic_visit(node)

        visit_Constant = generic_visit

    class Own(pyast._Visitor):
        def generic_visit(self, node):
            seen["own"].append(node)
            super().generic_visit(node)

    tree = ast.parse("@d.e\nclass A(B, k=1):\n    x: int = -1\n\n    def f(self, *a, b=(yield), **c):\n        x.y[1:2] += not a < b is c\n        return [i for i in a if i or b] + [f'{x!r:>{b}}']\n\nmatch x:\n    case [1, *r] | {'k': A(y=0)}:\n        pass\ntry:\n    pass\nexcept E as e:\n    del x\n")
    Base().visit(tree)
    Own().visit(tree)
    bare = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Constant)
    assert ast.Name in Own._methods and len(seen["base"]) > len(seen["own"])
    assert [id(n) for n in seen["base"] if not isinstance(n, bare)] == [id(n) for n in seen["own"]]


def test_names_and_numbers_are_written_as_unparse_writes_them():
    for text in ("int", "0", "-1", "1.5", "True", "None", "...", "'a'", "1e400", "a.b[c]", "10 ** 9"):
        node = ast.parse(text, mode="eval").body
        assert pyast._unparse(node) == ast.unparse(node)


def test_names_of_all_projects_meet_inside_their_project(spark):
    """Every project has ``m.f``; a record without a project answers all."""
    kinds = "project string, name string, object_type string, import_statement string"
    rows = [(p, n, k, f"{p}:{n}") for p in "abc" for n, k in (("m", "module"), ("m.f", "function"), ("m.f", "class"))]
    docs = spark.createDataFrame([*rows, (None, "len", "builtin", "# Built-in: len"), (None, "m.f", "builtin", "everywhere")], kinds)
    asked = [(f"{p}{n}", p, n) for p in ("a", "b", None) for n in ("m.f", "len", "m.g.h", "x", "", None)]
    r = H.resolve_names(docs, spark.createDataFrame(asked, "request_id string, project string, object_name string"))
    joins = [x for x in r._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortMergeJoin" in x and "_name" in x and "LeftOuter" in x]
    assert len(joins) == 1 and "project" in joins[0].split("], [")[0]  # a key of the join, not only a condition on its pairs
    got = sorted((x.project or "-", x.object_name or "-", x.module or "-", x.found, x.doc.import_statement if x.doc else "-", x.error or "-") for x in r.collect())
    gone, lost = "Attribute error: module 'm' has no attribute 'g'", "Could not resolve 'x': module not found"
    want = [("-", "m.f", "-", True, "everywhere", "-"), ("-", "m.g.h", "-", False, "-", "Could not resolve 'm.g.h': module not found")]
    for p in "ab":
        want += [(p, "m.f", "m", True, f"{p}:m.f", "-")] * 2 + [(p, "m.f", "m", True, "everywhere", "-"), (p, "m.g.h", "m", False, "-", gone)]
    for p in "-ab":
        want += [(p, "len", "-", True, "# Built-in: len", "-"), (p, "x", "-", False, "-", lost), (p, "-", "-", False, "-", "Empty name provided")]
        want.append((p, "-", "-", False, "-", "Empty name provided"))
    assert got == sorted(want)
    assert set(r.columns) == {"request_id", "project", "object_name", "module", "doc", "found", "error"}


def test_objects_come_from_one_pass_and_no_analysis_is_kept_for_related_names(spark, files):
    spark.catalog.clearCache()
    docs = H.api_docs(X.analyze_files(files([("m.py", "def f(a):\n    return a\n")])))
    assert _plan(docs.where("object_type in ('function', 'class')")).count("MapInArrow") == 1
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", _plan(q_docs.related_names(spark, SF)))
    assert kept and not any("error" in x or "classes" in x for x in kept)


def test_small_and_large_modules_relate_the_same_names(spark, monkeypatch):
    names = ["get", "Get_all", "all", "a", "_get", "get_b", "other", "xgetx", "B"]
    rows = [(p, m, f"{m}.{n}", "function", f"See Also:\n    {n}_see\n" if n == "all" else None) for p in ("p", None) for m in ("m", "q.n") for n in names]
    rows += [("p", "m", "m.get", "class", "again"), ("p", "m", "m.C.get", "function", None), ("p", "q.n", "q.n.only", "function", None), ("p", "q.n", "q.n.single", "function", None)]
    docs = spark.createDataFrame(rows, "project string, module string, name string, object_type string, docstring string")
    want = {}
    for module in ("m", "q.n"):
        own = [n for n in [*names, *(["only", "single"] if module == "q.n" else [])] if not n.startswith("_")]
        for x in own:
            near = sorted(f"{module}.{y}" for y in own if x != y and (x.lower() in y.lower() or y.lower() in x.lower()))
            see = ["all_see"] if x == "all" else []
            if see or near:
                want["p", f"{module}.{x}"] = [*see, *near][:3]
        want[None, f"{module}.all"] = ["all_see"]
    for most in (9, 2, 64):  # one module is large, both are, none is
        monkeypatch.setattr(H, "ALIKE", most)
        spark.catalog.clearCache()
        assert {(r.project, r.name): r.related for r in H.related(docs, 3).collect()} == want
