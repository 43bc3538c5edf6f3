"""Sides that grow with the corpus are never broadcast through the driver,
however small Spark takes them to be."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import diagnostics as D
from codestrata.operators import docs as H
from codestrata.operators import extract as X
from codestrata.operators import packages as P
from codestrata.operators import symbols as S
from codestrata.plans.project import codegen_context

ROWS = [("m.py", "import os\n\n\ndef f(a):\n    return g(a)\n"), ("n.py", "from m import f\n\nf(1)\n")]


def _packages(spark):
    return P.normalise(spark.createDataFrame([("e", "Pkg", "1.0", [], [], ["pkg/__init__.py"], None)], "env string, name string, version string, import_names array<string>, requires array<string>, files array<string>, top_level string"))


def _requests(a):
    module = F.regexp_replace("path", r"\.py$", "")
    return a.select(F.col("path").alias("request_id"), F.col("project").alias("env"), F.concat(module, F.lit(".f")).alias("object_name"), module.alias("import_name"))


CASES = {
    "references": lambda a, pk: S.references(a),
    "definitions": lambda a, pk: S.definitions(a),
    "hover": lambda a, pk: S.hover(a, H.api_docs(a)),
    "signature_help": lambda a, pk: S.signature_help(a),
    "rename_batch": lambda a, pk: S.rename_batch(a.select("project", "path", F.lit("").alias("text")), S.references(a), S.symbols(a).select("full_name", F.lit("h").alias("new_name"))),
    "undefined_names": lambda a, pk: D.undefined_names(a),
    "unused_imports": lambda a, pk: D.unused_imports(a),
    "related": lambda a, pk: H.related(H.api_docs(a)),
    "resolve_names": lambda a, pk: H.resolve_names(H.api_docs(a), _requests(a)),
    "codegen_context": lambda a, pk: codegen_context(_requests(a), H.api_docs(a), pk),
    "find_package_by_import": lambda a, pk: P.find_package_by_import(pk, pk.select("env", F.explode("import_names").alias("import_name"))),
    "import_audit": lambda a, pk: P.import_audit(pk.select("env", F.col("name").alias("path"), F.col("name").alias("module")), P.import_to_package(pk), X.stdlib_array()),
}


@pytest.mark.parametrize("name", CASES)
def test_no_side_is_broadcast(spark, files, name):
    a = X.analyze_files(files(ROWS))
    plan = CASES[name](a, _packages(spark))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_the_one_name_of_a_rename_is_broadcast(files):
    a = X.analyze_files(files(ROWS))
    r = S.rename(files(ROWS), S.references(a), "m.f", "h")
    assert "Broadcast" in r._jdf.queryExecution().sparkPlan().toString()
    assert sorted((x.path, x.n_changes) for x in r.collect()) == [("m.py", 1), ("n.py", 2)]
