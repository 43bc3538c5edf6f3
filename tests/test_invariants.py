import ast
import random

from pyspark.sql import functions as F

from codestrata.operators import extract as X
from codestrata.operators import search as S
from codestrata.sources.tables import document_files

SF = "/root/testdata/sf0.001"

PIECES = [
    "import os\n",
    "from a.b import c as d\n",
    "def f{n}(x, *a, k=1, **kw):\n    def inner{n}():\n        return x\n    return inner{n}\n",
    "async def g{n}(y: int) -> int:\n    return y\n",
    "class K{n}(Base):\n    z: int = 3\n    def m(self, q):\n        import json\n        return q\n",
    "v{n} = [i for i in range(3)]\n",
    "@dec\ndef h{n}():\n    pass\n",
]


def _gen(seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice(PIECES).format(n=i) for i in range(rnd.randint(1, 8)))


def test_differential_against_stdlib_ast(files):
    srcs = [_gen(s) for s in range(40)]
    a = X.analyze_files(files([(f"g{i}.py", s) for i, s in enumerate(srcs)]))
    got_f = {}
    for r in X.functions(a).collect():
        got_f.setdefault(r.path, []).append(r.name)
    got_c = {r.path: r.n for r in X.classes(a).groupBy("path").agg(F.count("*").alias("n")).collect()}
    for i, s in enumerate(srcs):
        tree = ast.parse(s)
        in_class = {id(n) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for n in ast.walk(c) if n is not c}
        want = sorted(n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and id(n) not in in_class)
        assert sorted(got_f.get(f"g{i}.py", [])) == want
        assert got_c.get(f"g{i}.py", 0) == sum(isinstance(n, ast.ClassDef) for n in tree.body)


def test_results_stable_across_shuffle_partitions(spark):
    f = document_files(spark, SF)
    seen = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        m = S.search_text(f, "(?i)the")
        seen.append(([(r.path, r.line) for r in S.first_results(m, 50).collect()], S.search_summary(m, 50).first().asDict()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] == seen[2]


def test_rollup_total_equals_rows(spark):
    f = document_files(spark, SF)
    refs = S.find_config_references(f, "licen[sc]e")
    counts = {r.category: r.n_refs for r in S.config_category_counts(refs).collect()}
    total = counts.pop("TOTAL")
    assert total == sum(counts.values()) == refs.count()
