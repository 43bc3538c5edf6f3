import os
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import docs as H
from codestrata.operators import extract as X
from codestrata.operators import graph as G
from codestrata.operators import packages as P
from codestrata.operators import search as S
from codestrata.operators import symbols as SY
from codestrata.operators import trigrams as I
from codestrata.sources import logs as L
from codestrata.sources.tree import list_tree, read_tree, register, tree_errors


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tmp_path / "gone"))
    register(spark)
    with pytest.raises(Exception, match="gone"):
        spark.read.format("source_tree").option("path", str(tmp_path / "gone")).load().collect()


def test_deep_trees_and_errors_are_rows(spark, tmp_path):
    here = tmp_path
    for k in range(5):
        here = here / f"d{k}"
        here.mkdir()
        (here / f"m{k}.py").write_text(f"x = {k}\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "d0" / "link.py").symlink_to(tmp_path / "nowhere.py")
    got = sorted(r.path for r in read_tree(spark, str(tmp_path), target_partitions=4).collect())
    assert got == sorted("/".join(f"d{j}" for j in range(k + 1)) + f"/m{k}.py" for k in range(5))
    listed = list_tree(spark, str(tmp_path), max_depth=2).collect()
    assert sorted(r.path for r in listed if r.kind == "dir") == ["d0", "d0/d1", "d0/d1/d2"]
    errors = {r.path: r.error for r in tree_errors(spark, str(tmp_path)).collect()}
    assert set(errors) == {"bad.py", "d0/link.py"} and errors["bad.py"].startswith("UnicodeDecodeError")
    register(spark)
    same = spark.read.format("source_tree").option("path", str(tmp_path)).load()
    assert sorted(r.path for r in same.collect()) == got


def test_unreadable_directories_are_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "shut").mkdir()
    (tmp_path / "a.py").write_text("")
    (tmp_path / "shut" / "b.py").write_text("")
    os.chmod(tmp_path / "shut", 0)
    try:
        if os.access(tmp_path / "shut", os.R_OK):
            pytest.skip("this user may read everything")
        assert [r.path for r in tree_errors(spark, str(tmp_path)).collect()] == ["shut"]
    finally:
        os.chmod(tmp_path / "shut", 0o700)




def test_index_gives_what_a_scan_gives(spark, files, tmp_path):
    rng = random.Random(4)
    words = ["License", "MIT", "apache", "straße", "KELVIN", "foo_bar", "ab", "x", "12.5", "a+b", "été", "(c)"]
    rows = [(f"d{k % 7}/f{k}.txt", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(5)))) for k in range(120)]
    f = files([*rows, ("empty.txt", ""), ("kelvin.txt", "\u212aELVIN lo\u017fs")]).cache()
    path = str(tmp_path / "index")
    I.build_index(f, path, buckets=16)
    patterns = ["License", "foo_bar", "Lic(ense|enze)", "(MIT|apache) License", r"a\+b", "x", "ab", "[a-z]+_bar", "(?:foo){1}_ba", "stra(ß|ss)e", "^License", "foo.*bar", "Lice?nse", "(?=MIT)M", "zzz_none", "kelvin"]
    for p in patterns:
        for case in (True, False):
            key = lambda df: sorted((r.path, r.line, r.text) for r in df.collect())
            assert key(I.search_index(spark, path, p, case)) == key(S.search_text(f, p, case_sensitive=case)), (p, case)
    # only buckets with a file that can match are read
    plan = I.indexed_files(spark, path, "KELVIN")._jdf.queryExecution().toString()
    assert I.candidates(spark, path, "zzz_none").isEmpty() and "PartitionFilters" in plan
    assert I.required("x") == [] and I.required("a|bcd") == [] and len(I.required("(abc|def)gh")) == 1


def test_peeled_graphs_have_the_same_cycles(spark):
    rng = random.Random(6)
    rows = []
    for p in range(25):
        n = rng.randrange(2, 14)
        rows += [(f"p{p}", f"m{rng.randrange(n)}", f"m{rng.randrange(n)}") for _ in range(rng.randrange(2 * n))]
    rows += [("chain", f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("ring", f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("ring", "r3", "leaf")]
    e = spark.createDataFrame(rows, "project string, src string, dst string").cache()
    key = lambda df: sorted((r.project, tuple(r.cycle)) for r in df.collect())
    want = key(G.circular_dependencies(e))
    assert key(G.circular_dependencies(e, by_component=True)) == want
    walked, G.WALKED = G.WALKED, 10
    try:
        assert key(G.circular_dependencies(e, by_component=None)) == want
    finally:
        G.WALKED = walked
    assert G.peel_sinks(e.where("project = 'ring'")).count() == 9


def test_many_names_with_one_beginning(spark):
    n = 20_000
    docs = spark.range(n).select(
        F.lit("p").alias("project"), F.lit("m").alias("module"), F.concat(F.lit("m.get_"), F.conv(F.col("id") * 7919 % 1000003, 10, 36)).alias("name"), F.lit("function").alias("object_type"), F.lit(None).cast("string").alias("docstring")
    )
    assert H.related(docs).count() > 0
    syms = docs.select("project", "module", F.element_at(F.split("name", r"\."), -1).alias("name"), F.lit("function").alias("type"), F.lit("<module>").alias("scope"))
    req = syms.select("name").limit(2000).select(F.monotonically_increasing_id().alias("request_id"), F.lit("p").alias("project"), F.lit("m").alias("module"), F.col("name").alias("prefix"))
    assert SY.completions(syms, req).count() >= 2000


def test_whole_tables_without_the_limits_of_reports(spark, files):
    src = "".join(f"v{k} = {'x' * 80!r}\n" for k in range(15)) + "".join(f"def f{k}():\n    pass\n" for k in range(30))
    a = X.analyze_files(files([("m.py", src)])).cache()
    rows = X.variables(a).collect()
    assert len(rows) == 15 and len(rows[0].value) == 82 and len(X.variables(a, first=10, width=50).collect()) == 10
    assert len(H.module_exports(a).first().exports) == 30 and len(H.module_exports(a, 20).first().exports) == 20
    many = X.analyze_files(files([(f"n{k:02d}.py", "def same():\n    pass\n") for k in range(25)]))
    assert G.cross_references(many).count() == 25 and G.cross_references(many, 20).count() == 20
    req = spark.createDataFrame([([f"d{k}>=1" for k in range(30)], [f"mod{k}/__init__.py" for k in range(8)])], "requires array<string>, files array<string>")
    r = req.select(P.dependency_names(F.col("requires")).alias("d"), P.import_names(F.lit(None).cast("string"), F.col("files"), F.lit("x")).alias("i")).first()
    assert len(r.d) == 30 and len(r.i) == 8


def test_the_last_of_rows_with_one_key_is_saved(spark, tmp_path):
    rows = [("t", "a", True, n) for n in (1, 5, 3)] + [("t", "a", False, 7)]
    runs = spark.createDataFrame(rows, "task_id string, agent string, skill_enabled boolean, tests_total long").coalesce(1).withColumn("timestamp", F.lit("x"))
    L.save_runs(runs, str(tmp_path / "o"))
    assert sorted((str(r.skill_enabled).lower(), r.tests_total) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("false", 7), ("true", 3)]


def test_digests_find_every_change_and_nothing_else(spark):
    rng = random.Random(8)
    old = [(f"e{rng.randrange(3)}", f"p{k}", f"{rng.randrange(4)}.0") for k in range(400)] + [("e0", "twice", "1"), ("e0", "twice", "2"), ("e1", "none", None)]
    new = [(e, n, v if rng.random() < 0.9 else "9.9") for e, n, v in old if rng.random() < 0.95] + [("e9", "fresh", "1.0")]
    schema = "env string, name string, version string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)

    def held(rows):
        out: dict = {}
        for e, n, v in rows:
            out.setdefault((e, n), []).append(v or "-")
        return {k: ",".join(sorted(v)) for k, v in out.items()}

    x, y = held(old), held(new)
    want = sorted((*k, x.get(k), y.get(k)) for k in set(x) | set(y) if x.get(k) != y.get(k))
    for ranges in (1, 16, 1024):
        got = P.inventory_changes(a, b, ranges=ranges).collect()
        assert sorted((r.env, r.name, r.old_version, r.new_version) for r in got) == sorted(want)
    one = {r.env: r.fingerprint for r in P.inventory_digest(a).collect()}
    assert one == {r.env: r.fingerprint for r in P.inventory_digest(a.repartition(7)).collect()}
    assert P.inventory_changes(a, a.repartition(3)).count() == 0


def test_lookup_says_why_and_a_docstring_may_hold_the_signature(spark, files):
    a = X.analyze_files(files([("pkg/m.py", "class A:\n    'A(x, y) makes.'\n    def run(self):\n        pass\n"), ("pkg/__init__.py", "")]))
    docs = H.api_docs(a)
    req = spark.createDataFrame([(1, "pkg.m.A.gone.x"), (2, "pkg.nope"), (3, "what"), (4, None), (5, "pkg.m.A.run")], "request_id int, object_name string")
    got = {r.request_id: r for r in H.resolve_names(docs, req).collect()}
    assert got[1].error == "Attribute error: type object 'A' has no attribute 'gone'" and got[2].error == "Attribute error: module 'pkg' has no attribute 'nope'"
    assert got[3].error == "Could not resolve 'what': module not found" and got[4].error == "Empty name provided"
    assert got[5].error is None and got[5].doc.import_statement == "from pkg.m import run"
    sig = spark.createDataFrame([("x\nf(a, b) -> c\n",), ("no",), (None,)], "d string").select(H.docstring_signature(F.col("d")).alias("s")).collect()
    assert [r.s for r in sig] == ["f(a, b) -> c", None, None]
