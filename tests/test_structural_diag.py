from codestrata.operators import diagnostics as D
from codestrata.operators import extract as X
from codestrata.operators import structural as E
from codestrata.operators import symbols as S


def test_pattern_search(files):
    f = files([("example.py", "def hello():\n    pass\n\ndef greet(name):\n    return name\n"), ("__pycache__/cached.py", "def x():\n    pass\n")])
    m = E.search_pattern(f, "def $FUNC($$$PARAMS):\n    $$$BODY").collect()
    assert sorted(r.metavariables["$FUNC"] for r in m) == ["greet", "hello"]
    assert all(not r.path.startswith("__pycache__") for r in m)
    imps = E.search_pattern(files([("i.py", "import os\nimport sys\nimport json\n")]), "import $MODULE").count()
    assert imps == 3


def test_rules(spark, files):
    f = files(
        [
            ("bare.py", "try:\n    x = 1\nexcept:\n    pass\n"),
            ("pr.py", "print('hello')\nprint('world')\n"),
            ("star.py", "from os import *\n"),
            ("clean.py", "import os\n\nx = os.getcwd()\n"),
        ]
    )
    got = sorted((r.path, r.rule_id) for r in E.check_rules(f).collect())
    assert got == [("bare.py", "bare-except"), ("pr.py", "print-statement"), ("pr.py", "print-statement"), ("star.py", "star-import")]
    sev = {r.severity: r.n for r in E.severity_counts(spark, E.check_rules(f)).collect()}
    assert sev == {"error": 0, "warning": 2, "info": 2}


def test_rewrite_preview(files):
    f = files([("p.py", "print('hello')\n")])
    r = E.rewrite(f, "print($$$ARGS)", "logging.info($$$ARGS)").first()
    assert r.new_text == "logging.info('hello')\n" and r.old_text == "print('hello')\n"


def test_diagnostics(files):
    a = X.analyze_files(files([("u.py", "import os\nx = 1\n"), ("n.py", "print(undefined_variable)\n"), ("c.py", "x = 1\nprint(x)\n"), ("s.py", "def foo()\n    pass\n")]))
    un = D.unused_imports(a).collect()
    assert len(un) == 1 and "os" in un[0].message
    ud = D.undefined_names(a).collect()
    assert [(r.path, r.name) for r in ud] == [("n.py", "undefined_variable")]
    assert X.syntax_errors(a).first().path == "s.py"
    summ = {r.path: r for r in D.file_summary(D.run_diagnostics(a)).collect()}
    assert "c.py" not in summ and summ["n.py"].errors == 1


def test_scopes(files):
    src = "import a\nclass K:\n    v = 1\n    def m(self):\n        return v\n\ndef f():\n    global g\n    g = 2\n    return [y for y in range(3)]\n"
    a = X.analyze_files(files([("s.py", src)]))
    assert [r.name for r in D.undefined_names(a).collect()] == ["v"]


def test_log_ingestion(spark):
    raw = spark.createDataFrame([("file.py:3:1: undefined name 'x'",), ("file.py:1: 'os' imported but unused",), ("garbage",)], "value string")
    rows = D.parse_pyflakes(raw).orderBy("line").collect()
    assert [(r.line, r.column, r.severity) for r in rows] == [(1, 0, "warning"), (3, 1, "error")]
    mypy = spark.createDataFrame([("file.py:3:5: error: bad",), ("file.py:4: note: hint",)], "value string")
    assert [r.severity for r in D.parse_mypy(mypy).orderBy("line").collect()] == ["error", "info"]
    pr = spark.createDataFrame([('{"generalDiagnostics":[{"file":"a.py","range":{"start":{"line":0,"character":4}},"message":"m","rule":"r"}]}',)], "value string")
    r = D.parse_pyright(pr).first()
    assert (r.line, r.column, r.severity) == (1, 4, "error")


def test_references_and_rename(files):
    f = files([("r.py", "x = 1\ny = x + 2\nprint(x)")])
    a = X.analyze_files(f)
    refs = S.references(a).where("full_name = 'r.x'").collect()
    assert len(refs) >= 2
    out = S.rename(f, S.references(a), "r.x", "value").first()
    assert out.new_text == "value = 1\ny = value + 2\nprint(value)"


def test_definitions_follow_reexports_and_signature_help(files):
    f = files([("a.py", "def f(x, y=1):\n    return x\n"), ("b.py", "from a import f\n"), ("c.py", "from b import f\nf(1)\n")])
    a = X.analyze_files(f)
    d = S.definitions(a).where("path = 'c.py' AND name = 'f'").collect()
    assert [(r.def_path, r.def_line) for r in d] == [("a.py", 1)]
    sh = S.signature_help(a).collect()
    assert len(sh) == 1 and sh[0].callee == "f" and sh[0].active_parameter == 0 and [p.name for p in sh[0].params] == ["x", "y"]


def test_lint_in_the_same_pass(files):
    f = files([("pr.py", "print('hello')\nassert x\n"), ("bad.py", "def broken(\n"), ("star.py", "from os import *\n")])
    one = sorted((r.path, r.rule_id, r.line) for r in X.findings(X.analyze_files(f, rules="default")).collect())
    two = sorted((r.path, r.rule_id, r.line) for r in E.check_rules(f).collect())
    assert one == two and len(one) == 3


def _projects(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, text string")


def test_projects_with_the_same_paths_stay_apart(spark):
    text = 'def f(x):\n    """doc of %s"""\n    return x\n\n\nf(1)\nf(2)\n'
    a = X.analyze_files(_projects(spark, [(p, "m.py", text % p) for p in ("p1", "p2", "p3")]))
    from codestrata.operators import docs as H
    from codestrata.operators import search as R

    h = S.hover(a, H.api_docs(a)).where("name = 'f'").collect()
    assert sorted((r.project, r.docstring) for r in h) == sorted((p, f"doc of {p}") for p in ("p1", "p2", "p3") for _ in range(2))
    assert S.signature_help(a).count() == 6
    req = spark.createDataFrame([("r", "p2", "m.f")], "request_id string, project string, object_name string")
    found = H.resolve_names(H.api_docs(a), req).collect()
    assert [(r.found, r.doc.docstring) for r in found] == [(True, "doc of p2")]
    m = R.search_text(_projects(spark, [(p, "a.txt", "hit\nhit") for p in ("p1", "p2")]), "hit")
    assert R.limit_per_file(m, 1).count() == 2 and R.search_summary(m, 10).first().files_with_matches == 2
    diag = "project string, path string, message string"
    one, two = spark.createDataFrame([("p1", "a.py", "x")], diag), spark.createDataFrame([("p1", "a.py", "y"), ("p2", "a.py", "z")], diag)
    assert sorted(r.message for r in D.type_checker_fallback(one, two).collect()) == ["x", "z"]


def test_rename_by_position(files):
    text = "def run(x):\n    return x\n\n\nprint('run', obj.run, run(1))  # run\r\nrun(2)\rz = run(3)\n"
    f = files([("r.py", text), ("s.py", "from r import run as go\nrun = 'run'\ngo(1)\n")])
    a = X.analyze_files(f)
    out = {r.path: r.new_text for r in S.rename(f, S.references(a), "r.run", "walk").collect()}
    assert out["r.py"] == "def walk(x):\n    return x\n\n\nprint('run', obj.run, walk(1))  # run\r\nwalk(2)\rz = walk(3)\n"
    assert out["s.py"] == "from r import walk as go\nrun = 'run'\ngo(1)\n"


def test_names_can_be_swapped(files, spark):
    f = files([("q.py", "def a():\n    pass\n\n\ndef b():\n    pass\n\n\nz = (a(), b())\n")])
    refs = S.references(X.analyze_files(f))
    both = spark.createDataFrame([("q.a", "b"), ("q.b", "a")], "full_name string, new_name string")
    assert S.rename_batch(f, refs, both).first().new_text == "def b():\n    pass\n\n\ndef a():\n    pass\n\n\nz = (b(), a())\n"


def test_definitions_over_relative_imports_and_long_chains(files):
    chain = [("pkg/__init__.py", ""), ("pkg/m0.py", "def f():\n    pass\n")]
    chain += [(f"pkg/m{k}.py", f"from .m{k - 1} import f\n") for k in range(1, 15)]
    chain += [("use.py", "from pkg.m14 import f\nf()\n"), ("c1.py", "from c2 import g\n"), ("c2.py", "from c1 import g\ng()\n")]
    a = X.analyze_files(files(chain))
    d = S.definitions(a).where("name = 'f' and path = 'use.py'").collect()
    assert [(r.def_path, r.def_line) for r in d] == [("pkg/m0.py", 1)]
    refs = S.references(a).where("full_name = 'pkg.m0.f'").collect()
    assert {(r.path, r.kind) for r in refs} >= {("pkg/m0.py", "definition"), ("pkg/m1.py", "import")}
    assert S.definitions(a).where("name = 'g'").count() == 0


def test_carriage_returns_and_number_spellings(files):
    f = files([("r.py", "x = 1\rprint('a')\rassert x\r\nf(16)\n")])
    assert sorted(r.rule_id for r in E.check_rules(f).collect()) == ["assert-without-message", "print-statement"]
    assert E.search_pattern(f, "f(0x10)").count() == 1
    out = E.rewrite(f, "print($X)", "log($X)").first()
    assert out.new_text == "x = 1\rlog('a')\rassert x\r\nf(16)\n"
