"""Registered queries over the layout corpus: one project per ``supplier`` row,
all with the same paths, packages, relative imports, re-exports and cycles."""

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import docs as H
from ..operators import extract as X
from ..operators import graph as G
from ..operators import structural as E
from ..operators import symbols as S
from ..sources.corpus import BROKEN_FILES, LAYOUT_FILES, STUB_FILES, file_corpus, layout_corpus
from .registry import query


def _analysis(spark, sf_dir):
    return X.analyze_files(layout_corpus(spark, sf_dir)).persist()


def _text(value) -> str:
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    quoted = "'" + str(value).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"
    return f"replace({quoted}, '{{s}}', s)"


def _per_project(columns: list[str], rows: list[tuple]) -> str:
    """SQL for the given rows once in every project."""
    one = [", ".join(f'{_text(v)} AS "{c}"' for c, v in zip(columns, r)) for r in rows]
    s = "(SELECT CAST(s_suppkey AS VARCHAR) AS s FROM supplier)"
    return " UNION ALL ".join(f"SELECT 'lib' || s AS project, {r} FROM {s}" for r in one)


IMPORTERS = ["pkg/__init__.py", *[f"pkg/c{i}.py" for i in range(1, 13)], "app.py", "top.py"]


@query(
    "layout_references",
    _per_project(
        ["full_name", "path", "line", "kind"],
        [("pkg.core.run", "pkg/core.py", 1, "definition"), ("pkg.core.run", "pkg/core.py", 8, "use")]
        + [("pkg.core.run", p, 1, "import") for p in IMPORTERS]
        + [("pkg.core.run", p, 3, "use") for p in ("app.py", "use.py", "top.py")]
        + [("pkg.core.outer", "pkg/core.py", 6, "definition"), ("pkg.core.outer.inner", "pkg/core.py", 7, "definition"), ("pkg.core.outer.inner", "pkg/core.py", 9, "use")],
    ),
)
def layout_references(spark, sf_dir):
    """F3 through relative imports, 13 re-exports, aliases and dotted uses."""
    return S.references(_analysis(spark, sf_dir)).select("project", "full_name", "path", "line", "kind")


_RUN = ("pkg/core.py", 1, "function", "run")


@query(
    "layout_definitions",
    _per_project(
        ["path", "line", "name", "def_path", "def_line", "type", "def_name"],
        [("app.py", 3, "run", *_RUN), ("use.py", 3, "run", *_RUN), ("top.py", 3, "go", *_RUN), ("pkg/core.py", 8, "run", *_RUN),
         ("pkg/core.py", 9, "inner", "pkg/core.py", 7, "function", "inner"), ("pkg/core.py", 3, "x", "pkg/core.py", 1, "param", "x")],
    ),
)
def layout_definitions(spark, sf_dir):
    """F4 over the same."""
    d = S.definitions(_analysis(spark, sf_dir))
    return d.select("project", "path", "line", "name", "def_path", F.col("def_line").cast("long").alias("def_line"), "type", "def_name")


@query(
    "layout_hover",
    _per_project(["path", "line", "short_description"], [(p, n, "Run in {s}.") for p, n in (("app.py", 3), ("use.py", 3), ("top.py", 3), ("pkg/core.py", 8))]),
)
def layout_hover(spark, sf_dir):
    """every use of ``run`` shows its own project's documentation."""
    a = _analysis(spark, sf_dir)
    h = S.hover(a, H.api_docs(a)).where(F.col("def_name") == "run")
    return h.select("project", "path", "line", "short_description")


@query(
    "layout_signature_help",
    _per_project(["path", "line", "callee", "active_parameter"], [("app.py", 3, "run", 0), ("top.py", 3, "run", 0), ("pkg/core.py", 8, "run", 0), ("pkg/core.py", 9, "inner", -1)]),
)
def layout_signature_help(spark, sf_dir):
    """one row per call and project."""
    return S.signature_help(_analysis(spark, sf_dir)).select("project", "path", "line", "callee", "active_parameter")


def _renamed(path: str, text: str) -> str:
    if path == "app.py":
        return "from pkg.c12 import execute\n\nprint('run', obj.run, execute(1))\n"
    if path == "use.py":
        return "import pkg.core\n\npkg.core.execute(1)\n"
    if path == "pkg/core.py":
        return text.replace("def run", "def execute").replace("run(1)", "execute(1)")
    return text.replace("import run", "import execute")


@query(
    "layout_rename",
    _per_project(
        ["path", "n_changes", "new_text"],
        [(p, 2 if p in ("app.py", "pkg/core.py") else 1, _renamed(p, LAYOUT_FILES[p])) for p in [*IMPORTERS, "use.py", "pkg/core.py"]],
    ),
)
def layout_rename(spark, sf_dir):
    """strings, foreign attributes and aliases stay; the new texts are compared."""
    a = _analysis(spark, sf_dir)
    r = S.rename(layout_corpus(spark, sf_dir), S.references(a), "pkg.core.run", "execute")
    return r.select("project", "path", "n_changes", "new_text")


@query("layout_cycles", _per_project(["cycle", "length"], [("b>c>d>b", 3)]))
def layout_cycles(spark, sf_dir):
    """C7 over branching imports: a depth-first walk over sorted modules meets
    one back edge."""
    c = G.circular_dependencies(G.import_edges(_analysis(spark, sf_dir)), by_component=True)
    return c.select("project", F.array_join("cycle", ">").alias("cycle"), "length")


@query(
    "layout_edges",
    _per_project(
        ["src", "dst"],
        [("pkg", "pkg.core"), ("pkg.c1", "pkg.core"), *[(f"pkg.c{i}", f"pkg.c{i - 1}") for i in range(2, 13)], ("app", "pkg.c12"), ("use", "pkg.core"), ("top", "pkg"),
         ("a", "d"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "c")],
    ),
)
def layout_edges(spark, sf_dir):
    """C6 with relative imports resolved inside packages."""
    return G.import_edges(_analysis(spark, sf_dir), resolve_relative_imports=True)


@query(
    "layout_lint",
    _per_project(
        ["path", "rule_id", "line"],
        [("app.py", "print-statement", 3), ("cr.py", "print-statement", 2), ("rules.py", "star-import", 1), ("rules.py", "bare-except", 3),
         ("rules.py", "assert-without-message", 4), ("rules.py", "print-statement", 9), ("rules.py", "broad-exception-catch", 10)],
    ),
)
def layout_lint(spark, sf_dir):
    """All five default rules, one file with carriage-return line ends."""
    return E.check_rules(layout_corpus(spark, sf_dir)).select("project", "path", "rule_id", "line")


@query("layout_undefined", _per_project(["path", "line", "name"], [("app.py", 3, "obj")]))
def layout_undefined(spark, sf_dir):
    """A star import hides what a file leaves undefined."""
    return D.undefined_names(_analysis(spark, sf_dir)).select("project", "path", "line", "name")


def _changed_lines(path: str, text: str) -> str:
    """The expected diff of a file so short that it is one hunk, whose lines
    change in place."""
    old, new = text.split("\n")[:-1], _renamed(path, text).split("\n")[:-1]
    body, gone, come = [], [], []
    for a, b in [*zip(old, new), (None, None)]:
        if a == b:
            body += [f"-{x}" for x in gone] + [f"+{x}" for x in come] + ([f" {a}"] if a is not None else [])
            gone, come = [], []
        else:
            gone.append(a)
            come.append(b)
    n = "1" if len(old) == 1 else f"1,{len(old)}"
    return f"--- {path}\n+++ {path}\n@@ -{n} +{n} @@\n" + "\n".join(body) + "\n"


# two changes seven lines apart: their contexts touch, so they are one hunk
@query("layout_diff", _per_project(["path", "diff"], [(p, _changed_lines(p, LAYOUT_FILES[p])) for p in [*IMPORTERS, "use.py", "pkg/core.py"]]))
def layout_diff(spark, sf_dir):
    """the unified diff of a rename."""
    a = _analysis(spark, sf_dir)
    r = S.rename(layout_corpus(spark, sf_dir), S.references(a), "pkg.core.run", "execute")
    return S.unified_diff(S.diff_hunks(r))


def _broken(spark, sf_dir):
    return X.analyze_files(file_corpus(spark, sf_dir, BROKEN_FILES, "lib"), recovered=True).persist()


@query(
    "broken_errors",
    _per_project(["path", "line"], [("three.py", 8), ("three.py", 16), ("three.py", 23), ("open.py", 2), ("empty.py", 2)]),
)
def broken_errors(spark, sf_dir):
    """G1: every syntax error of a file."""
    return X.syntax_errors(_broken(spark, sf_dir)).select("project", "path", "line")


@query(
    "broken_functions",
    _per_project(
        ["path", "name", "line"],
        [("three.py", "first", 4), ("three.py", "last", 26), ("three.py", "Kept.good", 13), ("three.py", "Kept.after", 19), ("open.py", "one", 1), ("open.py", "two", 5), ("empty.py", "shown", 6), ("fine.py", "fine", 1)],
    ),
)
def broken_functions(spark, sf_dir):
    """B5, B9 of files with errors: what stands between and around them, at its
    lines (only the statement with the error goes)."""
    a = _broken(spark, sf_dir)
    fns = X.functions(a).select("project", "path", "name", "line")
    return fns.unionByName(X.methods(a).select("project", "path", F.concat_ws(".", "class_name", "name").alias("name"), "line"))


def _stubs(spark, sf_dir):
    return H.api_docs(X.analyze_files(file_corpus(spark, sf_dir, STUB_FILES, "lib")).persist())


@query(
    "stub_modules",
    _per_project(["name", "source_file", "short_description", "n_exports"], [("pkg", "pkg/__init__.py", "-", 0), ("pkg.m", "pkg/m.py", "Module of {s}.", 32)]),
)
def stub_modules(spark, sf_dir):
    """A module with a stub is one record, with all its exports."""
    d = _stubs(spark, sf_dir).where("object_type = 'module'")
    return d.select("project", "name", "source_file", F.coalesce("short_description", F.lit("-")).alias("short_description"), F.size("methods").cast("long").alias("n_exports"))


_ASKED = [
    ("pkg.m.A.run", None, "from pkg.m import run"),
    ("pkg.m", None, "import pkg.m"),
    ("pkg.m.B.gone", "Attribute error: module 'pkg.m' has no attribute 'B'", None),
    ("pkg.m.A.gone", "Attribute error: type object 'A' has no attribute 'gone'", None),
    ("pkg.gone", "Attribute error: module 'pkg' has no attribute 'gone'", None),
    ("other.thing", "Could not resolve 'other.thing': module not found", None),
    ("", "Empty name provided", None),
]


@query("lookup_errors", _per_project(["object_name", "error", "import_statement"], [(n, e or "-", i or "-") for n, e, i in _ASKED]))
def lookup_errors(spark, sf_dir):
    """H2, H9: why a name is not found, and where from a found one is imported."""
    docs = _stubs(spark, sf_dir)
    names = F.array(*[F.lit(n) for n, _, _ in _ASKED])
    req = docs.select("project").distinct().select("project", F.posexplode(names).alias("n", "object_name")).select(F.concat_ws("/", "project", "n").alias("request_id"), "project", "object_name")
    r = H.resolve_names(docs.where("source_file not like '%.pyi'"), req)
    return r.select("project", "object_name", F.coalesce("error", F.lit("-")).alias("error"), F.coalesce("doc.import_statement", F.lit("-")).alias("import_statement"))
