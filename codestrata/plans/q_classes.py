"""Registered queries over class hierarchies and scopes: one project per
``supplier`` row, all with the same paths."""

from pyspark.sql import functions as F

from ..operators import classes as C
from ..operators import diagnostics as D
from ..operators import docs as H
from ..operators import extract as X
from ..operators import scopes as SC
from ..operators import symbols as S
from ..operators.joins import by_merge
from ..sources.corpus import CLASS_FILES, SCOPE_FILES, file_corpus
from .q_layout import _per_project
from .registry import query


def _classes(spark, sf_dir):
    return X.analyze_files(file_corpus(spark, sf_dir, CLASS_FILES, "lib")).persist()


def _scopes(spark, sf_dir):
    return X.analyze_files(file_corpus(spark, sf_dir, SCOPE_FILES, "lib")).persist()


_B, _L, _R = "shapes.base.Root", "shapes.left.Left", "shapes.right.Right"


@query(
    "class_orders",
    _per_project(
        ["class_name", "mro", "consistent"],
        [(_B, _B, "yes"), (_L, f"{_L}>{_B}", "yes"), (_R, f"{_R}>{_B}", "yes"), ("both.Both", f"both.Both>{_L}>{_R}>{_B}", "yes"), ("odd.A", "odd.A", "yes"), ("odd.B", "odd.B>odd.A", "yes"),
         ("odd.X", "odd.X>odd.A>odd.B", "no"), ("odd.P", "odd.P", "no"), ("odd.Q", "odd.Q", "no")],
    ),
)
def class_orders(spark, sf_dir):
    """A diamond over four files, bases that disagree, a circle."""
    a = _classes(spark, sf_dir)
    classes = C.class_table(a)
    o = C.class_orders(classes, C.class_bases(a, classes))
    return o.select("project", "class_name", F.array_join("mro", ">").alias("mro"), F.when(F.col("consistent"), "yes").otherwise("no").alias("consistent"))


@query(
    "class_members",
    _per_project(
        ["class_name", "name", "kind", "defined_in", "signature", "description"],
        [
            (c, *m)
            for c, own in {
                _B: {}, _L: {"step": ("method", _L, "step(this, n, twice) -> None", "Left step.")},
                _R: {"step": ("method", _R, "step(n) -> None", "-"), "stop": ("method", _R, "stop() -> None", "-"), "color": ("attribute", _R, "str", "-")},
                "both.Both": {"step": ("method", _L, "step(this, n, twice) -> None", "Left step."), "stop": ("method", _R, "stop() -> None", "-"), "color": ("attribute", _R, "str", "-"), "go": ("method", "both.Both", "go() -> None", "-")},
            }.items()
            for m in [(n, *v) for n, v in ({"run": ("method", _B, "run(n: int) -> int", "Run once."), "step": ("method", _B, "step(n: int) -> int", "-"), "size": ("attribute", _B, "int", "-"), "label": ("property", _B, "label() -> None", "-"), "_hidden": ("method", _B, "_hidden() -> None", "-")} | own).items()]
        ]
        + [("odd.A", "a", "method", "odd.A", "a() -> None", "-"), ("odd.B", "a", "method", "odd.A", "a() -> None", "-"), ("odd.X", "a", "method", "odd.A", "a() -> None", "-"), ("odd.P", "p", "method", "odd.P", "p() -> None", "-")],
    ),
)
def class_members(spark, sf_dir):
    """Inherited members with signature, description and origin."""
    m = C.class_members(_classes(spark, sf_dir))
    return m.select("project", "class_name", "name", "kind", "defined_in", "signature", F.coalesce("description", F.lit("-")).alias("description"))


@query(
    "class_docs",
    _per_project(
        ["name", "methods", "attributes"],
        [(_B, "run,step", "size"), (_L, "run,step", "size"), (_R, "run,step,stop", "color,size"), ("both.Both", "go,run,step,stop", "color,size"), ("odd.A", "a", ""), ("odd.B", "a", ""), ("odd.X", "a", ""), ("odd.P", "p", ""), ("odd.Q", "", "")],
    ),
)
def class_docs(spark, sf_dir):
    """The members of class records, in name order."""
    a = _classes(spark, sf_dir)
    d = C.with_members(H.api_docs(a), C.class_members(a)).where("object_type = 'class'")
    names = lambda c: F.array_join(F.transform(c, lambda m: m["name"]), ",").alias(c)
    return d.select("project", "name", names("methods"), names("attributes"))


@query(
    "method_references",
    _per_project(
        ["full_name", "path", "line", "kind"],
        [(f"{_B}.run", "shapes/base.py", 6, "definition"), (f"{_B}.run", "shapes/left.py", 7, "use"), (f"{_B}.run", "shapes/right.py", 11, "use"), (f"{_B}.run", "both.py", 10, "use"),
         (f"{_B}.step", "shapes/base.py", 10, "definition"), (f"{_B}.step", "shapes/base.py", 8, "use"), (f"{_L}.step", "shapes/left.py", 5, "definition"), (f"{_L}.step", "both.py", 7, "use"),
         (f"{_R}.step", "shapes/right.py", 7, "definition"), (f"{_R}.stop", "shapes/right.py", 10, "definition"), (f"{_R}.stop", "both.py", 7, "use"), (f"{_R}.stop", "user.py", 3, "use"), ("both.Both.go", "both.py", 6, "definition")],
    ),
)
def method_references(spark, sf_dir):
    """uses of methods go to the class that defines them."""
    a = _classes(spark, sf_dir)
    r = S.references(a, members=C.class_members(a))
    return r.where(F.substring_index("full_name", ".", -1).isin("run", "step", "stop", "go")).select("project", "full_name", "path", "line", "kind")


@query(
    "method_definitions",
    _per_project(
        ["path", "line", "name", "def_path", "def_line"],
        [("shapes/base.py", 8, "step", "shapes/base.py", 10), ("shapes/base.py", 11, "size", "shapes/base.py", 4), ("shapes/left.py", 7, "run", "shapes/base.py", 6), ("shapes/right.py", 11, "run", "shapes/base.py", 6),
         ("both.py", 7, "step", "shapes/left.py", 5), ("both.py", 7, "stop", "shapes/right.py", 10), ("both.py", 10, "run", "shapes/base.py", 6), ("user.py", 3, "stop", "shapes/right.py", 10)],
    ),
)
def method_definitions(spark, sf_dir):
    """from a use of a member to its definition."""
    a = _classes(spark, sf_dir)
    d = S.definitions(a, members=C.class_members(a))
    return d.where("name in ('run', 'step', 'stop', 'size')").select("project", "path", "line", "name", "def_path", F.col("def_line").cast("long").alias("def_line"))


@query(
    "method_help",
    _per_project(
        ["path", "line", "callee", "full_name", "params", "active_parameter"],
        [("shapes/base.py", 8, "step", f"{_B}.step", "n", 0), ("shapes/left.py", 7, "run", f"{_B}.run", "n", 0), ("shapes/right.py", 11, "run", f"{_B}.run", "n", 0),
         ("both.py", 7, "step", f"{_L}.step", "this,n,twice", 1), ("both.py", 7, "stop", f"{_R}.stop", "", -1), ("user.py", 3, "stop", f"{_R}.stop", "", -1)],
    ),
)
def method_help(spark, sf_dir):
    """calls of methods with the parameters of the definition they reach."""
    a = _classes(spark, sf_dir)
    h = C.method_help(a, C.class_members(a))
    return h.select("project", "path", "line", "callee", "full_name", F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"), "active_parameter")


@query(
    "scope_undefined",
    _per_project(["path", "line", "name"], [("same.py", 2, "b"), ("access.py", 6, "value"), ("access.py", 13, "limit"), ("access.py", 15, "limit"), ("outer.py", 20, "k"), ("imports.py", 11, "json")]),
)
def scope_undefined(spark, sf_dir):
    """Names of functions with the same name, accessors, class bodies."""
    return D.undefined_names(_scopes(spark, sf_dir)).select("project", "path", "line", "name")


@query("scope_unused", _per_project(["path", "line", "name"], [("outer.py", 1, "os"), ("outer.py", 2, "sys"), ("imports.py", 7, "json")]))
def scope_unused(spark, sf_dir):
    """An import hidden by a nearer one, and one of two like functions."""
    return D.unused_imports(_scopes(spark, sf_dir)).select("project", "path", "line", "name")


@query(
    "scope_goto",
    _per_project(
        ["path", "name", "line", "def_line"],
        [("same.py", "b", 6, 5), ("access.py", "x", 8, 5), ("access.py", "self", 10, 9), ("access.py", "value", 10, 9), ("access.py", "limit", 15, 2), ("outer.py", "os", 10, 6), ("outer.py", "m", 11, 19), ("outer.py", "inner", 14, 8), ("imports.py", "json", 3, 2)],
    ),
)
def scope_goto(spark, sf_dir):
    """the nearest binding that a use can see."""
    return S.goto(_scopes(spark, sf_dir)).select("project", "path", "name", "line", F.col("def_line").cast("long").alias("def_line"))


@query(
    "scope_rows",
    "SELECT 'lib' || CAST(s_suppkey AS VARCHAR) AS project, path, n_scopes, n_seen FROM supplier, "
    "(VALUES ('same.py', CAST(3 AS BIGINT), CAST(5 AS BIGINT)), ('access.py', 6, 11), ('outer.py', 4, 8), ('imports.py', 4, 7)) t(path, n_scopes, n_seen)",
)
def scope_rows(spark, sf_dir):
    """Scopes and their closure: how many scopes each file's scopes can see."""
    a = _scopes(spark, sf_dir)
    n = SC.scope_rows(a).groupBy("project", "path").agg(F.count("*").alias("n_scopes"))
    seen = SC.visible_scopes(a).groupBy("project", "path").agg(F.count("*").alias("n_seen"))
    return n.join(by_merge(seen), ["project", "path"])
