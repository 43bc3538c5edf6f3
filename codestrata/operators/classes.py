"""Class hierarchies over a project (H11, F3, F4, F7): bases through imports,
method resolution order, members with where they come from.

Bases are resolved like any imported name: in the file, or through import
bindings and re-exports of any length. The order of a class merges those of its
bases, so classes are done in rounds, each one a join of the open classes with
the finished ones: as many rounds as the deepest hierarchy has levels.

A class in a circle of bases, or whose bases disagree on the order, has no
order in Python either; it gets itself and then what its bases have in the order
they are named, with ``consistent`` false. Bases outside the project are left
out. Of two classes with one full name the module's own one counts, then the
last one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .diagnostics import bindings
from .extract import KEY_COLS, method_signature
from .graph import _checkpoint, module_name
from .joins import by_merge
from .scopes import attribute_uses
from .symbols import _import_names, _reexports, resolve_import_targets

ORDER_TYPE = T.StructType([T.StructField("mro", T.ArrayType(T.StringType())), T.StructField("consistent", T.BooleanType())])
#: Decorators (last part of the name) that make a method an attribute.
PROPERTIES = ("property", "cached_property", "setter", "getter", "deleter")


def class_table(analysis: DataFrame) -> DataFrame:
    """One row a class: ``(project, class_name, module, path, line, body_id, bases)``."""
    c = analysis.select(*KEY_COLS, module_name(F.col("path")).alias("module"), F.explode("classes").alias("c")).select(
        *KEY_COLS, "module", F.concat_ws(".", "module", "c.name").alias("class_name"), F.col("c.line").cast("long").alias("line"), F.col("c.scope_id").alias("scope_id"), F.col("c.body_id").alias("body_id"), F.col("c.bases").alias("bases")
    )
    last = F.max_by(F.struct("path", "module", "line", "body_id", "bases"), F.struct(F.col("scope_id") == 0, "line", "path"))
    return c.groupBy("project", "class_name").agg(last.alias("x")).select("project", "class_name", "x.*")


def class_bases(analysis: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``(project, class_name, pos, base)``: bases inside the project."""
    classes = classes if classes is not None else class_table(analysis)
    named = classes.select("project", "path", "module", "class_name", F.posexplode("bases").alias("pos", "text"))
    # type arguments aside; calls and other expressions name no class
    named = named.withColumn("text", F.regexp_extract("text", r"^([A-Za-z_][\w.]*)(\[.*)?$", 1)).where("text != ''")
    named = named.withColumn("first", F.substring_index("text", ".", 1))
    imports = _import_names(analysis)
    own = imports.where("scope_id = 0").groupBy("project", "path", F.col("name").alias("first")).agg(F.max_by("target", "line").alias("imported"))
    aimed = named.join(by_merge(own), ["project", "path", "first"], "left").select(
        "project", "class_name", "pos", F.coalesce(F.concat("imported", F.expr("substring(text, length(first) + 1)")), F.concat_ws(".", "module", "text")).alias("target")
    )
    aimed = _checkpoint(aimed)
    finals = resolve_import_targets(aimed.select("project", "target"), _reexports(imports))
    found = aimed.join(by_merge(finals), ["project", "target"]).join(by_merge(classes.select("project", F.col("class_name").alias("final"))), ["project", "final"])
    return found.select("project", "class_name", "pos", F.col("final").alias("base"))


def merge_orders(own: str, bases: list[list[str]]) -> tuple[list[str], bool]:
    """The order of a class from those of its bases (each begins with the base):
    always the first head that no other list has further on."""
    lists = [list(b) for b in bases] + [[b[0] for b in bases]]
    out = [own]
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None or head == own:
            return list(dict.fromkeys([own, *(c for b in bases for c in b)])), False
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    return out, len(set(b[0] for b in bases)) == len(bases)


@F.pandas_udf(ORDER_TYPE)
def _merged(own: pd.Series, bases: pd.Series, good: pd.Series) -> pd.DataFrame:
    rows = [merge_orders(o, [list(x) for x in b]) for o, b in zip(own, bases)]
    return pd.DataFrame({"mro": [r[0] for r in rows], "consistent": [r[1] and bool(g) for r, g in zip(rows, good)]})


def class_orders(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """``(project, class_name, mro, consistent)`` of every class."""
    edges = _checkpoint(bases.where("class_name != base"))
    counts = edges.groupBy("project", "class_name").agg(F.count("*").alias("n"))
    every = classes.select("project", "class_name")
    alone = every.join(by_merge(counts), ["project", "class_name"], "left_anti")
    done = _checkpoint(alone.select("project", "class_name", F.array("class_name").alias("mro"), F.lit(True).alias("consistent")))
    todo = _checkpoint(counts)
    while not todo.isEmpty():
        ready = edges.join(by_merge(todo), ["project", "class_name"]).join(by_merge(done.select("project", F.col("class_name").alias("base"), "mro", "consistent")), ["project", "base"])
        ready = ready.groupBy("project", "class_name", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "mro"))).alias("b"), F.bool_and("consistent").alias("good")).where(F.size("b") == F.col("n"))
        merged = ready.select("project", "class_name", _merged(F.col("class_name"), F.transform("b", lambda x: x["mro"]), F.col("good")).alias("m"))
        new = _checkpoint(merged.select("project", "class_name", "m.mro", "m.consistent"))
        if new.isEmpty():
            break  # what is left hangs on circles
        done = done.unionByName(new)
        todo = _checkpoint(todo.join(by_merge(new), ["project", "class_name"], "left_anti"))
    left = todo.select("project", "class_name", F.array("class_name").alias("mro"), F.lit(False).alias("consistent"))
    return done.unionByName(left)


def own_members(analysis: DataFrame) -> DataFrame:
    """Methods and annotated attributes that class bodies define: ``(project,
    class_name, name, kind, path, line, signature, description, params)``; of one
    name the last definition."""
    c = analysis.select(*KEY_COLS, module_name(F.col("path")).alias("module"), F.explode("classes").alias("c"))
    c = c.select(*KEY_COLS, F.concat_ws(".", "module", "c.name").alias("class_name"), F.col("c.line").alias("class_line"), "c")
    prop = F.exists("m.decorators", lambda d: F.substring_index(d, ".", -1).isin(*PROPERTIES))
    methods = c.select(*KEY_COLS, "class_name", "class_line", F.explode("c.methods").alias("m")).select(
        *KEY_COLS, "class_name", "class_line", F.col("m.name").alias("name"), F.when(prop, "property").otherwise("method").alias("kind"), F.col("m.line").cast("long").alias("line"),
        method_signature(F.col("m")).alias("signature"), F.col("m.description").alias("description"), F.col("m.params").alias("params"),
    )
    attributes = c.select(*KEY_COLS, "class_name", "class_line", F.explode("c.attributes").alias("a")).select(
        *KEY_COLS, "class_name", "class_line", F.col("a.name").alias("name"), F.lit("attribute").alias("kind"), F.col("a.line").cast("long").alias("line"),
        F.col("a.type").alias("signature"), F.lit(None).cast("string").alias("description"), F.lit(None).cast(methods.schema["params"].dataType).alias("params"),
    )
    both = methods.unionByName(attributes)
    last = F.max_by(F.struct("kind", "path", "line", "signature", "description", "params"), F.struct("class_line", "line", "path"))
    return both.groupBy("project", "class_name", "name").agg(last.alias("m")).select("project", "class_name", "name", "m.*")


def class_members(analysis: DataFrame) -> DataFrame:
    """Every member that a class has, inherited ones too: ``(project,
    class_name, name, kind, defined_in, depth, path, line, signature,
    description, params)``; the nearest definition in the class's order."""
    classes = _checkpoint(class_table(analysis))
    orders = class_orders(classes, class_bases(analysis, classes))
    steps = orders.select("project", "class_name", F.posexplode("mro").alias("depth", "defined_in"))
    own = own_members(analysis).withColumnRenamed("class_name", "defined_in")
    met = steps.join(by_merge(own), ["project", "defined_in"])
    best = F.min_by(F.struct("kind", "defined_in", "depth", "path", "line", "signature", "description", "params"), "depth")
    return met.groupBy("project", "class_name", "name").agg(best.alias("m")).select("project", "class_name", "name", "m.*")


def with_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """H11 records: ``methods`` and ``attributes`` of classes as lists of
    ``(name, signature, description, defined_in)`` in name order, inherited ones
    included; properties are no methods, private names and most of those with
    two underscores are left out."""
    public = ~F.col("name").startswith("_") | ((F.col("kind") == "method") & F.col("name").isin("__init__", "__call__", "__enter__", "__exit__"))
    item = F.struct("name", "signature", "description", "defined_in")
    shown = members.where(public).groupBy("project", F.col("class_name").alias("name_")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "method", item))).alias("methods_"), F.array_sort(F.collect_list(F.when(F.col("kind") == "attribute", item))).alias("attributes_")
    )
    kind = "array<struct<name:string,signature:string,description:string,defined_in:string>>"
    same = (docs.project == shown.project) & (docs.name == F.col("name_")) & (F.col("object_type") == "class")
    rest = [docs[c] for c in docs.columns if c not in ("methods", "attributes")]
    none = F.array().cast(kind)
    return docs.join(by_merge(shown), same, "left").select(*rest, F.coalesce("methods_", none).alias("methods"), F.coalesce("attributes_", none).alias("attributes"))


def member_uses(analysis: DataFrame, members: DataFrame) -> DataFrame:
    """Uses of members with the class that defines them: ``self.m`` (whatever a
    method calls its first parameter), ``C.m`` of a class in the file, and dotted
    uses of imported classes. ``(project, path, line, column, name, class_name,
    defined_in, full_name, def_path, def_line, params)``."""
    a = attribute_uses(analysis).where("resolved_id is not null").withColumnRenamed("resolved_id", "scope_id")
    one = a.where(F.col("rest").rlike(r"^\.[^.]+$")).withColumn("member", F.expr("substring(rest, 2)"))
    b = analysis.select(*KEY_COLS, F.explode("bindings").alias("b")).select(*KEY_COLS, F.col("b.scope_id").alias("scope_id"), F.col("b.name").alias("name"), F.col("b.kind").alias("kind"), F.col("b.of_class").alias("body_id"))
    bodies = analysis.select(*KEY_COLS, module_name(F.col("path")).alias("module"), F.explode("classes").alias("c")).select(*KEY_COLS, F.col("c.body_id").alias("body_id"), F.concat_ws(".", "module", "c.name").alias("class_name"))
    selves = b.where("body_id is not null").join(by_merge(bodies), [*KEY_COLS, "body_id"]).select(*KEY_COLS, "scope_id", "name", "class_name").distinct()
    by_self = one.join(by_merge(selves), [*KEY_COLS, "scope_id", "name"]).select(*KEY_COLS, "line", "column", "class_name", F.col("member").alias("name"))
    local = b.where("kind = 'class' and scope_id = 0").select(*KEY_COLS, "scope_id", "name").distinct()
    by_name = one.join(by_merge(local), [*KEY_COLS, "scope_id", "name"]).select(*KEY_COLS, "line", "column", F.concat_ws(".", module_name(F.col("path")), "name").alias("class_name"), F.col("member").alias("name"))
    imports = _import_names(analysis)
    named = imports.select("project", "path", "scope_id", "name", "target").distinct()
    dotted = a.join(by_merge(named), [*KEY_COLS, "scope_id", "name"]).select(
        *KEY_COLS, "line", "column", F.substring_index("rest", ".", -1).alias("name"), F.concat("target", F.expr("substring(rest, 1, length(rest) - length(substring_index(rest, '.', -1)) - 1)")).alias("target")
    )
    finals = resolve_import_targets(dotted.select("project", "target"), _reexports(imports))
    by_import = dotted.join(by_merge(finals), ["project", "target"]).select(*KEY_COLS, "line", "column", F.col("final").alias("class_name"), "name")
    met = by_self.unionByName(by_name).unionByName(by_import).join(
        by_merge(members.select("project", "class_name", "name", "defined_in", F.col("path").alias("def_path"), F.col("line").alias("def_line"), "params")), ["project", "class_name", "name"]
    )
    return met.select(*KEY_COLS, "line", "column", "name", "class_name", "defined_in", F.concat_ws(".", "defined_in", "name").alias("full_name"), "def_path", "def_line", "params")


def method_help(analysis: DataFrame, members: DataFrame) -> DataFrame:
    """F7 for methods: every call of a member that :func:`member_uses` finds,
    with the parameters of the definition it reaches."""
    calls = analysis.select(*KEY_COLS, F.explode("calls").alias("c")).where(F.col("c.callee").contains(".")).select(
        *KEY_COLS, F.col("c.line").cast("long").alias("call_line"), F.col("c.col").cast("long").alias("call_column"), F.col("c.name_line").cast("long").alias("line"),
        F.col("c.name_col").cast("long").alias("column"), F.col("c.n_args").alias("n_args"), F.col("c.keywords").alias("keywords"),
    )
    met = calls.join(by_merge(member_uses(analysis, members).where("params is not null")), [*KEY_COLS, "line", "column"])
    shown = F.filter("params", lambda p: ~p["name"].isin("self", "cls"))
    return met.select(
        *KEY_COLS, F.col("call_line").alias("line"), F.col("call_column").alias("column"), F.col("name").alias("callee"), "full_name", "def_path", "def_line", shown.alias("params"), "n_args", "keywords",
        (F.least(F.col("n_args"), F.size(shown)) - 1).cast("long").alias("active_parameter"),
    )
