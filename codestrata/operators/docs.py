"""API-documentation index (H1-H16) built statically from the parsed corpus.

``api_docs`` holds one record per module, class, function and method,
keyed by dotted ``name``. Lookups are left joins of a request table; budget
and goal projections are column selections (Catalyst prunes the rest). The
only Python pieces are the docstring parsers for doctest examples and
``Raises`` sections, run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pyast import PARAM
from .extract import function_signature, method_signature
from .graph import module_name
from .joins import by_merge

EXAMPLE_TYPE = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("expected", T.StringType())]))
#: Names of a module that are held against each other, all with all, at most.
ALIKE = 64
RAISES_TYPE = T.ArrayType(T.StructType([T.StructField("exception", T.StringType()), T.StructField("description", T.StringType())]))


@F.pandas_udf(EXAMPLE_TYPE)
def doc_examples(docs: pd.Series) -> pd.Series:
    """H6: doctest ``>>>`` examples as (code, expected output)."""
    import doctest

    parser = doctest.DocTestParser()
    out = []
    for d in docs:
        rows = []
        if d:
            try:
                for ex in parser.get_examples(d):
                    rows.append({"code": ex.source.strip(), "expected": ex.want.strip()})
            except ValueError:
                pass
        out.append(rows)
    return pd.Series(out, dtype=object)


def _raises(doc: str) -> list[dict]:
    import re

    if not doc:
        return []
    sphinx = re.findall(r":raises?\s+([\w.]+):\s*(.*)", doc)
    if sphinx:
        return [{"exception": e, "description": d.strip()} for e, d in sphinx]
    out, in_section, cur = [], False, None
    for line in doc.split("\n"):
        stripped = line.strip()
        if stripped in ("Raises:", "Exceptions:", "Raises", "Exceptions"):
            in_section = True
            continue
        if not in_section:
            continue
        if stripped.endswith(":") and not line.startswith(" ") and stripped[:-1].replace(" ", "").isalpha():
            break  # next section
        if not stripped.strip("-"):
            continue  # blank, or the line under a heading
        indent = len(line) - len(line.lstrip(" "))
        m = re.match(r"^([\w.]+)\s*(?::\s*(.*))?$", stripped)
        if indent == 4 and m:
            cur = {"exception": m.group(1), "description": (m.group(2) or "").strip()}
            out.append(cur)
        elif indent > 4 and cur is not None:
            cur["description"] = (cur["description"] + " " + stripped).strip()
        elif indent < 4 and not line.startswith(" "):
            break
    return out


@F.pandas_udf(RAISES_TYPE)
def doc_raises(docs: pd.Series) -> pd.Series:
    """H7: Sphinx ``:raises X: d`` lines (if any), else entries of a
    ``Raises``/``Exceptions`` section at exactly four spaces, with indented
    continuation lines, until the next section."""
    return pd.Series([_raises(d) for d in docs], dtype=object)


def import_statement(name: Column, obj_type: Column) -> Column:
    """H9: ``import a`` / ``from a import b`` / ``from a.b import c``;
    builtins give ``# Built-in: x``."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, n - 1), ".")
    return (
        F.when(obj_type == "builtin", F.concat(F.lit("# Built-in: "), name))
        .when(n == 1, F.concat(F.lit("import "), name))
        .otherwise(F.concat(F.lit("from "), head, F.lit(" import "), F.element_at(parts, -1)))
    )


def docstring_signature(docstring: Column) -> Column:
    """H4: without a signature, the first of a docstring's first three lines
    that holds both brackets."""
    lines = F.transform(F.slice(F.split(docstring, "\n"), 1, 3), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: x.contains("(") & x.contains(")")), F.lit(0))


def defining_import(docs: DataFrame) -> DataFrame:
    """H9: ``import_statement`` with the module that defines the object: a
    method's own module is the one that can be imported from, not its class."""
    own = F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.element_at(F.split("name", r"\."), -1))
    return docs.withColumn("import_statement", F.when(F.col("name") == F.col("module"), F.concat(F.lit("import "), F.col("name"))).when(F.col("object_type") == "builtin", F.col("import_statement")).otherwise(own))


def api_docs(analysis: DataFrame) -> DataFrame:
    """One record per documented object. Functions, classes
    and methods come from one pass over the analysis, modules from another."""
    mod = module_name(F.col("path"))
    base = analysis.where(F.col("error").isNull()).select("project", "path", mod.alias("module"), "module_doc", "functions", "classes", exports_of().alias("exports"))
    kinds = {n: base.schema[n].dataType.elementType for n in ("functions", "classes")}
    method = kinds["classes"]["methods"].dataType.elementType

    def params(p: Column) -> Column:
        return F.transform(p, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["default"].alias("default"), x["required"].alias("required"), x["kind"].alias("kind")))

    def item(f=None, c=None, m=None, owner=None) -> Column:
        of = {"f": (f, kinds["functions"]), "c": (c, kinds["classes"]), "m": (m, method), "owner": (owner, "string")}
        return F.struct(*[(F.lit(None).cast(t) if v is None else v).alias(k) for k, (v, t) in of.items()])

    def each(items: Column) -> Column:
        return F.coalesce(items, F.array())

    fns = F.transform(F.filter("functions", lambda f: ~f["nested"]), lambda f: item(f=f))
    cls = F.transform("classes", lambda c: item(c=c))
    meths = F.flatten(F.transform("classes", lambda c: each(F.transform(c["methods"], lambda m: item(m=m, owner=c["name"])))))
    items = base.select("project", "path", "module", F.explode(F.concat(each(fns), each(cls), each(meths))).alias("o")).select("project", "path", "module", "o.*")

    def by_kind(f: Column, c: Column, m: Column) -> Column:
        return F.when(F.col("f").isNotNull(), f).when(F.col("c").isNotNull(), c).otherwise(m)

    def of_each(field: str) -> Column:
        return by_kind(F.col(f"f.{field}"), F.col(f"c.{field}"), F.col(f"m.{field}"))

    init = F.filter("c.methods", lambda m: m["name"] == "__init__")
    none = F.array().cast("array<string>")
    class_signature = F.when(F.size(init) > 0, F.concat(F.col("c.name"), F.regexp_extract(method_signature(init[0]), r"(\(.*\))", 1))).otherwise(F.concat(F.col("c.name"), F.lit("()")))
    class_params = F.when(F.size(init) > 0, params(F.filter(init[0]["params"], lambda p: ~p["name"].isin("self", "cls")))).otherwise(params(F.array().cast(f"array<{PARAM}>")))
    objects = items.select(
        "project", "path", "module", F.concat_ws(".", "module", "owner", of_each("name")).alias("name"),
        F.when(F.col("c").isNotNull(), F.lit("class")).otherwise(F.lit("function")).alias("object_type"),
        by_kind(function_signature(F.col("f")), class_signature, method_signature(F.col("m"))).alias("signature"),
        by_kind(params(F.col("f.params")), class_params, params(F.filter("m.params", lambda p: ~p["name"].isin("self", "cls")))).alias("parameters"),
        F.coalesce("f.returns", "m.returns").alias("returns"), of_each("docstring").alias("docstring"), of_each("description").alias("short_description"),
        by_kind(none, F.transform(F.filter("c.methods", lambda m: ~m["name"].startswith("_") | m["name"].isin("__init__", "__call__", "__enter__", "__exit__")), lambda m: m["name"]), none).alias("methods"),
        by_kind(none, F.transform(F.filter("c.attributes", lambda a: ~a["name"].startswith("_")), lambda a: a["name"]), none).alias("attributes"),
    )
    # a module may have a stub beside its source: one record, of the source
    own = F.min_by(F.struct("path", "module_doc", "exports"), F.struct(F.col("path").endswith(".pyi"), "path"))
    modules = base.groupBy("project", "module").agg(own.alias("m")).select("project", "m.path", "module", "m.module_doc", "m.exports").select(
        "project", "path", "module", F.col("module").alias("name"), F.lit("module").alias("object_type"), F.lit(None).cast("string").alias("signature"),
        F.array().cast(objects.schema["parameters"].dataType).alias("parameters"), F.lit(None).cast("string").alias("returns"),
        F.col("module_doc").alias("docstring"), F.trim(F.split("module_doc", "\n").getItem(0)).alias("short_description"),
        F.coalesce("exports", F.array().cast("array<string>")).alias("methods"), F.array().cast("array<string>").alias("attributes"),
    )
    docs = objects.unionByName(modules)
    docs = docs.withColumn("signature", F.coalesce("signature", F.when(F.col("object_type") != "module", docstring_signature(F.col("docstring")))))
    return defining_import(docs.withColumn("import_statement", import_statement(F.col("name"), F.col("object_type")))).withColumn("source_file", F.col("path"))


def with_doc_details(docs: DataFrame) -> DataFrame:
    """Adds ``examples`` (H6) and ``raises`` (H7) parsed from docstrings."""
    return docs.withColumn("examples", doc_examples(F.col("docstring"))).withColumn("raises", doc_raises(F.col("docstring")))


def exports_of(limit: int | None = None) -> Column:
    """H12 of one file: public module-level function and class names, sorted
    (``__all__`` when the module defines it); ``limit`` is for reports."""
    names = F.concat(
        F.transform(F.filter("functions", lambda f: ~f["nested"] & ~f["name"].startswith("_")), lambda f: f["name"]),
        F.transform(F.filter("classes", lambda c: ~c["name"].startswith("_")), lambda c: c["name"]),
    )
    ex = F.array_sort(F.array_distinct(F.when(F.size("dunder_all") > 0, F.col("dunder_all")).otherwise(names)))
    return F.slice(ex, 1, limit) if limit else ex


def module_exports(analysis: DataFrame, limit: int | None = None) -> DataFrame:
    """``(project, module, exports)``, whole unless a report asks for the
    first ``limit`` (the reference shows 20)."""
    return analysis.select("project", module_name(F.col("path")).alias("module"), exports_of(limit).alias("exports"))


def _runs(s: Column) -> Column:
    """The distinct runs of one, two and three letters of a name."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.array(*[F.substring(s, i, F.lit(n)) for n in (1, 2, 3)])))
    return F.array_distinct(runs)


def see_also(docstring: Column) -> Column:
    """Names listed in a ``See Also`` section (numpydoc/Google style):
    identifiers at the start of each entry, in order."""
    sec = F.regexp_extract(docstring, r"(?s)See Also:?[ \t]*\n(?:[ \t]*-+[ \t]*\n)?(.*?)(?:\n[ \t]*\n|$)", 1)
    items = F.split(F.regexp_replace(sec, r"\n", ","), ",")
    names = F.transform(items, lambda x: F.regexp_extract(F.trim(x), r"^([A-Za-z_][\w.]*)", 1))
    return F.filter(names, lambda x: x != "")


def related(docs: DataFrame, limit: int = 5) -> DataFrame:
    """H8: up to ``limit`` related names per documented object: ``See Also``
    entries first (in order), then public members of the same module whose
    short names contain each other (case-insensitive), in name order.

    Members of a module with at most ``ALIKE`` names are held against each other
    where they are. In a larger one a name holds every run of three letters of the
    names it contains (names of one or two letters are runs themselves), so an
    equi-join on ``(project, module, run)`` finds all pairs. A contained name is
    joined on the run of its own that the fewest names of the module hold, so names
    with a common beginning (``get_*``) do not all meet."""
    from ..plans.topk import top_k_per_group

    from pyspark import StorageLevel

    short = F.lower(F.element_at(F.split("name", r"\."), -1))
    # derived once: the doc index comes from the parsed corpus and is read
    # several times below (sizes, names, candidates, See Also entries)
    d = (
        docs.where(F.col("object_type").isin("function", "class"))
        .select("project", "module", "name", short.alias("s"), "docstring")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    member = (F.col("name") == F.concat_ws(".", "module", F.element_at(F.split("name", r"\."), -1))) & ~F.col("s").startswith("_") & (F.col("s") != "")
    members = d.where(member & F.col("project").isNotNull() & F.col("module").isNotNull()).select("project", "module", "name", "s")
    sizes = members.groupBy("project", "module").agg((F.count("*") > ALIKE).alias("large"))
    members = members.join(by_merge(sizes), ["project", "module"]).persist(StorageLevel.MEMORY_AND_DISK)

    few = members.where(~F.col("large")).groupBy("project", "module").agg(F.collect_set(F.struct("name", "s")).alias("all"))

    def others(x: Column) -> Column:
        alike = F.filter("all", lambda y: (y["name"] != x["name"]) & (x["s"].contains(y["s"]) | y["s"].contains(x["s"])))
        return F.slice(F.array_sort(F.transform(alike, lambda y: y["name"])), 1, limit)  # all of a name are here: no more of them can rank

    near = few.select("project", F.explode(F.transform("all", lambda x: F.struct(x["name"].alias("name"), others(x).alias("others")))).alias("x"))
    near = near.select("project", "x.name", F.explode("x.others").alias("other"))

    subs = members.where("large").select("project", "module", "name", "s", F.explode(_runs(F.col("s"))).alias("sub"))
    held = subs.groupBy("project", "module", "sub").agg(F.count("*").alias("n"))
    whole = subs.where(F.length("sub") == F.least(F.length("s"), F.lit(3)))
    rarest = whole.join(by_merge(held), ["project", "module", "sub"]).groupBy("project", "module", "name").agg(F.min(F.struct("n", "sub", "s")).alias("r"))
    parts = rarest.select("project", "module", F.col("name").alias("other"), F.col("r.s").alias("part"), F.col("r.sub").alias("sub"))
    contained = subs.join(by_merge(parts), ["project", "module", "sub"]).where((F.col("name") != F.col("other")) & F.col("s").contains(F.col("part")))
    both = F.array(F.struct("name", "other"), F.struct(F.col("other").alias("name"), F.col("name").alias("other")))
    far = contained.select("project", F.explode(both).alias("x")).select("project", "x.name", "x.other").distinct()

    pairs = near.unionByName(far).select("project", "name", "other", F.lit(1).alias("prio"), F.lit(0).alias("pos"))
    sa = d.select("project", "name", F.posexplode(see_also(F.col("docstring"))).alias("pos", "other")).select(
        "project", "name", "other", F.lit(0).alias("prio"), "pos"
    )
    allr = sa.unionByName(pairs)
    top = top_k_per_group(allr, ["project", "name"], ["prio", "pos", "other"], limit)
    return top.groupBy("project", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("related")
    )


def builtin_docs(spark) -> DataFrame:
    """Records for the interpreter's builtin names (bounded literal table):
    ``object_type = builtin``, ``import_statement = # Built-in: x``."""
    import builtins

    names = sorted(n for n in dir(builtins) if not n.startswith("_"))
    b = spark.createDataFrame([(n,) for n in names], "name string")
    return b.select(
        F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("path"), F.lit("builtins").alias("module"), "name",
        F.lit("builtin").alias("object_type"), F.lit(None).cast("string").alias("signature"),
        F.array().cast(f"array<struct<name:string,type:string,default:string,required:boolean,kind:string>>").alias("parameters"),
        F.lit(None).cast("string").alias("returns"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("short_description"),
        F.array().cast("array<string>").alias("methods"), F.array().cast("array<string>").alias("attributes"),
        import_statement(F.col("name"), F.lit("builtin")).alias("import_statement"), F.lit(None).cast("string").alias("source_file"),
    )


def resolve_names(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """H2: ``requests(request_id, object_name)`` -> the record of the longest
    module prefix that exists, the rest as attribute path; requests with a
    ``project`` are answered from that project (and the builtins) alone.
    Builtin names resolve first (pass
    ``docs.unionByName(builtin_docs(spark))``). Unknown names get ``found =
    false`` and say why in ``error``: no name, no such module, or a module
    without that attribute."""
    parts = F.split("object_name", r"\.")
    own = ["project"] if "project" in requests.columns else []
    pref = requests.select(
        "request_id", *own, "object_name",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("prefix")))).alias("p"),
    ).select("request_id", *own, "object_name", "p.n", "p.prefix")
    # how far the name goes along existing modules, and along existing objects:
    # the error names the last one
    known = docs.where("object_type is not null").groupBy(*own, F.col("name").alias("prefix")).agg(
        F.max(F.struct("name", "object_type")).alias("at"), F.max(F.col("object_type") == "module").alias("is_module")
    )
    best = pref.join(by_merge(known), [*own, "prefix"]).groupBy("request_id").agg(
        F.max_by("prefix", F.when(F.col("is_module"), F.col("n"))).alias("module"), F.max_by("at", "n").alias("reached")
    )
    r = requests.join(by_merge(best), "request_id", "left")
    d = docs.select(F.col("name").alias("_name"), F.struct(*docs.columns).alias("doc"))

    def told(df: DataFrame) -> DataFrame:
        df = df.withColumn("found", F.col("_name").isNotNull())
        name, last = F.col("object_name"), F.col("reached.name")
        missing = F.get(F.split(F.expr("substring(object_name, length(reached.name) + 2)"), r"\."), F.lit(0))
        holder = F.when(F.col("reached.object_type") == "module", F.concat(F.lit("module '"), last, F.lit("'"))).otherwise(F.concat(F.lit("type object '"), F.element_at(F.split(last, r"\."), -1), F.lit("'")))
        error = (
            F.when(F.col("found"), F.lit(None))
            .when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("Empty name provided"))
            .when(last.isNotNull(), F.concat(F.lit("Attribute error: "), holder, F.lit(" has no attribute '"), missing, F.lit("'")))
            .otherwise(F.concat(F.lit("Could not resolve '"), name, F.lit("': module not found")))
        )
        return df.withColumn("error", error).drop("reached", "_name")

    if not own:
        return told(r.join(by_merge(d), F.col("object_name") == F.col("_name"), "left"))
    # joined by project and name: names that all projects have would meet in every
    # pair of projects. A record without a project is given to each that asks for it
    asked = requests.select(F.col("project").alias("_project"), "object_name").distinct()
    everywhere = d.where("doc.project is null").join(by_merge(asked), F.col("_name") == F.col("object_name")).drop("object_name")
    d = d.where("doc.project is not null").withColumn("_project", F.col("doc.project")).unionByName(everywhere)
    same = F.col("project").eqNullSafe(F.col("_project")) & (F.col("object_name") == F.col("_name"))
    return told(r.join(by_merge(d), same, "left").drop("_project"))


# Fields kept per budget and per task goal.
COMMON_FIELDS = ["name", "found", "object_type", "import_statement", "signature", "short_description", "source_file"]
GOAL_FIELDS = {
    "implementation": ["name", "found", "import_statement", "signature", "parameters", "returns", "examples"],
    "debugging": ["name", "found", "signature", "short_description", "raises", "source_file", "related"],
    "refactor": ["name", "found", "signature", "parameters", "returns", "related", "methods", "attributes", "source_file"],
    "testing": ["name", "found", "signature", "parameters", "returns", "raises", "examples"],
    "research": ["name", "found", "object_type", "import_statement", "signature", "short_description", "source_file", "related", "examples"],
}


def apply_budget(docs: DataFrame, budget: str) -> DataFrame:
    """``short`` keeps 5 parameters as (name, required), 1 example, 3
    related; ``medium`` 15 parameters, 2 examples, 5 raises, 5 related, 15
    methods, 10 attributes plus returns; ``full`` keeps everything."""
    if budget == "full":
        return docs
    if budget not in ("short", "medium"):
        raise ValueError(f"unknown budget {budget!r}")
    cols = [c for c in COMMON_FIELDS if c in docs.columns]
    have = set(docs.columns)
    if budget == "short":
        extra = []
        if "parameters" in have:
            extra.append(F.transform(F.slice("parameters", 1, 5), lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["required"], F.lit(True)).alias("required"))).alias("parameters"))
        for c, n in (("examples", 1), ("related", 3)):
            if c in have:
                extra.append(F.slice(c, 1, n).alias(c))
        return docs.select(*cols, *extra)
    extra = [F.col("returns")] if "returns" in have else []
    for c, n in (("parameters", 15), ("examples", 2), ("raises", 5), ("related", 5), ("methods", 15), ("attributes", 10)):
        if c in have:
            extra.append(F.slice(c, 1, n).alias(c))
    return docs.select(*cols, *extra)


def apply_goal(docs: DataFrame, goal: str, budget: str = "medium") -> DataFrame:
    """Keep the goal's field set (short budgets also drop source file,
    methods and attributes)."""
    if goal not in GOAL_FIELDS:
        raise ValueError(f"task_goal must be one of: {', '.join(sorted(GOAL_FIELDS))}")
    keep = list(GOAL_FIELDS[goal])
    if budget == "short":
        keep = [k for k in keep if k not in ("source_file", "methods", "attributes")]
    return docs.select(*[c for c in keep if c in docs.columns]).withColumn("task_goal", F.lit(goal))
