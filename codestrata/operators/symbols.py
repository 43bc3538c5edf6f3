"""Symbol analytics (F1-F9): editor calls re-aimed as corpus joins.

``symbols`` are definitions (functions, classes, methods, module-level
assignments); ``bindings``/``uses`` come from the extraction pass with their
scopes resolved per file. References and definitions are equi-joins on
``(project, path, scope, name)`` and on import targets across files, so a
project-wide "find references" is one shuffle join, not a per-cursor scan.
Resolution is static (imports and scopes), not type inference.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .diagnostics import bindings
from .extract import KEY_COLS
from .graph import module_name, resolve_relative
from .joins import by_merge
from .scopes import attribute_uses, uses


def absolute_target(path, target):
    """An import binding's target, with leading dots resolved in its file."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    return F.when(dots > 0, resolve_relative(path, F.expr("ltrim('.', target)"), dots)).otherwise(target)


def symbols(analysis: DataFrame) -> DataFrame:
    """one row per definition with its dotted ``full_name`` and its whole
    docstring."""
    mod = module_name(F.col("path"))
    base = analysis.select(*KEY_COLS, mod.alias("module"), "functions", "classes", "bindings")
    fns = base.select(*KEY_COLS, "module", F.explode("functions").alias("f")).select(
        *KEY_COLS, "module", F.col("f.name").alias("name"), F.lit("function").alias("type"),
        F.concat_ws(".", "module", "f.qualname").alias("full_name"),
        F.when(F.col("f.nested"), F.regexp_replace("f.qualname", r"\.[^.]+$", "")).otherwise(F.lit("<module>")).alias("scope"), F.col("f.scope_id").alias("scope_id"),
        F.col("f.line").cast("long").alias("line"), F.lit(None).cast("long").alias("column"),
        F.col("f.description").alias("description"), F.col("f.docstring"),
    )
    cls = base.select(*KEY_COLS, "module", F.explode("classes").alias("c"))
    classes = cls.select(
        *KEY_COLS, "module", F.col("c.name").alias("name"), F.lit("class").alias("type"), F.concat_ws(".", "module", "c.name").alias("full_name"),
        F.lit("<module>").alias("scope"), F.col("c.scope_id").alias("scope_id"), F.col("c.line").cast("long").alias("line"), F.lit(None).cast("long").alias("column"),
        F.col("c.description").alias("description"), F.col("c.docstring"),
    )
    methods = cls.select(*KEY_COLS, "module", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m")).select(
        *KEY_COLS, "module", F.col("m.name").alias("name"), F.lit("function").alias("type"), F.concat_ws(".", "module", "cls", "m.name").alias("full_name"),
        F.col("cls").alias("scope"), F.col("m.scope_id").alias("scope_id"), F.col("m.line").cast("long").alias("line"), F.lit(None).cast("long").alias("column"),
        F.col("m.description").alias("description"), F.col("m.docstring"),
    )
    stmts = base.select(*KEY_COLS, "module", F.explode("bindings").alias("b")).where((F.col("b.scope_id") == 0) & (F.col("b.kind") == "assign")).select(
        *KEY_COLS, "module", F.col("b.name").alias("name"), F.lit("statement").alias("type"), F.concat_ws(".", "module", "b.name").alias("full_name"),
        F.lit("<module>").alias("scope"), F.lit(0).alias("scope_id"), F.col("b.line").cast("long").alias("line"), F.col("b.col").cast("long").alias("column"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("docstring"),
    ).dropDuplicates(["project", "full_name"])
    return fns.unionByName(classes).unionByName(methods).unionByName(stmts)


def search_symbols(syms: DataFrame, query: str) -> DataFrame:
    """``name``, dotted suffix (``a.b``) or ``type name`` queries."""
    q = query.strip()
    parts = q.split(None, 1)
    if len(parts) == 2 and parts[0] in ("class", "function", "def", "statement", "module"):
        t = "function" if parts[0] == "def" else parts[0]
        return syms.where((F.col("type") == t) & (F.col("name") == parts[1]))
    if "." in q:
        return syms.where((F.col("full_name") == q) | F.col("full_name").endswith("." + q))
    return syms.where(F.col("name") == q)


def _import_names(analysis: DataFrame) -> DataFrame:
    """Import bindings, targets absolute."""
    b = bindings(analysis).where(F.col("kind") == "import")
    return b.withColumn("target", absolute_target(F.col("path"), F.col("target")))


def _reexports(imports: DataFrame) -> DataFrame:
    """Module-level imports as names of their module: ``(project, target, next_target)``."""
    return imports.where(F.col("scope_id") == 0).select(
        "project", F.concat_ws(".", module_name(F.col("path")), F.col("name")).alias("target"), F.col("target").alias("next_target")
    )


def _attribute_targets(analysis: DataFrame, imports: DataFrame) -> DataFrame:
    """Dotted uses whose first name is imported, as ``(project, path, line,
    column, name, target)``: ``import a.b; a.b.f`` has target ``a.b.f``."""
    a = attribute_uses(analysis).where(F.col("resolved_id").isNotNull()).withColumnRenamed("resolved_id", "scope_id")
    named = imports.select("project", "path", "scope_id", "name", "target").distinct()
    return a.join(by_merge(named), ["project", "path", "scope_id", "name"]).select(
        "project", "path", "line", "column", F.substring_index("rest", ".", -1).alias("name"), F.concat("target", "rest").alias("target")
    )


def references(analysis: DataFrame, syms: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """``(project, full_name, path, line, column, kind)`` for every
    definition: the definition itself, same-file uses that resolve to it,
    imports of it in other files, through re-exports of any length, the uses of
    those imports and dotted uses of imported modules (``pkg.mod.f``). With
    ``members`` (of ``classes.class_members``) the uses of methods and attributes
    through ``self`` and through classes, which go to the class that defines
    them."""
    from pyspark import StorageLevel

    from .graph import _checkpoint

    syms = syms if syms is not None else symbols(analysis)
    b = _import_names(analysis)
    # read by the rounds and three branches below: written once, so that no plan holds its parts again
    dotted = _checkpoint(_attribute_targets(analysis, b))
    finals = resolve_import_targets(b.select("project", "target").unionByName(dotted.select("project", "target")), _reexports(b))
    u = uses(analysis).where(F.col("resolved_id").isNotNull())
    # the symbol table is a four-branch union read three times below: derive once
    d = syms.select("project", "path", "module", "name", "scope_id", "full_name", "line", "column").persist(StorageLevel.MEMORY_AND_DISK)
    # same-file uses resolving to the definition's scope
    local = u.join(by_merge(d.select("project", "path", F.col("scope_id").alias("resolved_id"), "name", "full_name").distinct()), ["project", "path", "resolved_id", "name"]).select(
        "project", "full_name", "path", "line", "column", F.lit("use").alias("kind")
    )
    # imports of the definition in other files
    named = _checkpoint(finals.join(by_merge(d.select("project", F.col("full_name").alias("final"), "full_name").distinct()), ["project", "final"]).select("project", "target", "full_name"))
    imp = b.join(by_merge(named), ["project", "target"])
    dotted_rows = dotted.join(by_merge(named), ["project", "target"]).select("project", "full_name", "path", "line", "column", F.lit("use").alias("kind"))
    imp_rows = imp.select("project", "full_name", "path", "line", "column", F.lit("import").alias("kind"))
    imp_uses = u.join(by_merge(imp.select("project", "path", F.col("scope_id").alias("resolved_id"), "name", "full_name")), ["project", "path", "resolved_id", "name"]).select(
        "project", "full_name", "path", "line", "column", F.lit("use").alias("kind")
    )
    defs = d.select("project", "full_name", "path", "line", "column", F.lit("definition").alias("kind"))
    out = defs.unionByName(local).unionByName(imp_rows).unionByName(imp_uses).unionByName(dotted_rows)
    if members is None:
        return out
    from .classes import member_uses

    used = member_uses(analysis, members).select("project", "full_name", "path", "line", "column", F.lit("use").alias("kind"))
    return out.unionByName(used).distinct()


def goto(analysis: DataFrame) -> DataFrame:
    """for every use, the in-file binding it resolves to (no import
    following): ``(project, path, line, column, name, def_line, def_kind, target)``."""
    u = uses(analysis).where(F.col("resolved_id").isNotNull()).select("project", "path", "line", "column", "name", F.col("resolved_id").alias("scope_id"))
    b = bindings(analysis).withColumn("target", absolute_target(F.col("path"), F.col("target"))).groupBy("project", "path", "scope_id", "name").agg(F.min_by(F.struct("line", "kind", "target"), "line").alias("b"))
    return u.join(by_merge(b), ["project", "path", "scope_id", "name"]).select(
        "project", "path", "line", "column", "name", F.col("b.line").alias("def_line"), F.col("b.kind").alias("def_kind"), F.col("b.target").alias("target")
    )


def resolve_import_targets(targets: DataFrame, reexports: DataFrame) -> DataFrame:
    """Follow ``(project, target)`` names through module-level re-exports
    (``reexports(project, target, next_target)``) to their end. The names are
    written once, so a round's plan holds none of the joins that found them.
    Only names that are re-exports move. Every round doubles
    the steps a pointer spans, so a chain of any length takes a logarithm of
    rounds, and a round ends them when no pointer has moved; a name that only
    leads in a circle keeps whatever it reached when all steps are spanned."""
    from .graph import _checkpoint

    every = _checkpoint(targets.select("project", "target").distinct())
    jump = reexports.select("project", F.col("target").alias("final"), F.col("next_target").alias("to")).distinct()
    cur = _checkpoint(every.join(by_merge(jump.select("project", F.col("final").alias("target"))), ["project", "target"], "left_semi"))
    if cur.isEmpty():
        return every.withColumn("final", F.col("target"))
    still = every.join(by_merge(cur), ["project", "target"], "left_anti").withColumn("final", F.col("target"))
    cur, jump = cur.withColumn("final", F.col("target")), _checkpoint(jump)
    for _ in range(max(1, jump.count()).bit_length()):
        step = cur.join(by_merge(jump), ["project", "final"], "left")
        moved = step.groupBy("project", "target", F.coalesce("to", "final").alias("final")).agg(F.max(F.coalesce(F.col("to") != F.col("final"), F.lit(False))).alias("moved"))
        cur = _checkpoint(moved)
        if cur.where("moved").isEmpty():
            break
        cur = cur.drop("moved")
        onward = jump.select("project", F.col("final").alias("to"), F.col("to").alias("further"))
        jump = _checkpoint(jump.join(by_merge(onward), ["project", "to"], "left").select("project", "final", F.coalesce("further", "to").alias("to")).distinct())
    return still.unionByName(cur.select("project", "target", "final"))


def definitions(analysis: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """like :func:`goto`, then import bindings and dotted uses of imported
    modules are followed to the symbol they name, through re-exports of any
    length; with ``members``, uses of methods and attributes to the class that
    defines them."""
    from .graph import _checkpoint

    g = goto(analysis)
    syms = symbols(analysis).select("project", F.col("full_name").alias("final"), F.col("path").alias("def_path"), F.col("line").alias("def_line2"), "type")
    imports = _import_names(analysis)
    imp = g.where(F.col("def_kind") == "import").select("project", "path", "line", "column", "name", "target")
    imp = _checkpoint(imp.unionByName(_attribute_targets(analysis, imports)))
    finals = resolve_import_targets(imp.select("project", "target"), _reexports(imports))
    resolved = (
        imp.join(by_merge(finals), ["project", "target"])
        .join(by_merge(syms), ["project", "final"])
        .withColumn("def_name", F.element_at(F.split("final", r"\."), -1))
        .drop("final")
    )
    local = g.where(F.col("def_kind") != "import").select(
        "project", "path", "line", "column", "name", F.lit(None).cast("string").alias("target"), F.col("path").alias("def_path"),
        F.col("def_line").alias("def_line2"), F.col("def_kind").alias("type"), F.col("name").alias("def_name"),
    )
    out = local.unionByName(resolved).withColumnRenamed("def_line2", "def_line")
    if members is None:
        return out
    from .classes import member_uses

    used = member_uses(analysis, members).select(
        *KEY_COLS, "line", "column", "name", F.col("full_name").alias("target"), "def_path", "def_line", F.when(F.col("params").isNull(), "statement").otherwise("function").alias("type"), F.col("name").alias("def_name")
    )
    return out.join(by_merge(used), [*KEY_COLS, "line", "column"], "left_anti").unionByName(used.distinct())


def completions(syms: DataFrame, requests: DataFrame) -> DataFrame:
    """F8: ``requests(request_id, project, module, prefix)`` -> visible
    module-level names of that module starting with the prefix.

    An equi-join on the prefix: names are cut to the lengths that requests for
    their module have, so a request meets its answers alone. An empty prefix
    asks for every name of the module."""
    s = syms.where(F.col("scope") == "<module>").select("project", "module", "name", "type")
    r = requests.withColumn("_n", F.coalesce(F.length("prefix"), F.lit(0)))
    lengths = r.select("project", "module", "_n").distinct()
    cut = s.join(by_merge(lengths), ["project", "module"]).where(F.length("name") >= F.col("_n")).withColumn("_p", F.substring("name", F.lit(1), F.col("_n")))
    return r.withColumn("_p", F.coalesce("prefix", F.lit(""))).join(by_merge(cut.drop("_n")), ["project", "module", "_p"]).select("request_id", "name", "type")


RENAME_TYPE = T.StructType(
    [T.StructField("project", T.StringType()), T.StructField("path", T.StringType()), T.StructField("n_changes", T.LongType()), T.StructField("old_text", T.StringType()), T.StructField("new_text", T.StringType())]
)


def rename(files: DataFrame, refs: DataFrame, full_name: str, new_name: str) -> DataFrame:
    """rewrite every reference of ``full_name`` to ``new_name``; an empty
    new name is an error."""
    if not new_name:
        raise ValueError("new name must not be empty")
    spark = files.sparkSession
    one = F.broadcast(spark.createDataFrame([(full_name, new_name)], "full_name string, new_name string"))
    return rename_batch(files, refs, one)


def _spans(raw: bytes, column: int | None, kind: str, old: bytes) -> list[tuple[int, int]]:
    """Where the name stands in the line: at its column if that is known, after
    ``def``/``class`` for other definitions, after ``import`` for imports. A use
    whose text is another name (an alias) has none."""
    import re

    word = rb"(?<![\w.\x80-\xff])" + re.escape(old) + rb"(?![\w\x80-\xff])"
    if column is not None:
        m = re.compile(re.escape(old) + rb"(?![\w\x80-\xff])").match(raw, column)
        if m or kind == "use":
            return [m.span()] if m else []
    if kind == "definition":
        m = re.search(rb"\b(?:def|class)\s+(" + re.escape(old) + rb")(?![\w\x80-\xff])", raw)
        return [m.span(1)] if m else []
    keyword = re.search(rb"\bimport\b", raw)
    return [m.span() for m in re.finditer(word, raw) if m.start() >= (keyword.end() if keyword else 0) and not re.search(rb"\bas\s+$", raw[: m.start()])]


def splice_names(text: str, edits: list[dict]) -> tuple[int, str]:
    """Replace names by position, from the right, so names can be swapped."""
    import re

    parts = re.split(r"(\r\n|\r|\n)", text)
    found: dict[int, dict[tuple[int, int], bytes]] = {}
    for e in edits:
        at = 2 * (int(e["line"]) - 1)
        if 0 <= at < len(parts):
            for span in _spans(parts[at].encode(), e["column"], e["kind"], e["old_name"].encode()):
                found.setdefault(at, {})[span] = e["new_name"].encode()
    for at, spans in found.items():
        raw = parts[at].encode()
        for (a, z), new in sorted(spans.items(), reverse=True):
            raw = raw[:a] + new + raw[z:]
        parts[at] = raw.decode(errors="replace")
    return sum(map(len, found.values())), "".join(parts)


def rename_batch(files: DataFrame, refs: DataFrame, renames: DataFrame) -> DataFrame:
    """F9 at corpus scale: ``renames(full_name, new_name)``, with a ``project``
    column if they are for one project each, joined to the reference table; the
    edits of a file are collected in the JVM (bounded by the file), joined to
    its text, and an Arrow-batched ``mapInArrow`` splices them by line and
    column: strings, comments and attributes of the same name stay. Empty new
    names are an error. Returns ``(project, path, n_changes, old_text,
    new_text)``; feed it to ``line_diff``."""
    empty = F.coalesce(F.length("new_name"), F.lit(0)) == 0
    r = renames.withColumn("new_name", F.when(empty, F.raise_error(F.lit("new name must not be empty"))).otherwise(F.col("new_name")))
    r = r.withColumn("old_name", F.element_at(F.split("full_name", r"\."), -1))
    pos = by_merge(refs).join(r, [c for c in ("project", "full_name") if c in r.columns]).select("project", "path", "line", "column", "kind", "old_name", "new_name").distinct()
    per_file = pos.groupBy("project", "path").agg(F.collect_list(F.struct("line", "column", "kind", "old_name", "new_name")).alias("edits"))
    joined = files.select("project", "path", "text").join(by_merge(per_file), ["project", "path"])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(RENAME_TYPE)

    def splice(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for d in b.to_pylist():
                n, new = splice_names(d["text"] or "", d["edits"] or [])
                out.append({"project": d["project"], "path": d["path"], "n_changes": n, "old_text": d["text"], "new_text": new})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return joined.select("project", "path", "text", "edits").mapInArrow(splice, RENAME_TYPE)


HUNK_TYPE = T.StructType(
    [T.StructField("project", T.StringType()), T.StructField("path", T.StringType()), T.StructField("hunk", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("old_start", "old_lines", "new_start", "new_lines")]
    + [T.StructField("text", T.StringType())]
)


def diff_hunks(changed: DataFrame, context: int = 3) -> DataFrame:
    """the changes of every file (``project, path, old_text, new_text``, as
    from :func:`rename`) as hunks, numbered from 1; unchanged files have none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(HUNK_TYPE)

    def run(batches):
        import pyarrow as pa

        from codestrata.functions import diff as D

        for b in batches:
            rows = [
                {"project": d["project"], "path": d["path"], "hunk": n, **h}
                for d in b.to_pylist()
                for n, h in enumerate(D.hunks(d["old_text"] or "", d["new_text"] or "", context), 1)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return changed.select("project", "path", "old_text", "new_text").mapInArrow(run, HUNK_TYPE)


def unified_diff(hunks: DataFrame) -> DataFrame:
    """``(project, path, diff)``: a file's hunks as one unified diff."""

    def span(start, lines):
        return F.when(F.col(lines) == 1, F.col(start).cast("string")).otherwise(F.concat(F.col(start).cast("string"), F.lit(","), F.col(lines).cast("string")))

    text = F.concat(F.lit("@@ -"), span("old_start", "old_lines"), F.lit(" +"), span("new_start", "new_lines"), F.lit(" @@\n"), F.col("text"))
    per = hunks.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("hunk", text.alias("text")))).alias("h"))
    return per.select("project", "path", F.concat(F.lit("--- "), "path", F.lit("\n+++ "), "path", F.lit("\n"), F.array_join(F.transform("h", lambda x: x["text"]), "")).alias("diff"))


def hover(analysis: DataFrame, docs: DataFrame) -> DataFrame:
    """every resolved use with its definition's documentation record
    (``docs`` is the H1 index keyed by dotted ``name``)."""
    d = definitions(analysis)
    syms = symbols(analysis).select(
        "project", F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.col("name").alias("def_name"), F.col("full_name").alias("target_name")
    )
    d = d.join(by_merge(syms), ["project", "def_path", "def_line", "def_name"], "left")
    doc = docs.select("project", F.col("name").alias("target_name"), "signature", "docstring", "short_description")
    return d.join(by_merge(doc), ["project", "target_name"], "left")


def signature_help(analysis: DataFrame) -> DataFrame:
    """for every call of a simple name that resolves (in-file or through
    an import) to a known function: callee, its parameters (without
    ``self``/``cls``), the number of positional arguments given and the
    active parameter index (last filled position, -1 when none)."""
    calls = analysis.select(*KEY_COLS, F.explode("calls").alias("c")).select(
        *KEY_COLS, F.col("c.callee").alias("name"), F.col("c.scope").alias("scope"), F.col("c.line").cast("long").alias("line"),
        F.col("c.col").cast("long").alias("column"), F.col("c.n_args").alias("n_args"), F.col("c.keywords").alias("keywords"),
    ).where(~F.col("name").contains("."))
    defs = definitions(analysis).select(*KEY_COLS, "line", "column", "name", "def_path", "def_line")
    j = calls.join(by_merge(defs), [*KEY_COLS, "line", "column", "name"])
    fn = analysis.select("project", F.col("path").alias("def_path"), F.explode("functions").alias("f")).select(
        "project", "def_path", F.col("f.line").cast("long").alias("def_line"), F.col("f.name").alias("callee"),
        F.filter("f.params", lambda p: ~p["name"].isin("self", "cls")).alias("params"), F.col("f.returns").alias("returns"),
    )
    out = j.join(by_merge(fn), ["project", "def_path", "def_line"])
    return out.select(
        *KEY_COLS, "line", "column", "callee", "def_path", "params", "n_args", "keywords",
        (F.least(F.col("n_args"), F.size("params")) - 1).cast("long").alias("active_parameter"),
    )
