"""Entity extraction (B1-B17): one Arrow-batched parse per file, then Catalyst.

``analyze_files`` is the only Python step: ``mapInArrow`` streams record
batches of ``(project, path, text)`` through stdlib ``ast`` and yields the
nested ``analysis`` columns. Everything else in this module is ``explode``/
``transform``/``filter`` on those columns, evaluated in the JVM.

Persist (or write) the result of ``analyze_files`` when several reports read it:
parsing is by far the most expensive step and must happen once per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pyast

KEY_COLS = ["project", "path"]


FINDINGS_DDL = "array<struct<rule_id:string,line:long,column:long,end_line:long,text:string,message:string,severity:string>>"


def analysis_schema(extra: T.StructType | None = None, with_findings: bool = False) -> T.StructType:
    base = T.StructType([T.StructField("project", T.StringType()), T.StructField("path", T.StringType())])
    if extra:
        for f in extra.fields:
            base.add(f)
    parsed = T._parse_datatype_string(pyast.ANALYSIS_DDL)
    for f in parsed.fields:
        base.add(f)
    if with_findings:
        base.add("findings", T._parse_datatype_string(FINDINGS_DDL))
    return base


def _parse_batches(with_dump: bool, carry: list[str], arrow_schema, python_only: bool = True, rules=None, recovered: bool = False):
    def run(batches):
        import pyarrow as pa

        from codestrata.functions import pattern as PT
        from codestrata.functions import pyast as P

        for batch in batches:
            d = batch.to_pydict()
            rows = []
            for i, text in enumerate(d["text"]):
                path = d["path"][i] or ""
                if python_only and not path.endswith((".py", ".pyi")):
                    rec = P.analyze(None)
                    rec["error"] = f"Not a Python file: {path}"
                else:
                    rec = P.analyze(text, with_dump, keep_tree=rules is not None, recovered=recovered)
                tree = rec.pop("_tree", None)
                if rules is not None:
                    found = []
                    if tree is not None:
                        try:
                            for rid, pat, msg, sev in rules:
                                for m in PT.find_matches(pat, tree, text or ""):
                                    found.append({"rule_id": rid, "line": m["start_line"], "column": m["start_col"], "end_line": m["end_line"], "text": m["text"], "message": msg, "severity": sev})
                        except RecursionError:
                            found = []
                    rec["findings"] = found
                rec["project"] = d["project"][i]
                rec["path"] = d["path"][i]
                for c in carry:
                    rec[c] = d[c][i]
                rows.append(rec)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return run


def analyze_files(
    files: DataFrame, with_dump: bool = False, carry: list[str] | None = None, python_only: bool = True, rules=None, recovered: bool = False
) -> DataFrame:
    """``files(project, path, text, ...)`` -> ``analysis`` rows (one per file).

    ``carry`` names extra input columns passed through unchanged (e.g. the
    line count computed JVM-side). The text itself is not carried: join back
    on ``(project, path)`` when a report needs it. With ``python_only`` (B2),
    files not ending in ``.py``/``.pyi`` get an error row instead of a parse.
    ``rules`` (a rule list, YAML text, or ``"default"``) adds a ``findings``
    column evaluated in the same task, so analysis plus lint is one pass. With
    ``recovered``, a file with syntax errors keeps what stands between them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..session import prepare

    prepare(files.sparkSession)
    carry = list(carry or [])
    extra = T.StructType([files.schema[c] for c in carry]) if carry else None
    compiled = None
    if rules is not None:
        from ..functions import pattern as PT
        from .structural import _rule_rows

        rows = _rule_rows(None if rules == "default" else rules)
        compiled = [(rid, PT.compile_pattern(p), msg, sev) for rid, p, msg, sev in rows if p and p.strip()]
    schema = analysis_schema(extra, with_findings=compiled is not None)
    fn = _parse_batches(with_dump, carry, to_arrow_schema(schema), python_only, compiled, recovered)
    return files.select("project", "path", "text", *carry).mapInArrow(fn, schema)


# ---------------------------------------------------------------------------
# Per-file columns
# ---------------------------------------------------------------------------


def stdlib_array() -> Column:
    """Standard-library top-level module names as a literal array (bounded:
    a few hundred names, independent of the data)."""
    return F.array(*[F.lit(m) for m in sorted(pyast.STDLIB_MODULES)])


def top(module: Column) -> Column:
    return F.split(module, r"\.").getItem(0)


def third_party_expr() -> Column:
    """Sorted distinct first components of ``import`` and non-empty ``from``
    modules that are not standard library (relative modules included)."""
    tops = F.concat(
        F.transform("imports", lambda x: top(x["module"])),
        F.transform(F.filter("from_imports", lambda x: x["module"] != ""), lambda x: top(x["module"])),
    )
    return F.array_sort(F.array_except(F.filter(tops, lambda t: t != ""), stdlib_array()))


def function_signature(fn: Column) -> Column:
    """``name(p: T, q) -> R``; parameters whose name starts with ``self`` are
    left out, unannotated return is ``None``."""
    ps = F.filter(fn["params"], lambda p: ~p["name"].startswith("self"))
    return _sig(fn, ps)


def method_signature(m: Column) -> Column:
    ps = F.filter(m["params"], lambda p: ~p["name"].isin("self", "cls"))
    return _sig(m, ps)


def _sig(fn: Column, ps: Column) -> Column:
    parts = F.transform(ps, lambda p: F.when(p["type"].isNull(), p["name"]).otherwise(F.concat(p["name"], F.lit(": "), p["type"])))
    return F.concat(fn["name"], F.lit("("), F.array_join(parts, ", "), F.lit(") -> "), F.coalesce(fn["returns"], F.lit("None")))


def file_summary(analysis: DataFrame, extra: tuple = ()) -> DataFrame:
    """One row per file: counts, description, third-party names, error (B2,
    B16, C1); ``extra`` names carried columns to keep (e.g. ``n_lines``)."""
    return analysis.select(
        *extra,
        "project",
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "error",
        F.size("functions").cast("long").alias("n_functions"),
        F.size("classes").cast("long").alias("n_classes"),
        (F.size("imports") + F.size("from_imports")).cast("long").alias("n_imports"),
        F.trim(F.split(F.col("module_doc"), "\n").getItem(0)).alias("description"),
        third_party_expr().alias("third_party"),
        F.slice("variables", 1, 10).alias("variables"),
        "decorators_used",
    )


# ---------------------------------------------------------------------------
# Exploded entity tables
# ---------------------------------------------------------------------------


def imports(analysis: DataFrame) -> DataFrame:
    """One row per ``import`` alias."""
    return analysis.select(*KEY_COLS, F.explode("imports").alias("i")).select(*KEY_COLS, "i.module", "i.alias", "i.line")


def from_imports(analysis: DataFrame) -> DataFrame:
    """One row per imported name of a ``from`` statement."""
    return (
        analysis.select(*KEY_COLS, F.explode("from_imports").alias("i"))
        .select(*KEY_COLS, "i.module", "i.level", "i.line", F.explode("i.names").alias("n"))
        .select(*KEY_COLS, "module", "level", "line", F.col("n.name").alias("name"), F.col("n.alias").alias("alias"))
    )


def functions(analysis: DataFrame) -> DataFrame:
    """Module-level and nested functions (no methods)."""
    f = F.col("f")
    return analysis.select(*KEY_COLS, F.explode("functions").alias("f")).select(
        *KEY_COLS,
        f["name"].alias("name"),
        f["qualname"].alias("qualname"),
        f["line"].cast("long").alias("line"),
        f["is_async"].alias("is_async"),
        f["returns"].alias("returns"),
        f["decorators"].alias("decorators"),
        f["description"].alias("description"),
        f["docstring"].alias("docstring"),
        F.size(f["params"]).cast("long").alias("n_params"),
        function_signature(f).alias("signature"),
        f["params"].alias("params"),
    )


def params(analysis: DataFrame) -> DataFrame:
    """Parameters of functions in declaration order (``position`` 0-based)."""
    return (
        analysis.select(*KEY_COLS, F.explode("functions").alias("f"))
        .select(*KEY_COLS, F.col("f.name").alias("function"), F.posexplode("f.params").alias("position", "p"))
        .select(*KEY_COLS, "function", F.col("position").cast("long").alias("position"), "p.name", "p.type", "p.default", "p.kind", "p.keyword_only", "p.variadic", "p.required")
    )


def classes(analysis: DataFrame) -> DataFrame:
    """Classes with bases and counts."""
    c = F.col("c")
    return analysis.select(*KEY_COLS, F.explode("classes").alias("c")).select(
        *KEY_COLS,
        c["name"].alias("name"),
        c["line"].cast("long").alias("line"),
        c["bases"].alias("bases"),
        c["decorators"].alias("decorators"),
        c["description"].alias("description"),
        F.size(c["methods"]).cast("long").alias("n_methods"),
        F.size(c["attributes"]).cast("long").alias("n_attributes"),
    )


def methods(analysis: DataFrame) -> DataFrame:
    """Direct-body methods of classes with their signature."""
    m = F.col("m")
    return (
        analysis.select(*KEY_COLS, F.explode("classes").alias("c"))
        .select(*KEY_COLS, F.col("c.name").alias("class_name"), F.explode("c.methods").alias("m"))
        .select(
            *KEY_COLS,
            "class_name",
            m["name"].alias("name"),
            m["line"].cast("long").alias("line"),
            m["is_async"].alias("is_async"),
            m["returns"].alias("returns"),
            m["decorators"].alias("decorators"),
            m["description"].alias("description"),
            method_signature(m).alias("signature"),
            m["params"].alias("params"),
            m["docstring"].alias("docstring"),
        )
    )


def attributes(analysis: DataFrame) -> DataFrame:
    """Annotated class attributes."""
    return (
        analysis.select(*KEY_COLS, F.explode("classes").alias("c"))
        .select(*KEY_COLS, F.col("c.name").alias("class_name"), F.explode("c.attributes").alias("a"))
        .select(*KEY_COLS, "class_name", "a.name", "a.type", "a.default", F.col("a.line").cast("long").alias("line"))
    )


def variables(analysis: DataFrame, first: int | None = None, width: int | None = None) -> DataFrame:
    """Assigned public names with their whole values; a report may show the
    ``first`` of a file and so many characters (the reference 10 and 50)."""
    arr = F.slice("variables", 1, first) if first else F.col("variables")
    value = F.substring("v.value", 1, width) if width else F.col("v.value")
    return analysis.select(*KEY_COLS, F.posexplode(arr).alias("pos", "v")).select(
        *KEY_COLS, "v.name", F.col("v.line").cast("long").alias("line"), "v.type", value.alias("value")
    )


def findings(analysis: DataFrame) -> DataFrame:
    """E4 rows from an analysis made with ``rules=``: same columns as
    ``structural.check_rules``."""
    return analysis.select(*KEY_COLS, F.explode("findings").alias("f")).select(
        *KEY_COLS, "f.rule_id", "f.line", "f.column", "f.end_line", "f.text", "f.message", "f.severity"
    )


def syntax_errors(analysis: DataFrame) -> DataFrame:
    """G1: one row for every syntax error of a file (see ``pyast.recover``), or
    for the reason why it could not be parsed at all."""
    only = F.array(F.struct(F.col("error").alias("message"), F.col("error_line").alias("line"), F.col("error_col").alias("col"), F.col("error_end_line").alias("end_line"), F.col("error_end_col").alias("end_col")))
    e = analysis.where(F.col("error").isNotNull()).select(*KEY_COLS, F.explode(F.when(F.size("errors") > 0, F.col("errors")).otherwise(only)).alias("e"))
    return e.select(
        *KEY_COLS,
        F.col("e.line").cast("long").alias("line"),
        F.col("e.col").cast("long").alias("column"),
        F.col("e.end_line").cast("long").alias("end_line"),
        F.col("e.end_col").cast("long").alias("end_column"),
        F.lit("error").alias("severity"),
        F.lit("syntax").alias("source"),
        F.col("e.message").alias("message"),
    )
