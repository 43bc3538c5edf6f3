"""Diagnostics (G1-G7): syntax errors from the extraction pass, undefined
names and unused imports by anti-joins over the ``bindings``/``uses``
columns, ingestion of external checker logs, merging and summaries.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyast import BUILTIN_NAMES
from .extract import KEY_COLS, syntax_errors
from .joins import by_merge
from .scopes import resolve, uses

DIAG_COLS = ["project", "path", "line", "column", "severity", "source", "message"]


def builtins_array() -> Column:
    """Builtin names of the interpreter (bounded literal, ~160 names)."""
    return F.array(*[F.lit(n) for n in sorted(BUILTIN_NAMES | set(dir(builtins)))])


def bindings(analysis: DataFrame) -> DataFrame:
    return analysis.select(*KEY_COLS, "dunder_all", F.explode("bindings").alias("b")).select(
        *KEY_COLS, "dunder_all", "b.name", "b.scope", "b.scope_id", "b.kind", F.col("b.line").cast("long").alias("line"), F.col("b.col").cast("long").alias("column"), "b.target"
    )


def undefined_names(analysis: DataFrame) -> DataFrame:
    """Uses bound nowhere in their scope chain and not builtins; files
    with a star import are skipped (any name may come from it)."""
    u = uses(analysis.where(~F.col("star_import"))).where(F.col("resolved_id").isNull())
    u = u.where(~F.array_contains(builtins_array(), F.col("name")))
    return u.select(
        *KEY_COLS, "line", "column", F.lit("error").alias("severity"), F.lit("pyflakes").alias("source"),
        F.concat(F.lit("undefined name '"), F.col("name"), F.lit("'")).alias("message"), "name",
    )


def unused_imports(analysis: DataFrame) -> DataFrame:
    """Import bindings with no use resolving to them (same file, scope and
    name); names listed in ``__all__`` count as used."""
    # ``from __future__ import x`` is a compiler directive, never "unused"
    b = bindings(analysis).where((F.col("kind") == "import") & ~F.coalesce(F.col("target"), F.lit("")).startswith("__future__."))
    used = resolve(analysis, "uses").where(F.col("resolved_id").isNotNull()).select(*KEY_COLS, F.col("resolved_id").alias("scope_id"), "name").distinct()
    un = b.join(by_merge(used), [*KEY_COLS, "scope_id", "name"], "left_anti").where(~((F.col("scope_id") == 0) & F.array_contains("dunder_all", F.col("name"))))
    return un.select(
        *KEY_COLS, "line", "column", F.lit("warning").alias("severity"), F.lit("pyflakes").alias("source"),
        F.concat(F.lit("'"), F.coalesce("target", "name"), F.lit("' imported but unused")).alias("message"), "name",
    )


def run_diagnostics(analysis: DataFrame, syntax_only: bool = False, type_logs: DataFrame | None = None) -> DataFrame:
    """Syntax errors always, static checks unless ``syntax_only``, checker
    logs when given; one row per finding, order by ``(path, line, column)``."""
    syn = syntax_errors(analysis).select(*DIAG_COLS)
    out = syn
    if not syntax_only:
        out = out.unionByName(undefined_names(analysis).select(*DIAG_COLS)).unionByName(unused_imports(analysis).select(*DIAG_COLS))
    if type_logs is not None:
        out = out.unionByName(type_logs.select(*DIAG_COLS))
    return out


def file_summary(diags: DataFrame) -> DataFrame:
    """Per file totals and the sources that found something."""
    sev = F.col("severity")
    return diags.groupBy(*KEY_COLS).agg(
        F.count("*").cast("long").alias("total"),
        F.count_if(sev == "error").cast("long").alias("errors"),
        F.count_if(sev == "warning").cast("long").alias("warnings"),
        F.count_if(sev == "info").cast("long").alias("info"),
        F.array_sort(F.collect_set("source")).alias("sources_used"),
    )


def project_diagnostics(files: DataFrame, diags: DataFrame) -> DataFrame:
    """Per project files checked (all Python files), files with errors or
    warnings (info-only files do not count) and totals."""
    per = file_summary(diags).where((F.col("errors") + F.col("warnings")) > 0)
    checked = files.where(F.col("path").endswith(".py")).groupBy("project").agg(F.count("*").cast("long").alias("files_checked"))
    tot = per.groupBy("project").agg(
        F.count("*").cast("long").alias("files_with_issues"),
        F.sum("errors").cast("long").alias("errors"),
        F.sum("warnings").cast("long").alias("warnings"),
        F.sum("info").cast("long").alias("info"),
    )
    return checked.join(by_merge(tot), "project", "left").fillna(0, ["files_with_issues", "errors", "warnings", "info"])


def type_checker_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Secondary checker rows only for files where the primary found none;
    files are told apart by project too where both sides have one."""
    keys = [c for c in ("project", "path") if c in primary.columns and c in secondary.columns]
    return primary.unionByName(secondary.join(by_merge(primary.select(*keys).distinct()), keys, "left_anti"))


# ---------------------------------------------------------------------------
# A5-A7 checker log ingestion: raw(value) lines -> diagnostics
# ---------------------------------------------------------------------------


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse_pyflakes(raw: DataFrame) -> DataFrame:
    """A5: ``file:line[:col]: message``; severity error iff the message
    mentions "undefined" or "syntax"; unparseable lines dropped."""
    p = F.split(F.col("value"), ":", 4)
    n = F.size(p)
    line = _int(F.get(p, 1))
    col3 = _int(F.get(p, 2))
    has_col = (n >= 4) & col3.isNotNull()
    msg = F.when(n >= 4, F.when(has_col, F.trim(F.get(p, 3))).otherwise(F.trim(F.concat_ws(":", F.get(p, 2), F.get(p, 3))))).otherwise(F.trim(F.get(p, 2)))
    low = F.lower(msg)
    out = raw.select(
        F.get(p, 0).alias("path"),
        line.cast("long").alias("line"),
        F.when(has_col, col3).otherwise(F.lit(0)).cast("long").alias("column"),
        F.when(low.contains("undefined") | low.contains("syntax"), "error").otherwise("warning").alias("severity"),
        F.lit("pyflakes").alias("source"),
        msg.alias("message"),
        (n >= 3).alias("_ok"),
    )
    return out.where(F.col("_ok") & F.col("line").isNotNull()).drop("_ok")


def parse_mypy(raw: DataFrame) -> DataFrame:
    """``file:line[:col]: severity: message``; error/warning, note -> info."""
    p = F.split(F.col("value"), ":", 5)
    n = F.size(p)
    line = _int(F.get(p, 1))
    col3 = _int(F.get(p, 2))
    five = (n >= 5) & col3.isNotNull()
    sev_s = F.when(five, F.trim(F.get(p, 3))).otherwise(F.trim(F.get(p, 2)))
    msg = F.when(five, F.trim(F.get(p, 4))).when(n >= 5, F.trim(F.concat_ws(":", F.get(p, 3), F.get(p, 4)))).otherwise(F.trim(F.coalesce(F.get(p, 3), F.lit(""))))
    sev = F.when(sev_s.contains("note"), "info").when(sev_s.contains("error"), "error").otherwise("warning")
    out = raw.select(
        F.get(p, 0).alias("path"), line.cast("long").alias("line"), F.when(five, col3).otherwise(F.lit(0)).cast("long").alias("column"),
        sev.alias("severity"), F.lit("mypy").alias("source"), msg.alias("message"), (n >= 4).alias("_ok"),
    )
    return out.where(F.col("_ok") & F.col("line").isNotNull()).drop("_ok")


PYRIGHT_SCHEMA = (
    "generalDiagnostics array<struct<file:string,severity:string,message:string,rule:string,"
    "range:struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>>>"
)


def parse_pyright(raw: DataFrame) -> DataFrame:
    """Pyright JSON report(s) -> one row per diagnostic; 0-based lines
    become 1-based; missing severity is ``error``."""
    j = F.from_json(F.col("value"), PYRIGHT_SCHEMA)
    d = raw.select(F.explode(j["generalDiagnostics"]).alias("d"))
    return d.select(
        F.col("d.file").alias("path"),
        (F.coalesce(F.col("d.range.start.line"), F.lit(0)) + 1).cast("long").alias("line"),
        F.coalesce(F.col("d.range.start.character"), F.lit(0)).cast("long").alias("column"),
        F.coalesce(F.col("d.severity"), F.lit("error")).alias("severity"),
        F.lit("pyright").alias("source"),
        F.col("d.message").alias("message"),
        F.col("d.rule").alias("rule"),
    )
