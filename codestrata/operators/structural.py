"""Structural search, lint rules and rewrites.

Patterns and the rule table are tiny and fixed per call: they are compiled on
the driver and shipped inside the task closure (a broadcast of a bounded
value). Files stream through ``mapInArrow``; a literal-token prefilter
(``contains``) runs first in the JVM so only candidate files reach Python.
All counting and ordering afterwards is DataFrame work.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pattern as PT
from .joins import by_merge

# The default rule table (id, pattern, message, severity).
DEFAULT_RULES = [
    (
        "bare-except",
        "try:\n    $$$BODY\nexcept:\n    $$$HANDLER",
        "Bare 'except:' catches all exceptions including KeyboardInterrupt and SystemExit. Use 'except Exception:' instead.",
        "warning",
    ),
    (
        "assert-without-message",
        "assert $COND",
        "Assert without a message makes debugging harder. Add a descriptive message: assert condition, 'description'.",
        "info",
    ),
    (
        "broad-exception-catch",
        "except Exception:\n    $$$HANDLER",
        "Catching bare 'Exception' is too broad. Catch specific exception types when possible.",
        "info",
    ),
    ("print-statement", "print($$$ARGS)", "Consider using the logging module instead of print() for production code.", "info"),
    (
        "star-import",
        "from $MODULE import *",
        "Wildcard imports pollute the namespace and make it unclear which names are present. Import specific names instead.",
        "warning",
    ),
]

# Directories never searched, and language -> file suffixes.
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox")
LANGUAGE_SUFFIXES = {"python": (".py", ".pyi")}

MATCH_TYPE = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("start_col", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("end_col", T.LongType()),
        T.StructField("metavariables", T.MapType(T.StringType(), T.StringType())),
    ]
)
FINDING_TYPE = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)
REWRITE_TYPE = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("match_count", T.LongType()),
        T.StructField("replacements", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("original", T.StringType()), T.StructField("replacement", T.StringType())]))),
        T.StructField("old_text", T.StringType()),
        T.StructField("new_text", T.StringType()),
    ]
)


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """Rule table; ``rules`` may be a list of tuples/dicts or YAML text
    with a ``rules:`` list. Missing id -> ``unknown``, severity -> ``warning``."""
    rows = _rule_rows(rules)
    return spark.createDataFrame(rows, "id string, pattern string, message string, severity string")


def _rule_rows(rules):
    if rules is None:
        return [tuple(r) for r in DEFAULT_RULES]
    if isinstance(rules, str):
        import yaml

        rules = (yaml.safe_load(rules) or {}).get("rules", [])
    out = []
    for r in rules:
        if isinstance(r, dict):
            out.append((r.get("id", "unknown"), r.get("pattern", "") or "", r.get("message", ""), r.get("severity", "warning")))
        else:
            out.append(tuple(r))
    return out


def python_files(files: DataFrame, language: str = "python") -> DataFrame:
    """A3: language suffixes, skipping vendored/VCS directories anywhere in the
    relative path."""
    suffixes = LANGUAGE_SUFFIXES.get(language, (f".{language}",))
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | F.col("path").endswith(s)
    skip = F.arrays_overlap(F.split(F.col("path"), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))
    return files.where(cond & ~skip)


def literal_tokens(pattern: str) -> list[str]:
    """Identifier-like literals of a pattern that every match must contain."""
    stripped = re.sub(r"\$\$\$[A-Za-z_]\w*|\$[A-Za-z_]\w*", " ", pattern)
    # a string or number can be written in other ways in the text
    stripped = re.sub(r"""(?s)\b[A-Za-z]{0,2}(\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|\b\d[\w.]*""", " ", stripped)
    keywords = {"def", "class", "return", "import", "from", "as", "try", "except", "pass", "if", "else", "for", "in", "while", "with", "lambda", "not", "and", "or", "is", "None", "True", "False", "async", "await", "yield", "raise", "del", "global", "nonlocal", "assert", "finally", "elif", "break", "continue"}
    return [t for t in re.findall(r"[A-Za-z_]\w*", stripped) if t not in keywords]


def _prefilter(files: DataFrame, tokens) -> DataFrame:
    for t in tokens:
        files = files.where(F.col("text").contains(t))
    return files


def search_pattern(files: DataFrame, pattern: str, language: str = "python") -> DataFrame:
    """Every match of ``pattern`` in every file, with metavariables.
    Order with ``orderBy(path, start_line, start_col)`` and cap with
    ``limit`` where a report needs it (``TakeOrderedAndProject``)."""
    compiled = PT.compile_pattern(pattern)
    if compiled is None:
        raise ValueError("empty pattern")
    cand = _prefilter(python_files(files, language), literal_tokens(pattern)).select("project", "path", "text")

    def run(batches):
        import ast

        import pyarrow as pa

        from codestrata.functions import pattern as P

        for b in batches:
            d = b.to_pydict()
            rows = []
            for proj, path, text in zip(d["project"], d["path"], d["text"]):
                try:
                    found = P.find_matches(compiled, ast.parse(text or ""), text or "")
                except (SyntaxError, RecursionError, ValueError, MemoryError):
                    continue
                for m in found:
                    rows.append({"project": proj, "path": path, **{k: m[k] for k in ("text", "kind", "start_line", "start_col", "end_line", "end_col")}, "metavariables": list(m["metavariables"].items())})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(MATCH_TYPE)
    return cand.mapInArrow(run, MATCH_TYPE)


def search_summary(files: DataFrame, matches: DataFrame, max_results: int = 100, language: str = "python") -> DataFrame:
    """E1 counters: files searched, files with matches, total matches and
    ``truncated = total >= max_results`` (true at equality, as reported)."""
    searched = python_files(files, language).agg(F.count("*").cast("long").alias("files_searched"))
    m = matches.agg(F.count("*").cast("long").alias("total_matches"), F.countDistinct(F.struct("project", "path")).cast("long").alias("files_with_matches"))
    return _summary(searched, m, max_results)


def _summary(searched: DataFrame, m: DataFrame, max_results: int) -> DataFrame:
    # both sides are single-row aggregates; the join on a constant key is 1x1
    s = searched.withColumn("_k", F.lit(1))
    t = m.withColumn("_k", F.lit(1))
    return s.join(t, "_k").select(
        "files_searched", "files_with_matches", "total_matches", (F.col("total_matches") >= max_results).alias("truncated")
    )


def check_rules(files: DataFrame, rules=None, language: str = "python") -> DataFrame:
    """Evaluate every rule on every parsed file in one pass; findings
    ``(project, path, rule_id, line, column, end_line, text<=200, message,
    severity)``. Unparseable files yield nothing; empty patterns are skipped."""
    rows = _rule_rows(rules)
    compiled = [(rid, PT.compile_pattern(p), msg, sev) for rid, p, msg, sev in rows if p and p.strip()]
    src = python_files(files, language).select("project", "path", "text")

    def run(batches):
        import ast

        import pyarrow as pa

        from codestrata.functions import pattern as P

        for b in batches:
            d = b.to_pydict()
            out = []
            for proj, path, text in zip(d["project"], d["path"], d["text"]):
                try:
                    tree = ast.parse(text or "")
                    found = [(rule, P.find_matches(rule[1], tree, text or "")) for rule in compiled]
                except (SyntaxError, RecursionError, ValueError, MemoryError):
                    continue
                for (rid, _, msg, sev), matches in found:
                    for m in matches:
                        out.append(
                            {"project": proj, "path": path, "rule_id": rid, "line": m["start_line"], "column": m["start_col"], "end_line": m["end_line"], "text": m["text"], "message": msg, "severity": sev}
                        )
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(FINDING_TYPE)
    return src.mapInArrow(run, FINDING_TYPE)


def severity_counts(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """Counts per severity, zero-filled for error/warning/info."""
    sev = spark.createDataFrame([("error",), ("warning",), ("info",)], "severity string")
    c = findings.groupBy("severity").agg(F.count("*").cast("long").alias("n"))
    return sev.join(c, "severity", "full_outer").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def lint_summary(files: DataFrame, findings: DataFrame, rules=None, language: str = "python") -> DataFrame:
    """E4/E10 counters: files checked (unparseable files included), rules
    applied (empty patterns included) and total findings."""
    n_rules = len(_rule_rows(rules))
    checked = python_files(files, language).agg(F.count("*").cast("long").alias("files_checked"))
    total = findings.agg(F.count("*").cast("long").alias("total_findings"), F.countDistinct(F.struct("project", "path")).cast("long").alias("files_with_findings"))
    return _summary_pair(checked, total).withColumn("rules_applied", F.lit(n_rules).cast("long"))


def _summary_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    # two single-row aggregates side by side (1 x 1 join on a constant key)
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def rule_counts(findings: DataFrame) -> DataFrame:
    """Findings per rule."""
    return findings.groupBy("rule_id").agg(F.count("*").cast("long").alias("n"), F.countDistinct(F.struct("project", "path")).cast("long").alias("files"))


def rewrite(files: DataFrame, pattern: str, replacement: str, language: str = "python") -> DataFrame:
    """Preview of a corpus rewrite: per file with matches the number of
    replacements, the replacement list (source order, texts <=200 chars) and
    the new text. Outermost non-overlapping matches only."""
    compiled = PT.compile_pattern(pattern)
    cand = _prefilter(python_files(files, language), literal_tokens(pattern)).select("project", "path", "text")

    def run(batches):
        import ast

        import pyarrow as pa

        from codestrata.functions import pattern as P

        for b in batches:
            d = b.to_pydict()
            out = []
            for proj, path, text in zip(d["project"], d["path"], d["text"]):
                try:
                    ms = P.find_matches(compiled, ast.parse(text or ""), text or "")
                except (SyntaxError, RecursionError, ValueError, MemoryError):
                    continue
                if not ms:
                    continue
                new, reps = P.rewrite(text, ms, replacement)
                out.append({"project": proj, "path": path, "match_count": len(reps), "replacements": reps, "old_text": text, "new_text": new})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(REWRITE_TYPE)
    return cand.mapInArrow(run, REWRITE_TYPE)


def line_diff(rewrites: DataFrame) -> DataFrame:
    """``(path, line, old, new)`` for every changed line position; the
    longer side's tail is kept (``arrays_zip`` pads with NULL)."""
    z = rewrites.select("project", "path", F.split("old_text", "\n").alias("o"), F.split("new_text", "\n").alias("n"))
    e = z.select("project", "path", F.posexplode(F.arrays_zip("o", "n")).alias("pos", "z"))
    return e.where(~F.col("z.o").eqNullSafe(F.col("z.n"))).select(
        "project", "path", (F.col("pos") + 1).cast("long").alias("line"), F.col("z.o").alias("old"), F.col("z.n").alias("new")
    )


def apply_rewrite(files: DataFrame, rewrites: DataFrame) -> DataFrame:
    """The corpus with rewritten texts, as a new table version (write it
    to a new path; sources are never changed in place)."""
    r = rewrites.select("project", "path", F.col("new_text"))
    return files.join(by_merge(r), ["project", "path"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
