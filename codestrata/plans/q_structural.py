"""Registered structural-search, lint, rewrite and diagnostics queries (E, G)."""

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import extract as X
from ..operators import structural as E
from ..sources.tables import table
from .corpus_views import code_analysis, code_files
from .registry import query
from .sql_common import GEN, with_

FUNC_PATTERN = "def $FUNC($$$PARAMS):\n    $$$BODY"


@query(
    "pattern_search",
    with_(GEN)
    + """SELECT path, 'f' || CAST(k AS VARCHAR) AS func, CAST(12 + hd AS BIGINT) AS start_line, CAST(15 + hd AS BIGINT) AS end_line, CAST(0 AS BIGINT) AS start_col FROM ok
         UNION ALL SELECT path, 'g', CAST(8 + hd AS BIGINT), CAST(9 + hd AS BIGINT), CAST(4 AS BIGINT) FROM ok""",
)
def pattern_search(spark, sf_dir):
    m = E.search_pattern(code_files(spark, sf_dir), FUNC_PATTERN)
    return m.select("path", F.col("metavariables")["$FUNC"].alias("func"), "start_line", "end_line", "start_col")


@query(
    "pattern_first_results",
    with_(GEN)
    + """SELECT path, start_line FROM (
           SELECT path, CAST(12 + hd AS BIGINT) AS start_line, CAST(0 AS BIGINT) AS c FROM ok
           UNION ALL SELECT path, CAST(8 + hd AS BIGINT), CAST(4 AS BIGINT) FROM ok) ORDER BY path, start_line, c LIMIT 100""",
)
def pattern_first_results(spark, sf_dir):
    m = E.search_pattern(code_files(spark, sf_dir), FUNC_PATTERN)
    return m.orderBy("path", "start_line", "start_col").limit(100).select("path", "start_line")


@query(
    "pattern_summary",
    with_(GEN)
    + """SELECT CAST(count(*) AS BIGINT) AS files_searched, CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS files_with_matches,
              CAST(2 * count(*) FILTER (WHERE NOT broken) AS BIGINT) AS total_matches, 2 * count(*) FILTER (WHERE NOT broken) >= 100 AS truncated
         FROM gen""",
)
def pattern_summary(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return E.search_summary(files, E.search_pattern(files, FUNC_PATTERN), 100)


_FINDINGS = """
findings AS (
  SELECT path, CASE WHEN k % 3 = 0 THEN 'print-statement' ELSE 'assert-without-message' END AS rule_id,
         CAST(14 + hd AS BIGINT) AS line, CAST(4 AS BIGINT) AS "column",
         CASE WHEN k % 3 = 0 THEN 'print(a)' ELSE 'assert a' END AS text, 'info' AS severity FROM ok)
"""


@query("lint_findings", with_(GEN, _FINDINGS) + 'SELECT path, rule_id, line, "column", text, severity FROM findings')
def lint_findings(spark, sf_dir):
    return E.check_rules(code_files(spark, sf_dir)).select("path", "rule_id", "line", "column", "text", "severity")


@query(
    "lint_severity",
    with_(GEN, _FINDINGS)
    + """SELECT s.severity, CAST(count(f.severity) AS BIGINT) AS n
         FROM (VALUES ('error'), ('warning'), ('info')) s(severity) LEFT JOIN findings f ON f.severity = s.severity GROUP BY s.severity""",
)
def lint_severity(spark, sf_dir):
    return E.severity_counts(spark, E.check_rules(code_files(spark, sf_dir)))


@query(
    "lint_rule_counts",
    with_(GEN, _FINDINGS) + "SELECT rule_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT path) AS BIGINT) AS files FROM findings GROUP BY rule_id",
)
def lint_rule_counts(spark, sf_dir):
    return E.rule_counts(E.check_rules(code_files(spark, sf_dir)))


@query(
    "transform_preview",
    with_(GEN) + "SELECT path, CAST(1 AS BIGINT) AS match_count, CAST(14 + hd AS BIGINT) AS first_line FROM ok WHERE k % 3 = 0",
)
def transform_preview(spark, sf_dir):
    r = E.rewrite(code_files(spark, sf_dir), "print($$$ARGS)", "logging.info($$$ARGS)")
    return r.select("path", "match_count", F.col("replacements")[0]["line"].alias("first_line"))


@query(
    "transform_diff",
    with_(GEN) + "SELECT path, CAST(14 + hd AS BIGINT) AS line, '    print(a)' AS old, '    logging.info(a)' AS new FROM ok WHERE k % 3 = 0",
)
def transform_diff(spark, sf_dir):
    r = E.rewrite(code_files(spark, sf_dir), "print($$$ARGS)", "logging.info($$$ARGS)")
    return E.line_diff(r).select("path", "line", "old", "new")


@query(
    "unused_imports",
    with_(GEN)
    + """SELECT path, CAST(2 AS BIGINT) AS line, imp AS name, '''' || imp || ''' imported but unused' AS message FROM ok
         UNION ALL SELECT path, CAST(3 AS BIGINT), 'f' || CAST(d AS VARCHAR), '''m' || CAST(d AS VARCHAR) || '.f' || CAST(d AS VARCHAR) || ''' imported but unused'
         FROM ok WHERE d IS NOT NULL""",
)
def unused_imports(spark, sf_dir):
    return D.unused_imports(code_analysis(spark, sf_dir)).select("path", "line", "name", "message")


def _seeded_files(spark, sf_dir):
    """The corpus with ``value = missing_<k % 5>`` appended to every 7th module."""
    f = code_files(spark, sf_dir).withColumn("_k", F.regexp_extract("path", r"^m(\d+)\.py$", 1).cast("long"))
    text = F.when(F.col("_k") % 7 == 0, F.concat("text", F.lit("value = missing_"), (F.col("_k") % 5).cast("string"), F.lit("\n"))).otherwise(F.col("text"))
    return f.withColumn("text", text).drop("_k")


@query(
    "undefined_names",
    with_(GEN) + "SELECT path, CAST(16 + hd AS BIGINT) AS line, 'missing_' || CAST(k % 5 AS VARCHAR) AS name FROM ok WHERE k % 7 = 0",
)
def undefined_names(spark, sf_dir):
    a = X.analyze_files(_seeded_files(spark, sf_dir))
    return D.undefined_names(a).select("path", "line", "name")


@query(
    "diag_project",
    with_(GEN)
    + """SELECT project, CAST(count(*) AS BIGINT) AS files_checked, CAST(count(*) AS BIGINT) AS files_with_issues,
              CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS errors,
              CAST(sum(CASE WHEN broken THEN 0 WHEN d IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS info
         FROM gen GROUP BY project""",
)
def diag_project(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return D.project_diagnostics(files, D.run_diagnostics(code_analysis(spark, sf_dir)))


@query(
    "diag_file_summary",
    with_(GEN)
    + """SELECT path, CAST(CASE WHEN broken THEN 1 ELSE 1 + hd END AS BIGINT) AS total,
              CAST(CASE WHEN broken THEN 1 ELSE 0 END AS BIGINT) AS errors,
              CAST(CASE WHEN broken THEN 0 ELSE 1 + hd END AS BIGINT) AS warnings,
              CASE WHEN broken THEN 'syntax' ELSE 'pyflakes' END AS sources_used
         FROM (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS hd FROM gen)""",
)
def diag_file_summary(spark, sf_dir):
    s = D.file_summary(D.run_diagnostics(code_analysis(spark, sf_dir)))
    return s.select("path", "total", "errors", "warnings", F.array_join("sources_used", ",").alias("sources_used"))


def _tool_lines(spark, sf_dir):
    """Checker output lines built from ``events``."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    loc = F.concat(
        F.lit("src/f"), (F.col("user_id") % 50).cast("string"), F.lit(".py:"), (eid % 300 + 1).cast("string"),
        F.when(eid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(":"), (eid % 80 + 1).cast("string"))),
    )
    msg = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("undefined name 'x"), (eid % 9).cast("string"), F.lit("'")))
        .when(F.col("event_type") == "view", F.lit("syntax error: invalid syntax"))
        .otherwise(F.concat(F.lit("'mod"), (eid % 4).cast("string"), F.lit("' imported but unused")))
    )
    return e.select(F.when(eid % 17 == 0, F.lit("garbage line")).otherwise(F.concat(loc, F.lit(": "), msg)).alias("value"))


_TOOL_LINES = """
tl AS (
  SELECT CASE WHEN event_id % 17 = 0 THEN 'garbage line' ELSE
           'src/f' || CAST(user_id % 50 AS VARCHAR) || '.py:' || CAST(event_id % 300 + 1 AS VARCHAR)
           || CASE WHEN event_id % 3 = 0 THEN '' ELSE ':' || CAST(event_id % 80 + 1 AS VARCHAR) END || ': '
           || CASE event_type WHEN 'error' THEN 'undefined name ''x' || CAST(event_id % 9 AS VARCHAR) || ''''
                              WHEN 'view' THEN 'syntax error: invalid syntax'
                              ELSE '''mod' || CAST(event_id % 4 AS VARCHAR) || ''' imported but unused' END END AS value,
         event_id % 3 = 0 AS nocol, event_id, user_id, event_type
  FROM events),
parsed AS (
  SELECT split_part(value, ':', 1) AS path, CAST(split_part(value, ':', 2) AS BIGINT) AS line,
         CASE WHEN nocol THEN 0 ELSE CAST(split_part(value, ':', 3) AS BIGINT) END AS "column",
         CASE WHEN event_type IN ('error', 'view') THEN 'error' ELSE 'warning' END AS severity,
         CASE WHEN nocol AND event_type = 'view' THEN 'syntax error: invalid syntax'
              WHEN nocol THEN trim(split_part(value, ':', 3))
              WHEN event_type = 'view' THEN 'syntax error: invalid syntax'
              ELSE trim(split_part(value, ':', 4)) END AS message
  FROM tl WHERE event_id % 17 <> 0)
"""


@query("diag_ingest", with_(_TOOL_LINES) + 'SELECT path, line, "column", severity, message FROM parsed')
def diag_ingest(spark, sf_dir):
    return D.parse_pyflakes(_tool_lines(spark, sf_dir)).select("path", "line", "column", "severity", "message")


@query(
    "diag_summary",
    with_(_TOOL_LINES)
    + """SELECT path, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS errors,
              CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warnings FROM parsed GROUP BY path""",
)
def diag_summary(spark, sf_dir):
    d = D.parse_pyflakes(_tool_lines(spark, sf_dir)).withColumn("project", F.lit("logs"))
    return D.file_summary(d).select("path", "total", "errors", "warnings")


@query(
    "apply_rewrite",
    with_(GEN) + "SELECT path, CAST(CASE WHEN NOT broken AND k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM gen",
)
def apply_rewrite(spark, sf_dir):
    """The rewritten corpus as a new table version; one row per file
    with its number of ``logging.info`` calls."""
    files = code_files(spark, sf_dir)
    new = E.apply_rewrite(files, E.rewrite(files, "print($$$ARGS)", "logging.info($$$ARGS)"))
    return new.select("path", F.regexp_count("text", F.lit(r"logging\.info\(")).cast("long").alias("n"))


@query(
    "variables",
    with_(GEN) + "SELECT path, 'value' AS name, CAST(16 + hd AS BIGINT) AS line, 'missing_' || CAST(k % 5 AS VARCHAR) AS value FROM ok WHERE k % 7 = 0",
)
def variables(spark, sf_dir):
    a = X.analyze_files(_seeded_files(spark, sf_dir))
    return X.variables(a, first=10, width=50).select("path", "name", "line", "value")


@query(
    "lint_summary",
    with_(GEN)
    + """SELECT CAST(count(*) AS BIGINT) AS files_checked, CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS total_findings,
              CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS files_with_findings, CAST(5 AS BIGINT) AS rules_applied FROM gen""",
)
def lint_summary(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return E.lint_summary(files, E.check_rules(files))


def _mypy_lines(spark, sf_dir):
    """A mypy-style line for every event."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    loc = F.concat(
        F.lit("src/f"), (F.col("user_id") % 50).cast("string"), F.lit(".py:"), (eid % 300 + 1).cast("string"),
        F.when(eid % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(":"), (eid % 80 + 1).cast("string"))),
    )
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "note").otherwise("warning")
    return e.select(F.concat(loc, F.lit(": "), sev, F.lit(": value "), F.col("value").cast("string")).alias("value"))


_MYPY = """
mp AS (
  SELECT 'src/f' || CAST(user_id % 50 AS VARCHAR) || '.py' AS path, CAST(event_id % 300 + 1 AS BIGINT) AS line,
         CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 80 + 1 END AS BIGINT) AS "column",
         CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'warning' END AS severity,
         'value ' || CAST(value AS VARCHAR) AS message, 'mypy' AS source
  FROM events)
"""


@query("mypy_ingest", with_(_MYPY) + 'SELECT path, line, "column", severity, message FROM mp')
def mypy_ingest(spark, sf_dir):
    return D.parse_mypy(_mypy_lines(spark, sf_dir)).select("path", "line", "column", "severity", "message")


def _pyright_docs(spark, sf_dir):
    """A pyright JSON report for every event; a sixth of its paths have no mypy line."""
    e = table(spark, sf_dir, "events")
    diag = F.struct(
        F.concat(F.lit("src/f"), (F.col("user_id") % 60).cast("string"), F.lit(".py")).alias("file"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("warning")).alias("severity"),
        F.concat(F.lit("code "), F.col("event_id").cast("string")).alias("message"),
        F.lit("reportGeneralTypeIssues").alias("rule"),
        F.struct(F.struct((F.col("event_id") % 300).cast("int").alias("line"), (F.col("event_id") % 60).cast("int").alias("character")).alias("start")).alias("range"),
    )
    return e.select(F.to_json(F.struct(F.array(diag).alias("generalDiagnostics"))).alias("value"))


_PYRIGHT = """
pr AS (
  SELECT 'src/f' || CAST(user_id % 60 AS VARCHAR) || '.py' AS path, CAST(event_id % 300 + 1 AS BIGINT) AS line,
         CAST(event_id % 60 AS BIGINT) AS "column", CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'warning' END AS severity,
         'code ' || CAST(event_id AS VARCHAR) AS message, 'pyright' AS source
  FROM events)
"""


@query("pyright_ingest", with_(_PYRIGHT) + 'SELECT path, line, "column", severity, message FROM pr')
def pyright_ingest(spark, sf_dir):
    return D.parse_pyright(_pyright_docs(spark, sf_dir)).select("path", "line", "column", "severity", "message")


@query(
    "type_check_fallback",
    with_(_MYPY, _PYRIGHT)
    + """SELECT path, source, CAST(count(*) AS BIGINT) AS n FROM (
           SELECT path, source FROM mp
           UNION ALL SELECT path, source FROM pr WHERE path NOT IN (SELECT path FROM mp)) GROUP BY path, source""",
)
def type_check_fallback(spark, sf_dir):
    cols = ["project", "path", "line", "column", "severity", "source", "message"]
    mp = D.parse_mypy(_mypy_lines(spark, sf_dir)).withColumn("project", F.lit("logs")).select(*cols)
    pr = D.parse_pyright(_pyright_docs(spark, sf_dir)).withColumn("project", F.lit("logs")).select(*cols)
    return D.type_checker_fallback(mp, pr).groupBy("path", "source").agg(F.count("*").cast("long").alias("n"))


@query("lint_same_pass", with_(GEN, _FINDINGS) + 'SELECT path, rule_id, line, "column", text, severity FROM findings')
def lint_same_pass(spark, sf_dir):
    """E4 evaluated inside the extraction pass (one parse for analysis and
    lint)."""
    a = X.analyze_files(code_files(spark, sf_dir), rules="default")
    return X.findings(a).select("path", "rule_id", "line", "column", "text", "severity")
