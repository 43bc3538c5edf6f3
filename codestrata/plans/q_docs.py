"""Registered symbol (F) and API-documentation (H) queries over the
generated Python corpus."""

from pyspark.sql import functions as F

from ..operators import docs as H
from ..operators import symbols as S
from ..operators.joins import by_merge
from .corpus_views import code_analysis
from .registry import query
from .sql_common import GEN, with_


@query(
    "symbols",
    with_(GEN)
    + """SELECT path, 'C' || CAST(k AS VARCHAR) AS name, 'class' AS type, module || '.C' || CAST(k AS VARCHAR) AS full_name, CAST(5 + hd AS BIGINT) AS line FROM ok
         UNION ALL SELECT path, 'g', 'function', module || '.C' || CAST(k AS VARCHAR) || '.g', CAST(8 + hd AS BIGINT) FROM ok
         UNION ALL SELECT path, 'f' || CAST(k AS VARCHAR), 'function', module || '.f' || CAST(k AS VARCHAR), CAST(12 + hd AS BIGINT) FROM ok""",
)
def symbols(spark, sf_dir):
    return S.symbols(code_analysis(spark, sf_dir)).select("path", "name", "type", "full_name", "line")


@query(
    "symbol_search",
    with_(GEN) + "SELECT path, module || '.C' || CAST(k AS VARCHAR) || '.g' AS full_name, CAST(8 + hd AS BIGINT) AS line FROM ok",
)
def symbol_search(spark, sf_dir):
    return S.search_symbols(S.symbols(code_analysis(spark, sf_dir)), "g").select("path", "full_name", "line")


@query(
    "symbol_references",
    with_(GEN)
    + """, defs AS (
           SELECT module || '.C' || CAST(k AS VARCHAR) AS full_name, path, CAST(5 + hd AS BIGINT) AS line, 'definition' AS kind FROM ok
           UNION ALL SELECT module || '.C' || CAST(k AS VARCHAR) || '.g', path, CAST(8 + hd AS BIGINT), 'definition' FROM ok
           UNION ALL SELECT module || '.f' || CAST(k AS VARCHAR), path, CAST(12 + hd AS BIGINT), 'definition' FROM ok),
         imps AS (SELECT 'm' || CAST(d AS VARCHAR) || '.f' || CAST(d AS VARCHAR) AS full_name, path, CAST(3 AS BIGINT) AS line, 'import' AS kind FROM ok WHERE d IS NOT NULL)
         SELECT * FROM defs UNION ALL SELECT * FROM imps i WHERE EXISTS (SELECT 1 FROM defs x WHERE x.full_name = i.full_name)""",
)
def symbol_references(spark, sf_dir):
    return S.references(code_analysis(spark, sf_dir)).select("full_name", "path", "line", "kind")


@query(
    "completions",
    with_(GEN)
    + """, req AS (SELECT k AS request_id, project, module FROM ok)
         SELECT r.request_id, o.name, o.type FROM req r JOIN (
           SELECT project, module, 'f' || CAST(k AS VARCHAR) AS name, 'function' AS type FROM ok
           UNION ALL SELECT project, module, 'C' || CAST(k AS VARCHAR), 'class' FROM ok) o
         ON o.project = r.project AND o.module = r.module WHERE starts_with(o.name, 'f')""",
)
def completions(spark, sf_dir):
    a = code_analysis(spark, sf_dir)
    syms = S.symbols(a)
    req = (
        a.where(F.col("error").isNull())
        .select("project", F.regexp_replace("path", r"\.py$", "").alias("module"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("request_id"))
        .withColumn("prefix", F.lit("f"))
    )
    return S.completions(syms, req)


_DOCS_CTE = """
docs AS (
  SELECT module AS name, 'module' AS object_type, CAST(NULL AS VARCHAR) AS signature, CAST(0 AS BIGINT) AS n_params, CAST(0 AS BIGINT) AS n_required,
         'import ' || module AS import_statement, 'Module ' || CAST(k AS VARCHAR) || '.' AS short_description, '' AS params FROM ok
  UNION ALL
  SELECT module || '.C' || CAST(k AS VARCHAR), 'class', 'C' || CAST(k AS VARCHAR) || '()', CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         'from ' || module || ' import C' || CAST(k AS VARCHAR), CAST(NULL AS VARCHAR), '' FROM ok
  UNION ALL
  SELECT module || '.C' || CAST(k AS VARCHAR) || '.g', 'function', 'g(x: int) -> str', CAST(1 AS BIGINT), CAST(1 AS BIGINT),
         'from ' || module || ' import g', CAST(NULL AS VARCHAR), 'x:true' FROM ok
  UNION ALL
  SELECT module || '.f' || CAST(k AS VARCHAR), 'function', 'f' || CAST(k AS VARCHAR) || '(a: int, b) -> int', CAST(2 AS BIGINT), CAST(1 AS BIGINT),
         'from ' || module || ' import f' || CAST(k AS VARCHAR), 'Return a.', 'a:true,b:false' FROM ok)
"""


@query(
    "api_docs",
    with_(GEN, _DOCS_CTE) + "SELECT name, object_type, signature, n_params, n_required, import_statement, short_description FROM docs",
)
def api_docs(spark, sf_dir):
    d = H.api_docs(code_analysis(spark, sf_dir))
    return d.select(
        "name", "object_type", "signature", F.size("parameters").cast("long").alias("n_params"),
        F.size(F.filter("parameters", lambda p: p["required"])).cast("long").alias("n_required"), "import_statement", "short_description",
    )


@query(
    "doc_lookup",
    with_(GEN)
    + """SELECT 'm' || CAST(k AS VARCHAR) || '.C' || CAST(k AS VARCHAR) AS object_name, NOT broken AS found,
              CASE WHEN broken THEN NULL ELSE 'class' END AS object_type,
              CASE WHEN broken THEN NULL ELSE 'g' END AS methods, CASE WHEN broken THEN NULL ELSE 'size' END AS attributes
         FROM gen""",
)
def doc_lookup(spark, sf_dir):
    a = code_analysis(spark, sf_dir)
    docs = H.api_docs(a)
    req = a.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k")).select(
        F.col("k").alias("request_id"), F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".C"), F.col("k").cast("string")).alias("object_name")
    )
    r = H.resolve_names(docs, req)
    return r.select(
        "object_name", "found", F.col("doc.object_type").alias("object_type"),
        F.array_join("doc.methods", ",").alias("methods"), F.array_join("doc.attributes", ",").alias("attributes"),
    )


@query("doc_budget_short", with_(GEN, _DOCS_CTE) + "SELECT name, params AS parameters, import_statement FROM docs")
def doc_budget_short(spark, sf_dir):
    d = H.api_docs(code_analysis(spark, sf_dir)).withColumn("found", F.lit(True))
    s = H.apply_budget(d, "short")
    return s.select("name", F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), F.lower(p["required"].cast("string")))), ",").alias("parameters"), "import_statement")


@query(
    "doc_goal_debugging",
    with_(GEN, _DOCS_CTE) + "SELECT name, signature, short_description, CAST(0 AS BIGINT) AS n_raises, 'debugging' AS task_goal FROM docs",
)
def doc_goal_debugging(spark, sf_dir):
    d = H.with_doc_details(H.api_docs(code_analysis(spark, sf_dir))).withColumn("found", F.lit(True))
    g = H.apply_goal(d.withColumn("related", F.array().cast("array<string>")), "debugging", "short")
    return g.select("name", "signature", "short_description", F.size("raises").cast("long").alias("n_raises"), "task_goal")

def _call_files(spark, sf_dir):
    """The corpus with ``result = f<d>(1, b=2)`` appended to every module of
    key ``k % 7 == 1`` that imports ``f<d>``."""
    from .corpus_views import code_files

    f = code_files(spark, sf_dir).withColumn("_k", F.regexp_extract("path", r"^m(\d+)\.py$", 1).cast("long"))
    hit = F.regexp_extract("text", r"from m(\d+) import", 1)
    text = F.when((F.col("_k") % 7 == 1) & (hit != ""), F.concat("text", F.lit("result = f"), hit, F.lit("(1, b=2)\n"))).otherwise(F.col("text"))
    return f.withColumn("text", text).drop("_k")


_CALLS_CTE = """
calls AS (
  SELECT o.path, CAST(16 + o.hd AS BIGINT) AS line, 'f' || CAST(o.d AS VARCHAR) AS callee, t.path AS def_path,
         CAST(12 + CASE WHEN t.d IS NULL THEN 0 ELSE 1 END AS BIGINT) AS def_line, 'm' || CAST(o.d AS VARCHAR) || '.f' || CAST(o.d AS VARCHAR) AS target_name
  FROM ok o JOIN gen t ON t.k = o.d AND NOT t.broken
  WHERE o.k % 7 = 1 AND o.d IS NOT NULL)
"""


@query(
    "signature_help",
    with_(GEN, _CALLS_CTE)
    + "SELECT path, line, callee, def_path, CAST(1 AS BIGINT) AS n_args, 'b' AS keywords, CAST(0 AS BIGINT) AS active_parameter, 'a,b' AS params FROM calls",
)
def signature_help(spark, sf_dir):
    from ..operators import extract as X

    a = X.analyze_files(_call_files(spark, sf_dir)).persist()
    s = S.signature_help(a)
    return s.select(
        "path", "line", "callee", "def_path", F.col("n_args").cast("long").alias("n_args"), F.array_join("keywords", ",").alias("keywords"),
        "active_parameter", F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"),
    )


@query(
    "definitions_follow_imports",
    with_(GEN, _CALLS_CTE)
    + """SELECT path, line, callee AS name, def_path, def_line FROM calls
         UNION ALL SELECT path, CAST(9 + hd AS BIGINT), 'x', path, CAST(8 + hd AS BIGINT) FROM ok
         UNION ALL SELECT path, CAST(14 + hd AS BIGINT), 'a', path, CAST(12 + hd AS BIGINT) FROM ok
         UNION ALL SELECT path, CAST(15 + hd AS BIGINT), 'a', path, CAST(12 + hd AS BIGINT) FROM ok""",
)
def definitions_follow_imports(spark, sf_dir):
    from ..operators import extract as X

    a = X.analyze_files(_call_files(spark, sf_dir)).persist()
    d = S.definitions(a)
    return d.select("path", "line", "name", "def_path", F.col("def_line").cast("long").alias("def_line"))


@query(
    "hover",
    with_(GEN, _CALLS_CTE)
    + """SELECT path, line, target_name, 'Return a.' AS docstring FROM calls
         UNION ALL SELECT path, CAST(9 + hd AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ok
         UNION ALL SELECT path, CAST(14 + hd AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ok
         UNION ALL SELECT path, CAST(15 + hd AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ok""",
)
def hover(spark, sf_dir):
    from ..operators import extract as X

    a = X.analyze_files(_call_files(spark, sf_dir)).persist()
    h = S.hover(a, H.api_docs(a))
    return h.select("path", "line", "target_name", "docstring")


@query(
    "goto_definitions",
    with_(GEN)
    + """SELECT path, 'x' AS name, CAST(9 + hd AS BIGINT) AS line, CAST(8 + hd AS BIGINT) AS def_line, 'param' AS def_kind FROM ok
         UNION ALL SELECT path, 'a', CAST(14 + hd AS BIGINT), CAST(12 + hd AS BIGINT), 'param' FROM ok
         UNION ALL SELECT path, 'a', CAST(15 + hd AS BIGINT), CAST(12 + hd AS BIGINT), 'param' FROM ok""",
)
def goto_definitions(spark, sf_dir):
    return S.goto(code_analysis(spark, sf_dir)).select("path", "name", "line", F.col("def_line").cast("long").alias("def_line"), "def_kind")


@query(
    "codegen_context",
    with_(GEN)
    + """SELECT k AS request_id, 'm' || CAST(k AS VARCHAR) || '.f' || CAST(k AS VARCHAR) AS object_name, NOT broken AS found,
              CAST(CASE WHEN broken THEN 2 ELSE 1 END AS BIGINT) AS n_warnings, false AS is_compatible,
              CASE WHEN broken THEN NULL ELSE 'from m' || CAST(k AS VARCHAR) || ' import f' || CAST(k AS VARCHAR) END AS import_statement
         FROM gen""",
)
def codegen_context(spark, sf_dir):
    from ..plans.project import codegen_context as ctx
    from .q_packages import packages_view

    a = code_analysis(spark, sf_dir)
    docs = H.api_docs(a)
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    req = a.select(
        k.alias("request_id"), F.lit("env0").alias("env"), F.concat(F.lit("m"), k.cast("string"), F.lit(".f"), k.cast("string")).alias("object_name"),
        F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("import_name"), F.lit("3.8").alias("min_python"),
        F.lit(None).cast("string").alias("package_version_spec"), F.lit("short").alias("budget"),
    )
    c = ctx(req, docs, packages_view(spark, sf_dir).drop("k"))
    return c.select("request_id", "object_name", "found", F.size("warnings").cast("long").alias("n_warnings"), "is_compatible", "import_statement")


def _helper_files(spark, sf_dir):
    """The corpus with a documented, decorated helper appended to every
    module: a doctest example, a ``Raises`` section, and a name containing
    the module's function name."""
    from .corpus_views import code_files

    f = code_files(spark, sf_dir)
    k = F.regexp_extract("path", r"^m(\d+)\.py$", 1)
    helper = F.concat(
        F.lit("\n\n@functools.lru_cache(maxsize=None)\ndef f"), k, F.lit("_helper(v):\n"),
        F.lit('    """Help f'), k, F.lit(".\n\n    >>> f"), k, F.lit("_helper(2)\n    2\n\n"),
        F.lit("    Raises:\n        ValueError: If v is bad.\n    \"\"\"\n    return v\n"),
    )
    return f.withColumn("text", F.concat("text", helper))


def _helper_docs(spark, sf_dir):
    from ..operators import extract as X

    a = X.analyze_files(_helper_files(spark, sf_dir)).persist()
    return a, H.api_docs(a)


@query(
    "related_names",
    with_(GEN)
    + """SELECT module || '.f' || CAST(k AS VARCHAR) AS name, module || '.f' || CAST(k AS VARCHAR) || '_helper' AS related FROM ok
         UNION ALL SELECT module || '.f' || CAST(k AS VARCHAR) || '_helper', module || '.f' || CAST(k AS VARCHAR) FROM ok""",
)
def related_names(spark, sf_dir):
    from ..operators import extract as X

    docs = H.api_docs(X.analyze_files(_helper_files(spark, sf_dir)))  # read once, but for modules, which are not related
    return H.related(docs).select("name", F.explode("related").alias("related"))


@query(
    "module_exports",
    with_(GEN)
    + """SELECT module, 'C' || CAST(k AS VARCHAR) AS export FROM ok
         UNION ALL SELECT module, 'f' || CAST(k AS VARCHAR) FROM ok
         UNION ALL SELECT module, 'f' || CAST(k AS VARCHAR) || '_helper' FROM ok""",
)
def module_exports(spark, sf_dir):
    from ..operators import extract as X

    a = X.analyze_files(_helper_files(spark, sf_dir))  # read once
    return H.module_exports(a.where(F.col("error").isNull())).select("module", F.explode("exports").alias("export"))


@query(
    "doc_examples",
    with_(GEN)
    + """SELECT module || '.f' || CAST(k AS VARCHAR) || '_helper' AS name, 'f' || CAST(k AS VARCHAR) || '_helper(2)' AS code, '2' AS expected FROM ok""",
)
def doc_examples(spark, sf_dir):
    _, docs = _helper_docs(spark, sf_dir)
    d = H.with_doc_details(docs)
    return d.select("name", F.explode("examples").alias("e")).select("name", "e.code", "e.expected")


@query(
    "doc_raises",
    with_(GEN) + "SELECT module || '.f' || CAST(k AS VARCHAR) || '_helper' AS name, 'ValueError' AS exception, 'If v is bad.' AS description FROM ok",
)
def doc_raises(spark, sf_dir):
    _, docs = _helper_docs(spark, sf_dir)
    d = H.with_doc_details(docs)
    return d.select("name", F.explode("raises").alias("r")).select("name", "r.exception", "r.description")


@query(
    "rename_symbols",
    with_(GEN)
    + """SELECT o.path, CAST(1 + CASE WHEN o.d IS NOT NULL AND t.k IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_changes
         FROM ok o LEFT JOIN ok t ON t.k = o.d""",
)
def rename_symbols(spark, sf_dir):
    """F9 over the corpus: every module's ``f<k>`` becomes ``run<k>``, at its
    definition and at every import of it."""
    from .corpus_views import code_files

    a = code_analysis(spark, sf_dir)
    syms = S.symbols(a)
    renames = syms.where((F.col("type") == "function") & (F.col("scope") == "<module>")).select(
        "full_name", F.regexp_replace("name", "^f", "run").alias("new_name")
    )
    r = S.rename_batch(code_files(spark, sf_dir), S.references(a, syms), renames)
    return r.select("path", F.col("n_changes").cast("long").alias("n_changes"))


@query(
    "decorators",
    with_(GEN)
    + """SELECT path, 'f' || CAST(k AS VARCHAR) || '_helper' AS function, 'functools.lru_cache' AS decorator, 'functools.lru_cache' AS decorators_used FROM ok""",
)
def decorators(spark, sf_dir):
    """Decorator names per function, and the file's first-seen list."""
    from ..operators import extract as X

    a, _ = _helper_docs(spark, sf_dir)
    fn = X.functions(a).select("project", "path", F.col("name").alias("function"), F.explode("decorators").alias("decorator"))
    used = a.select("project", "path", F.array_join("decorators_used", ",").alias("decorators_used"))
    return fn.join(by_merge(used), ["project", "path"]).select("path", "function", "decorator", "decorators_used")


@query(
    "doc_text_tokens",
    with_(GEN, _DOCS_CTE)
    + """SELECT name AS scenario, CAST(length(coalesce(signature, '') || chr(10) || coalesce(short_description, '')) AS BIGINT) AS text_length,
              CAST(greatest(1, length(coalesce(signature, '') || chr(10) || coalesce(short_description, '')) // 4) AS BIGINT) AS tokens FROM docs""",
)
def doc_text_tokens(spark, sf_dir):
    """K8 ``without`` side: signature and full docstring per documented name
    (the corpus docstrings are one line each)."""
    from ..operators import accounting as A

    docs = H.api_docs(code_analysis(spark, sf_dir))
    est = A.doc_representations(docs, H.apply_budget(docs.withColumn("found", F.lit(True)), "short"))
    return est.where(F.col("side") == "without").select("scenario", "text_length", "tokens")


@query(
    "main_exports",
    with_(GEN)
    + """SELECT 'pkg-' || module AS name, 'C' || CAST(k AS VARCHAR) AS export FROM ok
         UNION ALL SELECT 'pkg-' || module, 'f' || CAST(k AS VARCHAR) FROM ok
         UNION ALL SELECT 'pkg-' || module, 'f' || CAST(k AS VARCHAR) || '_helper' FROM ok""",
)
def main_exports(spark, sf_dir):
    """I8: main exports of a package = the static exports of its import
    names (one package per module of the helper corpus)."""
    from ..operators import packages as P

    a, _ = _helper_docs(spark, sf_dir)
    ok = a.where(F.col("error").isNull())
    exports = H.module_exports(ok).select("module", "exports")
    pk = ok.select(
        F.lit("env0").alias("env"), F.concat(F.lit("pkg-"), F.regexp_replace("path", r"\.py$", "")).alias("name"),
        F.array(F.regexp_replace("path", r"\.py$", "")).alias("import_names"),
    )
    return P.main_exports(exports, pk).select("name", F.explode("main_exports").alias("export"))
