"""Registered entity-extraction and import-graph queries (B, C) over the
Python corpus generated from ``part``."""

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from .corpus_views import code_analysis, code_files, parsed_once
from .registry import query
from .sql_common import GEN, with_


@query(
    "functions",
    with_(GEN)
    + """SELECT project, path, 'f' || CAST(k AS VARCHAR) AS name, CAST(12 + hd AS BIGINT) AS line,
              'f' || CAST(k AS VARCHAR) || '(a: int, b) -> int' AS signature, CAST(2 AS BIGINT) AS n_params,
              'int' AS returns, 'Return a.' AS description FROM ok""",
)
def functions(spark, sf_dir):
    return X.functions(code_analysis(spark, sf_dir)).select("project", "path", "name", "line", "signature", "n_params", "returns", "description")


@query(
    "params",
    with_(GEN)
    + """SELECT path, 'f' || CAST(k AS VARCHAR) AS function, CAST(0 AS BIGINT) AS position, 'a' AS name, 'int' AS type,
              CAST(NULL AS VARCHAR) AS "default", true AS required FROM ok
         UNION ALL
         SELECT path, 'f' || CAST(k AS VARCHAR), CAST(1 AS BIGINT), 'b', CAST(NULL AS VARCHAR), '1', false FROM ok""",
)
def params(spark, sf_dir):
    return X.params(code_analysis(spark, sf_dir)).select("path", "function", "position", "name", "type", "default", "required")


@query(
    "classes",
    with_(GEN)
    + """SELECT project, path, 'C' || CAST(k AS VARCHAR) AS name, CAST(5 + hd AS BIGINT) AS line,
              CAST(1 AS BIGINT) AS n_methods, CAST(1 AS BIGINT) AS n_attributes FROM ok""",
)
def classes(spark, sf_dir):
    return X.classes(code_analysis(spark, sf_dir)).select("project", "path", "name", "line", "n_methods", "n_attributes")


@query(
    "methods",
    with_(GEN)
    + """SELECT path, 'C' || CAST(k AS VARCHAR) AS class_name, 'g' AS name, CAST(8 + hd AS BIGINT) AS line,
              'g(x: int) -> str' AS signature, false AS is_async FROM ok""",
)
def methods(spark, sf_dir):
    return X.methods(code_analysis(spark, sf_dir)).select("path", "class_name", "name", "line", "signature", "is_async")


@query(
    "attributes",
    with_(GEN)
    + """SELECT path, 'C' || CAST(k AS VARCHAR) AS class_name, 'size' AS name, 'int' AS type,
              CAST(k % 7 AS VARCHAR) AS "default", CAST(6 + hd AS BIGINT) AS line FROM ok""",
)
def attributes(spark, sf_dir):
    return X.attributes(code_analysis(spark, sf_dir)).select("path", "class_name", "name", "type", "default", "line")


@query(
    "imports",
    with_(GEN)
    + """SELECT path, imp AS module, CAST(NULL AS VARCHAR) AS alias, CAST(2 AS BIGINT) AS line FROM ok""",
)
def imports(spark, sf_dir):
    return X.imports(code_analysis(spark, sf_dir)).select("path", "module", "alias", F.col("line").cast("long").alias("line"))


@query(
    "from_imports",
    with_(GEN)
    + """SELECT path, 'm' || CAST(d AS VARCHAR) AS module, CAST(0 AS BIGINT) AS level, 'f' || CAST(d AS VARCHAR) AS name,
              CAST(3 AS BIGINT) AS line FROM ok WHERE d IS NOT NULL""",
)
def from_imports(spark, sf_dir):
    return X.from_imports(code_analysis(spark, sf_dir)).select(
        "path", "module", F.col("level").cast("long").alias("level"), "name", F.col("line").cast("long").alias("line")
    )


@query(
    "file_summary",
    with_(GEN)
    + """SELECT project, path, path AS file_name, CAST(1 AS BIGINT) AS n_functions, CAST(1 AS BIGINT) AS n_classes,
              CAST(1 + hd AS BIGINT) AS n_imports, 'Module ' || CAST(k AS VARCHAR) || '.' AS description,
              array_to_string(list_sort(list_filter(['pandas', 'numpy', CASE WHEN d IS NOT NULL THEN 'm' || CAST(d AS VARCHAR) END],
                                                    lambda x: x IS NOT NULL AND (x = imp OR x LIKE 'm%'))), ',') AS third_party,
              false AS has_error
         FROM ok
         UNION ALL
         SELECT project, path, path, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), '', true FROM gen WHERE broken""",
)
def file_summary(spark, sf_dir):
    s = X.file_summary(code_analysis(spark, sf_dir))
    return s.select(
        "project", "path", "file_name", "n_functions", "n_classes", "n_imports", "description",
        F.array_join("third_party", ",").alias("third_party"), F.col("error").isNotNull().alias("has_error"),
    )


@query(
    "parse_errors",
    with_(GEN) + "SELECT project, path, CAST(16 + CASE WHEN d IS NULL THEN 0 ELSE 1 END AS BIGINT) AS line FROM gen WHERE broken",
)
def parse_errors(spark, sf_dir):
    return X.syntax_errors(parsed_once(spark, sf_dir)).select("project", "path", "line")


@query(
    "import_edges",
    with_(GEN)
    + "SELECT project, module AS src, 'm' || CAST(d AS VARCHAR) AS dst FROM ok WHERE d IS NOT NULL",
)
def import_edges(spark, sf_dir):
    return G.import_edges(code_analysis(spark, sf_dir))


@query(
    "import_adjacency",
    with_(GEN)
    + """SELECT project, module, CAST(CASE WHEN d IS NULL OR broken THEN 0 ELSE 1 END AS BIGINT) AS n_deps,
              CASE WHEN d IS NULL OR broken THEN '' ELSE 'm' || CAST(d AS VARCHAR) END AS deps FROM gen""",
)
def import_adjacency(spark, sf_dir):
    adj = G.import_adjacency(code_analysis(spark, sf_dir))
    return adj.select("project", "module", F.size("deps").cast("long").alias("n_deps"), F.array_join("deps", ",").alias("deps"))


@query(
    "cycles",
    with_(GEN)
    + """SELECT project, string_agg(module, ',' ORDER BY k) || ',m' || CAST(b * 5 AS VARCHAR) AS cycle, CAST(5 AS BIGINT) AS length
         FROM gen WHERE b % 2 = 0 GROUP BY project, b HAVING count(*) = 5""",
)
def cycles(spark, sf_dir):
    c = G.circular_dependencies(G.import_edges(code_analysis(spark, sf_dir)))
    return c.select("project", F.array_join("cycle", ",").alias("cycle"), "length")


@query(
    "dep_classes",
    with_(GEN)
    + """, tops AS (SELECT project, imp AS name FROM ok UNION SELECT project, 'm' || CAST(d AS VARCHAR) FROM ok WHERE d IS NOT NULL)
         SELECT project, CASE WHEN name IN ('os', 'json') THEN 'stdlib' ELSE 'third_party' END AS class, name FROM tops""",
)
def dep_classes(spark, sf_dir):
    return G.dependency_rows(code_analysis(spark, sf_dir))


@query(
    "project_rollup",
    with_(GEN)
    + """, tops AS (SELECT project, imp AS name FROM ok UNION SELECT project, 'm' || CAST(d AS VARCHAR) FROM ok WHERE d IS NOT NULL)
         SELECT g.project, CAST(count(*) AS BIGINT) AS total_files,
                CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS parsed_files,
                CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS error_files,
                CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS total_functions,
                CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS total_classes,
                CAST(sum(CASE WHEN broken THEN 0 WHEN d IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS total_imports,
                CAST(sum(16 + CASE WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS total_lines,
                CAST((SELECT count(*) FROM tops t WHERE t.project = g.project AND t.name IN ('os', 'json')) AS BIGINT) AS stdlib_deps,
                CAST((SELECT count(*) FROM tops t WHERE t.project = g.project AND t.name NOT IN ('os', 'json')) AS BIGINT) AS third_party_deps
         FROM gen g GROUP BY g.project""",
)
def project_rollup(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return G.project_rollup(files, code_analysis(spark, sf_dir))


@query(
    "cross_refs",
    with_(GEN)
    + """, defs AS (SELECT project, 'f' || CAST(k AS VARCHAR) AS name, module, CAST(12 + hd AS BIGINT) AS line, 'function' AS type FROM ok
                   UNION ALL SELECT project, 'C' || CAST(k AS VARCHAR), module, CAST(5 + hd AS BIGINT), 'class' FROM ok),
           imps AS (SELECT project, 'f' || CAST(d AS VARCHAR) AS name, module, CAST(3 AS BIGINT) AS line, 'import' AS type FROM ok WHERE d IS NOT NULL),
           hits AS (SELECT * FROM defs UNION ALL SELECT * FROM imps)
         SELECT project, name, module, line, type FROM hits h
         WHERE EXISTS (SELECT 1 FROM defs x WHERE x.project = h.project AND x.name = h.name)""",
)
def cross_refs(spark, sf_dir):
    return G.cross_references(code_analysis(spark, sf_dir)).select("project", "name", "module", "line", "type")


@query(
    "dep_classes_local",
    with_(GEN)
    + """, tops AS (SELECT project, imp AS name FROM ok UNION SELECT project, 'm' || CAST(d AS VARCHAR) FROM ok WHERE d IS NOT NULL)
         SELECT project, CASE WHEN name IN ('os', 'json') THEN 'stdlib' WHEN name LIKE 'm%' THEN 'local' ELSE 'third_party' END AS class, name FROM tops""",
)
def dep_classes_local(spark, sf_dir):
    return G.dependency_rows(code_analysis(spark, sf_dir), with_local=True)


@query(
    "cycles_distributed",
    with_(GEN)
    + """SELECT project, string_agg(module, ',' ORDER BY k) || ',m' || CAST(b * 5 AS VARCHAR) AS cycle, CAST(5 AS BIGINT) AS length
         FROM gen WHERE b % 2 = 0 GROUP BY project, b HAVING count(*) = 5""",
)
def cycles_distributed(spark, sf_dir):
    """C7 with every project cut into its weakly connected components."""
    c = G.circular_dependencies(G.import_edges(code_analysis(spark, sf_dir)), by_component=True)
    return c.select("project", F.array_join("cycle", ",").alias("cycle"), "length")


@query(
    "analyze_project_summary",
    with_(GEN)
    + """, tops AS (SELECT project, imp AS name FROM ok UNION SELECT project, 'm' || CAST(d AS VARCHAR) FROM ok WHERE d IS NOT NULL)
         SELECT g.project, CAST(count(*) AS BIGINT) AS total_files,
                CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS total_functions,
                CAST(sum(16 + CASE WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS total_lines,
                CAST((SELECT count(*) FROM tops t WHERE t.project = g.project AND t.name NOT IN ('os', 'json')) AS BIGINT) AS third_party_deps
         FROM gen g GROUP BY g.project""",
)
def analyze_project_summary(spark, sf_dir):
    """The whole-project entry point (exclusions, depth, report dict)."""
    from .project import analyze_project

    res = analyze_project(code_files(spark, sf_dir), exclude_patterns=["venv", "__pycache__"], max_depth=5, include_cycles=False)
    return res["summary"].select("project", "total_files", "total_functions", "total_lines", "third_party_deps")
