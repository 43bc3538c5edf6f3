"""DuckDB-side building blocks of the oracles (plain SQL text)."""

from ..sources.tables import DOC_EXTENSIONS

_EXTS = ", ".join(f"'{e}'" for e in DOC_EXTENSIONS)

# documents as files(project, path, body) -- body = text minus one final newline
DOC_FILES = f"""
doc_files AS (
  SELECT doc_id, source AS project,
         source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.' || ([{_EXTS}])[doc_id % 9 + 1] AS path,
         CASE WHEN right(coalesce(text, ''), 1) = chr(10) THEN substr(text, 1, length(text) - 1) ELSE coalesce(text, '') END AS body
  FROM documents
),
doc_arrays AS (SELECT project, path, string_split(body, chr(10)) AS arr FROM doc_files),
doc_lines AS (
  SELECT project, path, arr, line, arr[line] AS text
  FROM (SELECT project, path, arr, generate_subscripts(arr, 1) AS line FROM doc_arrays)
)
"""

# generated Python corpus keys (see sources.corpus.python_corpus)
GEN = """
gen0 AS (SELECT p_partkey AS k, p_partkey // 5 AS b, p_partkey % 5 AS i, (SELECT max(p_partkey) FROM part) AS mx FROM part),
gen AS (
  SELECT k, b, i, 'proj' || CAST(b % 10 AS VARCHAR) AS project, 'm' || CAST(k AS VARCHAR) || '.py' AS path,
         'm' || CAST(k AS VARCHAR) AS module,
         CASE WHEN b % 2 = 0 AND b * 5 + 4 <= mx THEN b * 5 + (i + 1) % 5
              WHEN b % 2 = 1 AND i < 4 AND k + 1 <= mx THEN k + 1 END AS d,
         k % 50 = 49 AS broken,
         (['os', 'json', 'pandas', 'numpy'])[k % 4 + 1] AS imp
  FROM gen0
),
ok AS (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS hd FROM gen WHERE NOT broken)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"
