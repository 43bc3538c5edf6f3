"""Registered text-search queries (D1-D9) over the ``documents`` corpus."""

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import doc_extension, document_files, table
from .registry import query
from .sql_common import DOC_FILES, with_

PATTERN = "License"


@query(
    "search_text",
    with_(DOC_FILES) + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, 'License')",
)
def search_text(spark, sf_dir):
    return S.search_text(document_files(spark, sf_dir), PATTERN)


@query(
    "search_ignore_case",
    with_(DOC_FILES) + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, '(?i)apache')",
)
def search_ignore_case(spark, sf_dir):
    return S.search_text(document_files(spark, sf_dir), "apache", case_sensitive=False)


@query(
    "search_limit_per_file",
    with_(DOC_FILES)
    + """SELECT project, path, line, text FROM (
           SELECT project, path, CAST(line AS BIGINT) AS line, text,
                  row_number() OVER (PARTITION BY path ORDER BY line) AS rn
           FROM doc_lines WHERE regexp_matches(text, '(?i)the')) WHERE rn <= 2""",
)
def search_limit_per_file(spark, sf_dir):
    return S.search_text(document_files(spark, sf_dir), "the", case_sensitive=False, per_file_limit=2)


@query(
    "search_context",
    with_(DOC_FILES)
    + """SELECT project, path, CAST(line AS BIGINT) AS line, text,
              array_to_string(arr[greatest(line - 2, 1):line - 1], chr(10)) AS before,
              array_to_string(arr[line + 1:line + 2], chr(10)) AS after
         FROM doc_lines WHERE regexp_matches(text, 'License')""",
)
def search_context(spark, sf_dir):
    return S.search_text(document_files(spark, sf_dir), PATTERN, context_lines=2)


@query(
    "search_first_results",
    with_(DOC_FILES)
    + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, 'License') ORDER BY path, line LIMIT 20",
)
def search_first_results(spark, sf_dir):
    return S.first_results(S.search_text(document_files(spark, sf_dir), PATTERN), 20)


@query(
    "search_summary",
    with_(DOC_FILES)
    + """, per_file AS (SELECT path, count(*) AS n FROM doc_lines WHERE regexp_matches(text, '(?i)the') GROUP BY path)
         SELECT CAST(coalesce(sum(least(n, 101)), 0) AS BIGINT) AS total,
                CAST(least(coalesce(sum(least(n, 101)), 0), 100) AS BIGINT) AS count,
                coalesce(sum(least(n, 101)), 0) > 100 AS truncated,
                CAST(count(*) AS BIGINT) AS files_with_matches
         FROM per_file""",
)
def search_summary(spark, sf_dir):
    return S.search_summary(S.search_text(document_files(spark, sf_dir), "the", case_sensitive=False), 100)


@query(
    "submatch_counts",
    with_(DOC_FILES)
    + """SELECT path, CAST(line AS BIGINT) AS line, CAST(len(regexp_extract_all(text, '[Ll]icen[sc]e[ds]?')) AS BIGINT) AS n_submatches
         FROM doc_lines WHERE regexp_matches(text, '[Ll]icen[sc]e[ds]?')""",
)
def submatch_counts(spark, sf_dir):
    m = S.search_text(document_files(spark, sf_dir), "[Ll]icen[sc]e[ds]?")
    return S.submatch_texts(m, "[Ll]icen[sc]e[ds]?").select("path", "line", "n_submatches")


@query(
    "submatch_offsets",
    with_(DOC_FILES)
    + """, m AS (SELECT path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, 'License'))
         SELECT path, line, CAST(strlen(substr(text, 1, strpos(text, 'License') - 1)) AS BIGINT) AS first_start,
                CAST(len(regexp_extract_all(text, 'License')) AS BIGINT) AS n_submatches FROM m""",
)
def submatch_offsets(spark, sf_dir):
    m = S.submatch_offsets(S.search_text(document_files(spark, sf_dir), PATTERN), PATTERN)
    return m.select("path", "line", F.col("submatches")[0]["start"].cast("long").alias("first_start"), F.size("submatches").cast("long").alias("n_submatches"))


_CATEGORY_SQL = """
CASE
  WHEN ext = 'py' THEN 'python'
  WHEN ext IN ('yaml', 'yml') AND contains(lower(path), 'docker-compose') THEN 'docker-compose'
  WHEN ext IN ('yaml', 'yml') THEN 'yaml'
  WHEN ext = 'toml' THEN 'toml'
  WHEN ext = 'env' OR contains(lower(path), '.env') THEN 'env'
  WHEN ext IN ('cfg', 'ini', 'conf', 'properties') THEN 'config'
  WHEN ext = 'json' THEN 'json'
  WHEN contains(lower(path), 'dockerfile') THEN 'docker'
  ELSE 'other' END"""

_CONFIG_REFS = (
    with_(DOC_FILES)
    + f""", refs0 AS (
        SELECT project, path, CAST(line AS BIGINT) AS line, text, regexp_extract(path, '\\.([^./]+)$', 1) AS ext
        FROM doc_lines
        WHERE regexp_matches(text, '(?i)licen[sc]e')
          AND regexp_matches(regexp_extract(path, '[^/]+$', 0),
              '^(.*\\.py|.*\\.yaml|.*\\.yml|.*\\.toml|.*\\.env|.*\\.env\\..*|.*\\.cfg|.*\\.ini|.*\\.json|Dockerfile|Dockerfile\\..*|docker-compose.*\\.yml|docker-compose.*\\.yaml|.*\\.conf|.*\\.properties)$')),
      refs AS (SELECT project, path, line, text, {_CATEGORY_SQL} AS category FROM refs0)
"""
)


@query("config_refs", _CONFIG_REFS + "SELECT project, path, line, text, category FROM refs")
def config_refs(spark, sf_dir):
    return S.find_config_references(document_files(spark, sf_dir), "licen[sc]e")


@query(
    "config_category_counts",
    _CONFIG_REFS
    + """SELECT coalesce(category, 'TOTAL') AS category, CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT path) AS BIGINT) AS n_files
         FROM refs GROUP BY ROLLUP (category)""",
)
def config_category_counts(spark, sf_dir):
    return S.config_category_counts(S.find_config_references(document_files(spark, sf_dir), "licen[sc]e"))


@query(
    "search_by_type",
    with_(DOC_FILES)
    + """SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines
         WHERE regexp_matches(text, 'License') AND regexp_matches(path, '\\.(yaml|yml)$')""",
)
def search_by_type(spark, sf_dir):
    return S.search_text(document_files(spark, sf_dir), PATTERN, file_types="yaml")


_PAGE_LINES = """
page_files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || CAST(page_id AS VARCHAR) || '.html' AS path,
         CASE WHEN right(coalesce(html, ''), 1) = chr(10) THEN substr(html, 1, length(html) - 1) ELSE coalesce(html, '') END AS body
  FROM pages),
page_lines AS (
  SELECT project, path, line, arr[line] AS text
  FROM (SELECT project, path, arr, generate_subscripts(arr, 1) AS line FROM (SELECT project, path, string_split(body, chr(10)) AS arr FROM page_files)))
"""


@query(
    "search_pages",
    with_(_PAGE_LINES) + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM page_lines WHERE regexp_matches(text, '<title>[A-Z]')",
)
def search_pages(spark, sf_dir):
    from ..sources.tables import page_files

    return S.search_text(page_files(spark, sf_dir), "<title>[A-Z]")


@query(
    "decode_files",
    with_(DOC_FILES)
    + "SELECT path, CAST(length(body) AS BIGINT) AS n_chars FROM doc_files WHERE doc_id % 13 <> 0",
)
def decode_files(spark, sf_dir):
    """A2: documents as raw bytes (every 13th with an invalid UTF-8 tail)
    decoded back; undecodable files are skipped."""
    from ..functions.text import body
    from ..sources.tables import decode_files as decode

    d = table(spark, sf_dir, "documents")
    raw = F.encode(body(F.coalesce("text", F.lit(""))), "UTF-8")
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    files = d.select(
        F.col("source").alias("project"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), doc_extension(F.col("doc_id")))).alias("path"),
        content.alias("content"),
    )
    return decode(files).select("path", F.length("text").cast("long").alias("n_chars"))


def _index(spark, sf_dir):
    """The documents' trigram index, in a folder of its own."""
    import uuid

    from ..operators import trigrams as I
    from ..session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/codestrata-index-{uuid.uuid4().hex}"
    I.build_index(document_files(spark, sf_dir), path)
    return path


@query(
    "indexed_search",
    with_(DOC_FILES) + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, 'License')",
)
def indexed_search(spark, sf_dir):
    from ..operators import trigrams as I

    return I.search_index(spark, _index(spark, sf_dir), PATTERN)


@query(
    "indexed_search_regex",
    with_(DOC_FILES) + "SELECT project, path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, '(?i)(apache|mit) +lic[a-z]+ns[ei]')",
)
def indexed_search_regex(spark, sf_dir):
    from ..operators import trigrams as I

    return I.search_index(spark, _index(spark, sf_dir), "(apache|mit) +lic[a-z]+ns[ei]", case_sensitive=False)
