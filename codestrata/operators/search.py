"""Corpus text search: regex line matches, submatches, limits, context and the
configuration-key trace.

Plan shape: a narrow scan of ``files`` -> whole-file ``rlike`` prefilter (so
only files with a hit are split) -> ``posexplode`` of the line array -> line
filter. No shuffle until an ordered limit or a per-category count asks for one.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_glob, basename, line_array, suffix

# Search-tool file types and the globs they stand for.
FILE_TYPE_GLOBS = {
    "py": ["*.py", "*.pyi"],
    "python": ["*.py", "*.pyi"],
    "js": ["*.js", "*.jsx", "*.mjs", "*.cjs"],
    "ts": ["*.ts", "*.tsx", "*.cts", "*.mts"],
    "rust": ["*.rs"],
    "go": ["*.go"],
    "yaml": ["*.yaml", "*.yml"],
    "toml": ["*.toml"],
    "json": ["*.json"],
    "md": ["*.md", "*.markdown"],
    "markdown": ["*.md", "*.markdown"],
    "txt": ["*.txt"],
    "html": ["*.html", "*.htm"],
    "config": ["*.cfg", "*.conf", "*.config", "*.ini"],
    "docker": ["Dockerfile", "Dockerfile.*", "*.dockerfile"],
    "sh": ["*.sh", "*.bash"],
}

# Default globs of the configuration-key trace.
CONFIG_GLOBS = [
    "*.py", "*.yaml", "*.yml", "*.toml", "*.env", "*.env.*", "*.cfg", "*.ini", "*.json",
    "Dockerfile", "Dockerfile.*", "docker-compose*.yml", "docker-compose*.yaml", "*.conf", "*.properties",
]

def regex(pattern: str, case_sensitive: bool = True, unicode: bool = True) -> str:
    """The Java regex used for a user pattern: ``(?U)`` makes ``\\w``/``\\b``
    Unicode-aware like the search tool's, ``(?i)`` folds case."""
    flags = ("U" if unicode else "") + ("" if case_sensitive else "i")
    return f"(?{flags}){pattern}" if flags else pattern


_REGEX_META = set(".^$*+?{}[]\\|()")


def literal_of(pattern: str) -> str | None:
    """The pattern itself when it has no regex metacharacters (then a plain
    substring test is equivalent and much cheaper than a regex), else None."""
    return pattern if pattern and not (set(pattern) & _REGEX_META) else None


def select_files(
    files: DataFrame,
    file_types: str | Iterable[str] | None = None,
    globs: Iterable[str] | None = None,
    skip_hidden: bool | None = None,
) -> DataFrame:
    """File filters of the search tool: type list and/or name globs, hidden
    files (any path component starting with ``.``) unless a glob is given, and
    binary files (a NUL character)."""
    name = basename(F.col("path"))
    cond = ~F.col("text").contains("\u0000")
    if file_types:
        types = [t.strip() for t in (file_types.split(",") if isinstance(file_types, str) else file_types) if t.strip()]
        tglobs = [g for t in types for g in FILE_TYPE_GLOBS.get(t, [f"*.{t}"])]
        cond = cond & any_glob(name, tglobs)
    globs = list(globs or [])
    if globs:
        cond = cond & any_glob(name, globs)
    if skip_hidden is None:
        skip_hidden = not globs
    if skip_hidden:
        cond = cond & ~F.col("path").rlike(r"(^|/)\.")
    return files.where(cond)


def lines(files: DataFrame) -> DataFrame:
    """Every line of every file: ``(project, path, line, text)``, 1-based."""
    return files.select(
        "project", "path", F.posexplode(line_array(F.col("text"))).alias("pos", "text")
    ).select("project", "path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def search_text(
    files: DataFrame,
    pattern: str,
    *,
    case_sensitive: bool = True,
    file_types: str | Iterable[str] | None = None,
    glob: str | Iterable[str] | None = None,
    context_lines: int = 0,
    per_file_limit: int | None = None,
) -> DataFrame:
    """Regex line search. Returns ``(project, path, line, text)`` (plus
    ``before``/``after`` context strings when ``context_lines > 0``).

    The whole-file prefilter uses ``(?m)`` so ``^``/``$`` keep their line
    meaning; every line match is also a file match, so the prefilter only
    drops files without hits. Context is sliced from the file's own line
    array, so it costs no shuffle.
    """
    rx = regex(pattern, case_sensitive)
    lit = literal_of(pattern) if case_sensitive else None
    globs = [glob] if isinstance(glob, str) else list(glob or [])
    pre = F.col("text").contains(lit) if lit else F.col("text").rlike(f"(?m){rx}")
    f = select_files(files, file_types, globs).where(pre)
    # chunked sources (see sources.tree) number their lines from line_offset
    off = F.col("line_offset") if "line_offset" in files.columns else F.lit(0)
    f = f.select("project", "path", off.cast("long").alias("_off"), line_array(F.col("text")).alias("arr"))
    hit = F.col("text").contains(lit) if lit else F.col("text").rlike(rx)
    m = f.select("project", "path", "_off", "arr", F.posexplode("arr").alias("pos", "text")).where(hit)
    cols = ["project", "path", (F.col("pos") + 1 + F.col("_off")).cast("long").alias("line"), "text"]
    if context_lines and context_lines > 0:
        n = int(context_lines)
        start = F.greatest(F.col("pos") + 1 - n, F.lit(1))
        cols += [
            F.array_join(F.slice("arr", start, F.col("pos") + 1 - start), "\n").alias("before"),
            F.array_join(F.slice("arr", F.col("pos") + 2, F.lit(n)), "\n").alias("after"),
        ]
    out = m.select(*cols)
    if per_file_limit is not None:
        out = limit_per_file(out, per_file_limit)
    return out


def limit_per_file(matches: DataFrame, n: int) -> DataFrame:
    """First ``n`` matches of every file (the tool's per-file max count).
    Two-phase salted top-k: a huge (chunked) file does not land in one task."""
    from ..plans.topk import top_k_per_group

    return top_k_per_group(matches, ["project", "path"], ["line"], n).drop("rank")


def first_results(matches: DataFrame, max_results: int) -> DataFrame:
    """Global cap in ``(path, line)`` order -> ``TakeOrderedAndProject``
    (each task keeps its own top ``n``; only ``n`` rows per task reach the
    final merge)."""
    return matches.orderBy("path", "line", "project").limit(max_results)


def search_summary(matches: DataFrame, max_results: int) -> DataFrame:
    """``total`` matches after the per-file cap of ``max_results + 1``,
    ``count`` returned and ``truncated = total > max_results``.

    One partial aggregate per file, then a single-row sum."""
    per_file = matches.groupBy("project", "path").agg(F.count("*").alias("n"))
    total = F.sum(F.least(F.col("n"), F.lit(max_results + 1))).cast("long")
    return per_file.agg(
        F.coalesce(total, F.lit(0).cast("long")).alias("total"),
        F.count("*").cast("long").alias("files_with_matches"),
    ).select(
        "total",
        F.least(F.col("total"), F.lit(max_results).cast("long")).alias("count"),
        (F.col("total") > max_results).alias("truncated"),
        "files_with_matches",
    )


def submatch_texts(matches: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """Adds ``submatches`` (matched substrings, left to right) and their count."""
    rx = regex(pattern, case_sensitive)
    found = F.regexp_extract_all(F.col("text"), F.lit(rx), 0)
    return matches.withColumn("submatches", found).withColumn("n_submatches", F.size(found).cast("long"))


SUBMATCH_TYPE = T.ArrayType(
    T.StructType([T.StructField("match", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def _offsets_udf(py_pattern: str, flags: int):
    import re

    compiled = re.compile(py_pattern, flags)

    @F.pandas_udf(SUBMATCH_TYPE)
    def offsets(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            row = []
            if t is not None:
                for m in compiled.finditer(t):
                    if m.end() == m.start():
                        continue
                    s = len(t[: m.start()].encode("utf-8"))
                    row.append({"match": m.group(0), "start": s, "end": s + len(m.group(0).encode("utf-8"))})
            out.append(row)
        return pd.Series(out, dtype=object)

    return offsets


def submatch_offsets(matches: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """Adds ``submatches array<struct<match,start,end>>`` with UTF-8 **byte**
    offsets, as the search tool reports them. Runs in an Arrow-batched UDF on
    matched lines only (Java regex has no per-match offsets). The pattern is
    read with Python's ``re``; keep to the shared dialect."""
    import re

    flags = re.UNICODE | (0 if case_sensitive else re.IGNORECASE)
    return matches.withColumn("submatches", _offsets_udf(pattern, flags)(F.col("text")))


# ---------------------------------------------------------------------------
# Configuration-key trace
# ---------------------------------------------------------------------------


def config_category(path: Column) -> Column:
    """File category, first rule wins. ``ext`` is the suffix, else the lower
    file name; the name tests look at the whole relative path."""
    ext0 = suffix(path)
    ext = F.when(ext0 == "", F.lower(basename(path))).otherwise(ext0)
    low = F.lower(path)
    return (
        F.when(ext == "py", "python")
        .when(ext.isin("yaml", "yml") & low.contains("docker-compose"), "docker-compose")
        .when(ext.isin("yaml", "yml"), "yaml")
        .when(ext == "toml", "toml")
        .when((ext == "env") | low.contains(".env"), "env")
        .when(ext.isin("cfg", "ini", "conf", "properties"), "config")
        .when(ext == "json", "json")
        .when(low.contains("dockerfile"), "docker")
        .otherwise("other")
    )


def find_config_references(files: DataFrame, key: str, file_types: str | None = None) -> DataFrame:
    """Every line mentioning ``key`` (a regex, case-insensitive) in config-like
    files, with its category. No limit."""
    if file_types:
        m = search_text(files, key, case_sensitive=False, file_types=file_types)
    else:
        m = search_text(files, key, case_sensitive=False, glob=CONFIG_GLOBS)
    return m.withColumn("category", config_category(F.col("path")))


def config_category_counts(refs: DataFrame) -> DataFrame:
    """References per category plus an overall ``TOTAL`` row (``rollup``)."""
    return (
        refs.rollup("category")
        .agg(F.count("*").cast("long").alias("n_refs"), F.countDistinct(F.struct("project", "path")).cast("long").alias("n_files"))
        .select(F.coalesce(F.col("category"), F.lit("TOTAL")).alias("category"), "n_refs", "n_files")
    )


def search_report(
    files: DataFrame,
    pattern: str,
    *,
    max_results: int = 100,
    case_sensitive: bool = True,
    file_types: str | Iterable[str] | None = None,
    glob: str | Iterable[str] | None = None,
    context_lines: int = 0,
) -> dict[str, DataFrame]:
    """D1-D6 in the reference's shape: ``matches`` (first ``max_results`` in
    (path, line) order) and a one-row ``summary`` with ``match_count`` and
    ``truncated`` computed over the per-file cap of ``max_results + 1``."""
    from pyspark import StorageLevel

    # both outputs read the matches: search once
    m = search_text(files, pattern, case_sensitive=case_sensitive, file_types=file_types, glob=glob, context_lines=context_lines).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    s = search_summary(m, max_results).select(F.col("count").alias("match_count"), "truncated", "total", "files_with_matches")
    return {"matches": first_results(m, max_results), "summary": s}
