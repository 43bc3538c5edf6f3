"""Driver tables and the ``files`` views derived from them.

Every operator in this package takes ``files(project, path, text)`` or a table
derived from it. Here the views are built from the parquet tables with plain
column expressions, so the scan keeps column pruning and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Extension given to document ``doc_id % 9`` so that the text corpus carries
# the file kinds the configuration trace classifies.
DOC_EXTENSIONS = ("py", "yaml", "yml", "toml", "env", "ini", "json", "conf", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_extension(doc_id: Column) -> Column:
    exts = F.array(*[F.lit(e) for e in DOC_EXTENSIONS])
    return F.element_at(exts, (doc_id % len(DOC_EXTENSIONS) + 1).cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a file corpus: ``project = source``,
    ``path = source/lang/<doc_id>.<ext>``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), doc_extension(F.col("doc_id")))).alias("path"),
        F.col("text"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a file corpus (``project`` = host, ``path`` = host/page_id.html)."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return p.select(
        host.alias("project"),
        F.concat(host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("text"),
    )


def decode_files(binary_files: DataFrame) -> DataFrame:
    """A2: ``(project, path, content binary)`` -> ``(project, path, text)``,
    dropping files that are not valid UTF-8 (as the reference skips them)."""
    s = F.col("content").cast("string")
    return binary_files.where(F.is_valid_utf8(s)).select("project", "path", s.alias("text"))
