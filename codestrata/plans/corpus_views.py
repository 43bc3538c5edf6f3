"""Shared derivations for registered queries: the parsed corpora.

Each registered query re-derives its inputs from the parquet tables, so every
query's work grows with the tables. Within one query the parse happens once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import extract as X
from ..operators.graph import line_count
from ..sources.corpus import python_corpus
from pyspark.sql import functions as F


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_corpus(spark, sf_dir).select("project", "path", "text")


def parsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed corpus for a report that reads it once: nothing is kept."""
    files = code_files(spark, sf_dir).withColumn("n_lines", line_count(F.col("text")))
    return X.analyze_files(files, carry=["n_lines"])


def code_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed corpus, persisted: reports read it several times (edges,
    nodes, bindings, uses) and Catalyst cannot prune through the Python
    parse, so without persistence each reference would parse again. Blocks
    spill to disk under memory pressure and are recomputed from the parquet
    scan if an executor is lost."""
    return parsed_once(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
