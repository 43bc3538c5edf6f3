"""Joins whose sides both grow with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_merge(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus, for a sort-merge join.

    Spark estimates parsed files by the width of the table columns that they
    are built from, and exploded lists by the rows that held them. Both come out
    far too small, so it would broadcast such a side, whole, through the driver."""
    return df.hint("merge")
