"""Skew-safe top-k per group.

``row_number() over (partition by key ...)`` sends every row of a key to one
task; with a hot key (a third of all rows) that task sorts the whole key. The
two-phase form first keeps the top ``k`` inside ``(key, salt)`` sub-groups, so
at most ``k * buckets`` rows per key reach the final window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    buckets: int = 64,
    salt_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Rows ranked ``<= k`` within ``keys`` by ``order`` (ties broken by the
    order columns themselves; make them unique for a deterministic result).

    ``salt_cols`` (default: the order columns) are hashed into ``buckets``
    sub-groups for the first phase.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    salt_src = [F.col(c) for c in salt_cols] if salt_cols else order
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    phase1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return phase1.withColumn("rank", F.row_number().over(w2).cast("long")).where(F.col("rank") <= k)
