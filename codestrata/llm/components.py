"""Connected components of an edge table, and links inside hash buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; the root is the
    smallest node reachable.

    Alternating large-star and small-star steps: the number of edges never
    grows, each step is a partial aggregation and a join on the node, and the
    rounds grow with the logarithm of the longest chain. Every round is a
    reliable checkpoint in the shared folder. Null ends and loops are ignored.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large.a == low.u)
        edges = small.select("a", F.col("m").alias("b")).union(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select("b", "b").distinct())


def bucket_tiles(rows: DataFrame, member: str, bound: int) -> DataFrame:
    """Rows ``(g, <member>)`` of buckets with two members or more, where a
    bucket of over ``bound`` members is cut into chunks and every pair of
    chunks becomes a group of its own: all pairs still meet somewhere, and no
    group holds much more than ``2 * bound`` rows."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(sizes, "g")
    parts = F.ceil(F.col("n") / bound).cast("long")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), parts)
    whole = held.where(F.col("n") <= bound).select("g", member)
    cut = held.where(F.col("n") > bound).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pair = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    # the pair of a chunk with itself is covered by any of its other pairs
    return whole.union(cut.where("own != other").select(pair.alias("g"), member))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by ``key``: tables that hold whole groups only, with
    the position where each group starts and, at last, the length."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield table.slice(0, last), bounds(keys[:last])
        rest = table.slice(last).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, bounds(table.column(key).to_numpy())


class LocalSets:
    """Disjoint sets of the links a task has found; of a chain only
    ``(node, smallest node)`` links go on, so few rounds are left to do."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    @property
    def full(self) -> bool:
        return len(self.up) > self.LIMIT

    def take(self) -> tuple[list, list]:
        """The links, which are then forgotten."""
        links = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        self.up = {}
        return [a for a, _ in links], [b for _, b in links]


def bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
