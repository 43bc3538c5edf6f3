"""Packing by first-fit decreasing in randomised groups (operator 6).

A document's ids (with the end id) are cut into pieces of at most ``length``;
whole pieces are sequences of their own. All pieces are dealt by a hash into
groups of about ``group_docs`` documents; a group's pieces come longest first,
and a tournament tree over the bins' free places finds the first bin that has
room. Groups are independent, so any number of tasks can work on them, and a
group is read as a stream: after ``MAX_ITEMS`` pieces its bins are closed and
new ones begin, so memory stays bounded even if one id is repeated endlessly.

Defined results: a null text is empty and has one token, the end id; every row
is packed, repeated rows and null ids too; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import column
from codestrata.llm.encoding import byte_ids

MAX_ITEMS = 65_536
#: Sequence ids are group * GROUP_SPAN + number in the group.
GROUP_SPAN = 1 << 32


class FreePlaces:
    """Tournament tree: each inner node holds the larger of its two children,
    so the leftmost bin with enough room is found from the root down."""

    def __init__(self, leaves: int = 64):
        self.leaves, self.bins = leaves, 0
        self.most = [0] * (2 * leaves)

    def add(self, free: int) -> int:
        if self.bins == self.leaves:
            old = self.most[self.leaves :]
            self.leaves *= 2
            self.most = [0] * self.leaves + old + [0] * len(old)
            for k in range(self.leaves - 1, 0, -1):
                self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])
        self.bins += 1
        self.set(self.bins - 1, free)
        return self.bins - 1

    def set(self, which: int, free: int) -> None:
        most, k = self.most, which + self.leaves
        most[k] = free
        while k > 1:
            k //= 2
            larger = max(most[2 * k], most[2 * k + 1])
            if most[k] == larger:
                break
            most[k] = larger

    def first(self, need: int) -> int:
        """The first bin with ``need`` free places, or -1."""
        most, k = self.most, 1
        if most[1] < need:
            return -1
        while k < self.leaves:
            k *= 2
            if most[k] < need:
                k += 1
        return k - self.leaves

    def free(self, which: int) -> int:
        return self.most[which + self.leaves]


class GroupPacker:
    """Places the pieces of one group, longest first, into numbered bins."""

    def __init__(self, length: int):
        self.length, self.next, self._fresh = length, 0, 0
        self._reset()

    def _reset(self) -> None:
        self.tree, self.number, self.items = FreePlaces(), [], 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        if size == self.length:
            self.next += 1
            return self.next - 1, 0
        if self.items == MAX_ITEMS:
            self._reset()
        self.items += 1
        which = self.tree.first(size)
        if which < 0:
            which = self.tree.add(self.length)
            self.number.append(self.next)
            self.next += 1
        free = self.tree.free(which)
        self.tree.set(which, free - size)
        return self.number[which], self.length - free


def pieces(df: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)`` per piece, and with
    ``with_ids`` the ids as little-endian unsigned 32-bit ``ids``."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = byte_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            row_of: list[int] = []
            for k, t in enumerate(column(batch, "text")):
                raw = np.append(engine.ids(t.as_py()), np.uint32(end_id)).astype("<u4").tobytes()
                total = len(raw) // 4
                for start in range(0, total, length):
                    own = raw[4 * start : 4 * (start + length)]
                    row_of.append(k)
                    rows.append((start, len(own) // 4, zlib.crc32(own), total, own if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [column(batch, "id").take(pa.array(row_of, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:4]]]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return slim.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(df: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_docs: int = 4096, seed: int = 42, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``)."""
    groups = max(1, -(-df.select(id_col).count() // group_docs))
    cut = pieces(df, tokenizer, length, end_id, id_col, text_col, with_ids)
    # the row's number, too: an id that is repeated or null endlessly still spreads
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    ordered = dealt.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "id", "start", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, GroupPacker(length)
        for batch in batches:
            seq, off = [], []
            for g, size in zip(column(batch, "grp").to_pylist(), column(batch, "length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, GroupPacker(length)
                where, at = packer.place(size)
                seq.append(g * GROUP_SPAN + where)
                off.append(at)
            kept = [k for k, name in enumerate(batch.schema.names) if name != "grp"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*[batch.schema.names[k] for k in kept], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, used)`` of :func:`pack` rows with ids: the pieces of
    each sequence joined by offset (at most one sequence's length each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("used")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "used")
