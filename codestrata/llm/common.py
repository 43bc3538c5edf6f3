"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import checkpoint_dir

#: Texts of at most this many characters are handled together in a task.
CHUNK_CHARS = 4_000_000
#: Bits of a sieve: a fixed size, so it can be sent to every task.
SIEVE = 1 << 26


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (any Hadoop file system)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/codestrata-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    ends there, and a lost executor takes nothing with it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) with at most ``limit`` characters together
    unless one text alone is longer; nulls become empty texts."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def sieve(wanted: DataFrame, name: str) -> np.ndarray:
    """SIEVE bits, set where the hash in column ``name`` of a wanted row falls.
    It keeps most other rows out of a shuffle; a fuller one lets more through,
    which costs time but changes no result. The tasks make it, the driver gets
    at most SIEVE / 64 numbers."""
    bit = wanted.select(F.expr(f"pmod({name}, {SIEVE}) div 64").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({name}, 64) as int))").alias("b"))
    words = bit.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(SIEVE // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % SIEVE
    return (bits[at // 64] >> (at % 64)) & 1 == 1
