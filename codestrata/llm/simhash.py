"""SimHash near-duplicates by covering locality-sensitive hashing (operator 3).

A text's fingerprint is the bitwise majority over the XXH64 hashes of its
three-word shingles. Position i of a fingerprint gets a non-zero vector c(i)
of radius + 1 bits; table v (every non-zero vector) keeps the positions with
c(i).v odd. At most ``radius`` differing positions span a space that some v is
orthogonal to, so two fingerprints within the radius agree on all positions of
at least one of the 2^(radius+1) - 1 tables: no linked pair is missed. Equal
keys are only candidates; the bit distance decides.

Distinct fingerprints are linked, not documents, and a bucket yields a
spanning forest of its links, not its pairs; buckets beyond a bound are cut
into chunk pairs. Copies in any number therefore cost one fingerprint.

Defined results: null and word-free texts have fingerprint zero and link like
any other; one row per input row; null ids keep their row and never name a
component unless all ids of it are null; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import column, materialize
from codestrata.llm.components import LocalSets, bucket_tiles, connected_components, whole_groups

BOUND = 16_384
BLOCK = 65_536


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles, in blocks."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for first in range(0, len(words) - size + 1, BLOCK):
        own = words[first : first + BLOCK + size - 1]
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(own) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority fingerprint (unsigned 64 bits); zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and spaces only
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words, size, seed):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)`` per row; fp is the fingerprint as a signed long."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size, seed) for t in column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def masks(radius: int) -> list[int]:
    """Signed masks of the covering tables; positions take the code vectors in turn."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    found = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: each one, once
    reached, is held against those not reached yet."""
    out: list[tuple[int, int]] = []
    rest = values
    while len(rest) > 1:
        stack, rest = [rest[-1]], rest[:-1]
        while stack and len(rest):
            here = stack.pop()
            near = np.bitwise_count(rest ^ here) <= radius
            if near.any():
                found = rest[near]
                out += [(int(here), int(x)) for x in found]
                stack.extend(found)
                rest = rest[~near]
    return out


def link_fingerprints(distinct: DataFrame, radius: int = 3, bound: int = BOUND) -> DataFrame:
    """``(a, b)``: links that connect whatever is connected among ``distinct(fp)``."""
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks(radius))]))
    keyed = distinct.select("fp", tables.alias("key")).select(F.xxhash64("key.t", "key.k").alias("g"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = LocalSets()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sets.take()], ["a", "b"])
        for table, cuts in whole_groups(batches, "g"):
            signed = table.column("fp").to_numpy()
            fp = signed.view(np.uint64)
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            for a, b in zip(signed[near].tolist(), signed[near + 1].tolist(), strict=True):
                sets.join(a, b)
            for first, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if links := forest(np.unique(fp[first : first + n]), radius):
                    for a, b in np.array(links, np.uint64).view(np.int64).tolist():
                        sets.join(a, b)
            if sets.full:
                yield flush()
        yield flush()

    tiles = bucket_tiles(keyed, "fp", bound)
    return tiles.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, size: int = 3, seed: int = 42, bound: int = BOUND) -> DataFrame:
    """One row per row: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``radius`` differing bits."""
    prints = materialize(fingerprints(df, id_col, text_col, size, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius, bound))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = named.where(F.col("root").isNotNull())
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
