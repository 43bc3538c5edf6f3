"""Token-id files in the Arrow stream-file format (operator 7).

Documents are dealt into ranges of ascending ids; each task encodes its range
in order and cuts the id stream into equal sequences, which it puts out as
Arrow files of at most about ``file_ids`` ids:

    input_ids       fixed-size list of unsigned ids (16 bits if the vocabulary allows)
    attention_mask  fixed-size list of booleans, false for padding at a file's end
    doc_ids         ids of the documents that begin in the sequence
    doc_starts      where in the sequence each of them begins

A mapped file gives any sequence or mask without a copy. The files are written
by Spark's text writer, one file per row, with the format's closing magic as
the line separator: so commits, retries and any Hadoop file system work as for
every Spark table.

Defined results: a null text is empty and has one id, the end id; repeated
rows stay, equal ids ordered by text; null ids come first; an empty table gives
no rows. Other columns are ignored. One document's ids must fit a file of
under 2 GB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import chunks, column, materialize
from codestrata.llm.encoding import word_ids

MAGIC = "ARROW1"
BATCH = 1024
FILE_IDS = 4_000_000


def arrow_file(ids: list[np.ndarray], docs: pa.Array, length: int, part: int, number: int, wide: bool) -> bytes:
    """One Arrow file with the id streams of ``docs``."""
    sizes = np.array([len(x) for x in ids], np.int64)
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    rows = max(1, -(-total // length))
    flat = np.zeros(rows * length, np.uint32 if wide else np.uint16)
    flat[:total] = np.concatenate(ids)
    mask = np.arange(rows * length) < total
    cuts = np.searchsorted(begin, np.arange(rows + 1) * length).astype(np.int32)
    cuts[-1] = len(docs)
    offsets = pa.array(cuts)
    table = pa.table(
        {
            "input_ids": pa.FixedSizeListArray.from_arrays(pa.array(flat), length),
            "attention_mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
            "doc_ids": pa.ListArray.from_arrays(offsets, docs),
            "doc_starts": pa.ListArray.from_arrays(offsets, pa.array((begin % length).astype(np.int32))),
        }
    ).replace_schema_metadata({"part": str(part), "number": str(number), "ids": str(total)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=BATCH)
    return sink.getvalue().to_pybytes()


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, length: int = 1024, vocabulary: int = 65_536, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write the files of ``df`` below ``path`` (a Spark path)."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = slim.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    wide = vocabulary > 65_536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, part = word_ids(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        docs: list[pa.Array] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, held, number
            raw = arrow_file(ids, pa.concat_arrays(docs), length, part, number, wide)
            ids, docs, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([raw[: -len(MAGIC)]], pa.binary())], ["file"])

        for batch in batches:
            names = column(batch, "id")
            for first, texts in chunks(column(batch, "text").to_pylist()):
                own = [np.append(x, np.uint32(end_id)) for x in engine.batch(texts)]
                ids += own
                docs.append(names.slice(first, len(texts)))
                held += sum(map(len, own))
                if held >= file_ids:
                    yield flush()
        if ids:
            yield flush()

    files = ranged.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per document, from the files: ``(part, number, at, id, n_tokens, ids_crc32)``;
    ``at`` is its first id's place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                if not content.as_buffer().size:
                    continue
                reader = pa.ipc.open_file(content.as_buffer())
                about = {k.decode(): int(v) for k, v in reader.schema.metadata.items() if k in (b"part", b"number", b"ids")}
                table = reader.read_all().combine_chunks()
                seqs = table.column("input_ids").chunk(0)
                length, ids = seqs.type.list_size, seqs.flatten().to_numpy()
                if int(pc.sum(table.column("attention_mask").chunk(0).flatten()).as_py() or 0) != about["ids"]:
                    raise ValueError("a token file's mask and its number of ids differ")
                lists = table.column("doc_starts").chunk(0)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                at = row * length + lists.flatten().to_numpy()
                size = np.diff(np.append(at, about["ids"]))
                crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                n = len(at)
                whole = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [whole(about["part"]), whole(about["number"]), pa.array(at, pa.int64()), table.column("doc_ids").chunk(0).flatten(), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "number", "at", "id", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"part long, number long, at long, id {id_type}, n_tokens long, ids_crc32 long")


def document_index(spark: SparkSession, path: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: the id, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32``."""
    docs = materialize(read_token_files(spark, path, id_type), "token-index")
    files = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))  # one row per file
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "number", F.coalesce(before, F.lit(0)).alias("first"))
    joined = docs.join(starts, ["part", "number"])
    return joined.select(F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
