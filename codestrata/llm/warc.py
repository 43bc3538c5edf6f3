"""WARC writing, and reading by boundary-chain verification (operator 5).

Writing uses Spark's text writer: a row is a record, the line separator is the
record's closing CRLF CRLF. The first page (smallest id) of equal payloads is a
``response``, the others are ``revisit`` records without a block.

Reading uses Spark's text reader with the magic ``WARC/1.0`` CRLF as separator,
so files are cut into byte ranges and a row is whatever follows a magic, true
record or payload. Each task emits its rows as candidates with the place of
their successor (place + header + Content-Length + 4), and follows the links
inside its range, so that a candidate points to the first place beyond the
range. Pointer jumping over these (doubled every round) from each file's start
finds the one true entry of every range, and a walk from there keeps the
reachable records: a magic inside a payload is never reached, whatever follows
it. A payload with a magic in it spans several rows and is put together again.

Defined results: a null payload is empty; a null url gives no target line,
blanks and control characters in it become %20; pages with a null id are
responses of their own; several rows with the smallest id are all responses;
an empty table gives an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import column, materialize, passes, sieve
from codestrata.session import checkpoint_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAME = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits are 4 runs of 40 bits."""
    digits = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*runs)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(rid, rsha, first)`` of the pages whose payload an earlier page has.
    ``pages`` has id, sha and size."""
    narrow = pages.select("id", "sha", "size").where("id is not null").where(F.col("size") >= least)
    firsts = narrow.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(firsts, ["sha", "size"]).where("id > first").select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "first").distinct()


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Write a record per row of ``df`` into archives below ``path`` (a Spark path)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    pages = pages.select("*", base32_sha1(F.col("payload").cast("binary")).alias("sha"), F.octet_length("payload").alias("size"))
    again = materialize(revisits(pages, least), "revisits")
    bits = sieve(again.select(F.xxhash64("rid").alias("h")), "h")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("maybe", pa.array(passes(bits, column(batch, "h").to_numpy())))

    # only pages that may be revisits have to meet the table of revisits
    marked = pages.withColumn("h", F.xxhash64("id"))
    marked = marked.mapInArrow(mark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema) + ", maybe boolean").drop("h")
    met = marked.where("maybe").join(again, (F.col("id") == again.rid) & (F.col("sha") == again.rsha), "left").drop("rid", "rsha")
    records = marked.where("not maybe").withColumn("first", F.lit(None).cast(again.schema["first"].dataType)).unionByName(met)
    visited = F.col("first").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    named = lambda c: F.concat(F.lit(f"<{NAME}"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        F.when(visited, F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", named(F.col("id"))),
        line("WARC-Refers-To", named(F.col("first"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.when(visited, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(visited, F.lit("")).otherwise(F.col("payload")),
    )
    records.select(record.alias("value")).write.option("lineSep", END).text(path)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=MAGIC).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def parse_header(raw: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(header length, block length, fields), or None if this is no header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    return (end + 4, int(size), fields) if size.isascii() and size.isdigit() and len(size) < 16 else None


CANDIDATE = (
    "file string, block long, rel long, size long, next long, leave long, head long, body long, whole boolean, "
    "type string, id string, refers string, digest string, told string, payload_length long"
)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for whatever follows a magic. ``rel``: its place in its byte
    range's rows; ``next``: its successor's (null: no header); ``leave``: the
    first place beyond the range on its chain (null: the chain breaks off)."""

    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [pa.field(f.split()[0], kinds[f.split()[1]]) for f in CANDIDATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rel, held = None, 0, []

        def flush() -> pa.RecordBatch:
            leave: dict[int, int | None] = {}
            for row in reversed(held):
                if row["next"] is not None:
                    # inside the range a successor must be a candidate itself
                    row["leave"] = row["next"] if row["next"] >= rel else leave.get(row["next"])
                leave[row["rel"]] = row["leave"]
            out = pa.RecordBatch.from_pylist(held, pa.schema(fields))
            held.clear()
            return out

        for batch in batches:
            for raw, file, block in zip(column(batch, "raw"), column(batch, "file").to_pylist(), column(batch, "block").to_pylist(), strict=True):
                if (file, block) != where:
                    if held:
                        yield flush()
                    where, rel = (file, block), 0
                content = raw.as_py()
                row = dict.fromkeys(names) | {"file": file, "block": block, "rel": rel, "size": len(content), "whole": False}
                # what comes before a file's first magic is no record
                if (block or rel) and (header := parse_header(content)):
                    head, body, told = header
                    row |= {"next": rel + head + body + 4 + len(MAGIC), "head": head, "body": body, "type": told.get("warc-type"), "told": told.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                    row |= {k: told[f][len(NAME) + 1 : -1] if told.get(f, "").startswith(f"<{NAME}") else None for k, f in (("id", "warc-record-id"), ("refers", "warc-refers-to"))}
                    length = told.get("warc-payload-length", "")
                    row["payload_length"] = int(length) if length.isascii() and length.isdigit() and len(length) < 16 else None
                    row["whole"] = len(content) == head + body + 4 and content.endswith(END.encode())
                    if row["whole"]:
                        row["digest"] = base64.b32encode(hashlib.sha1(content[head : head + body]).digest()).decode()
                held.append(row)
                rel += len(content) + len(MAGIC)
        if held:
            yield flush()

    return _rows(spark, path).mapInArrow(run, CANDIDATE)


def range_bases(found: DataFrame) -> DataFrame:
    """``(file, block, base)``: where a byte range's rows begin in the file."""
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def range_entries(placed: DataFrame) -> DataFrame:
    """``(file, at)``: the records where the chain from the file's start enters
    a byte range, by pointer jumping: after round k the entries hold all within
    2^k ranges, and every pointer spans 2^k ranges."""
    checkpoint_dir(placed.sparkSession)
    jump = placed.where("leave is not null").select("file", F.col("at").alias("a"), (F.col("base") + F.col("leave")).alias("z")).checkpoint()
    entries = placed.where(F.col("at") == len(MAGIC)).select("file", "at")
    while True:
        onward = entries.join(jump.withColumnRenamed("a", "at"), ["file", "at"]).select("file", F.col("z").alias("at"))
        entries = entries.union(onward).distinct().checkpoint()
        jump = jump.withColumnRenamed("z", "m").join(jump.select("file", F.col("a").alias("m"), "z"), ["file", "m"]).select("file", "a", "z").checkpoint()
        if jump.isEmpty():
            return entries


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: ``(file, at, type, id, refers, size, digest,
    told, payload_length)``. size and digest are of the block read, told and
    payload_length what the header says of the payload."""
    found = materialize(candidates(spark, path), "warc-candidates")
    placed = found.join(range_bases(found), ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    entries = range_entries(placed).withColumn("entry", F.lit(True))
    marked = placed.join(entries, ["file", "at"], "left").withColumn("after", F.col("base") + F.col("next")).drop("base", "rel", "next", "leave")
    order = marked.repartition("file", "block").sortWithinPartitions("file", "block", "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, due = None, None
        for batch in batches:
            keep = []
            for file, block, at, entry, after in zip(*[column(batch, c).to_pylist() for c in ("file", "block", "at", "entry", "after")], strict=True):
                if (file, block) != where:
                    where, due = (file, block), None
                due = at if entry else due
                keep.append(at == due)
                if at == due:
                    due = after
            yield batch.filter(pa.array(keep, pa.bool_()))

    reached = materialize(order.mapInArrow(walk, marked.schema), "warc-records")
    broken = reached.where("not whole")
    out = reached.select("file", "at", "type", "id", "refers", F.col("body").alias("size"), "digest", "told", "payload_length")
    if broken.isEmpty():
        return out
    # payloads with a magic inside: their rows follow each other in the file
    own = broken.select("file", F.col("at").alias("owner"), "head", "body")
    marks = placed.select("file", "at").join(own.select("file").distinct(), "file").join(reached.select("file", "at", F.col("at").alias("own")), ["file", "at"], "left")
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    pieces = marks.select("file", "at", last.alias("owner")).join(own, ["file", "owner"])

    def raw_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rel = None, 0
        for batch in batches:
            places = []
            for raw, file, block in zip(column(batch, "raw"), column(batch, "file").to_pylist(), column(batch, "block").to_pylist(), strict=True):
                where, rel = ((file, block), 0) if (file, block) != where else (where, rel)
                places.append(rel)
                rel += len(raw.as_buffer()) + len(MAGIC)
            yield batch.append_column("rel", pa.array(places, pa.int64()))

    raw = _rows(spark, path).mapInArrow(raw_rows, "raw binary, file string, block long, rel long")
    raw = raw.join(range_bases(found), ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("at"), "raw")
    joined = raw.join(pieces, ["file", "at"]).groupBy("file", "owner", "head", "body").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("rows"))
    content = F.concat_ws(MAGIC, F.transform("rows", lambda r: r.raw.cast("string"))).cast("binary")
    mended = joined.select("file", F.col("owner").alias("at"), base32_sha1(F.substring(content, F.col("head") + 1, F.col("body"))).alias("mended"))
    out = out.join(mended, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "mended"))
    return out.drop("mended")


def page_records(records: DataFrame, id_col: str = "page_id", id_type: str = "long") -> DataFrame:
    """Per page, from :func:`read_warc`: the id, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to`` and ``digest_ok`` (a
    response's block has the digest that its header tells)."""
    revisit = F.col("type") == "revisit"
    return records.select(
        F.col("id").cast(id_type).alias(id_col),
        F.when(revisit, F.col("payload_length")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.col("told")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast(id_type).alias("refers_to"),
        (revisit | (F.col("digest") == F.col("told"))).alias("digest_ok"),
    )
