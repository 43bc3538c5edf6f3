"""Chat formatting (operator 11): conversations rendered through a compiled
template (:mod:`codestrata.llm.templates`) into training texts with loss spans.

An ordinary conversation is one row. One of over ``PIECE_CHARS`` characters or
``PIECE_TURNS`` turns is dealt over many tasks by ranges of its turns: the
ranges are numbered by their counts alone, and each renders its turns as the
loop's messages from that number on, so the pieces join to the text that one
task would give. Only the SHA-256 of a long conversation is taken in order, row
after row, by one task that holds one piece at a time.

Defined results: a null text or role is empty; rows of one conversation come by
turn (nulls first), then role, then the text's hash; repeated rows are turns of
their own; rows without a conversation id are one conversation; an empty table
gives no rows. Only the four named columns are read, so others cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import column, materialize
from codestrata.llm.templates import Template, unescape_control, unescape_line

PIECE_CHARS = 262_144
PIECE_TURNS = 1_000

#: Turns between markers, of which assistants' texts are learned.
MARKED = r"""
{%- for message in messages -%}
  {{ '<|im_start|>' + message.role | line + '\n' }}
  {%- if message.role == 'assistant' -%}
    {%- generation -%} {{- message.text | control -}} {%- endgeneration -%}
  {%- else -%}
    {{- message.text | control -}}
  {%- endif -%}
  {{- '<|im_end|>\n' -}}
{%- endfor -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


@functools.lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    return Template(source)


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.xxhash64(text).alias("h"), text.alias("text"))


def _long_pieces(rows: DataFrame, chars: int, turns: int) -> DataFrame:
    """Turns of long conversations with their piece: ``id, piece, pieces, first,
    total, at, role, text``."""
    order = ["id", "turn", "role", "h", "tie"]  # the tie splits repeated rows, too
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, False
        chunk = at = size = 0
        for batch in batches:
            chunks, places = [], []
            for name, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                if not seen or name != last:
                    seen, last, chunk, at, size = True, name, 0, 0, 0
                elif size >= chars or at >= turns:
                    chunk, at, size = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(at)
                at, size = at + 1, size + len(text)
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array([part] * n, pa.int32()), pa.array(chunks, pa.int32()), pa.array(places, pa.int32()), column(batch, "role"), column(batch, "text")],
                ["id", "part", "chunk", "at", "role", "text"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    numbered = materialize(ranged.select("id", "role", "text").mapInArrow(number, f"id {kind}, part int, chunk int, at int, role string, text string"), "chat-turns")
    own = Window.partitionBy("id").orderBy("part", "chunk")
    every = Window.partitionBy("id")
    sizes = numbered.groupBy("id", "part", "chunk").agg(F.count("*").alias("n"))  # one row a piece
    placed = sizes.select(
        F.col("id").alias("own_id"),
        F.col("part").alias("own_part"),
        F.col("chunk").alias("own_chunk"),
        (F.row_number().over(own) - 1).cast("long").alias("piece"),
        F.count("*").over(every).alias("pieces"),
        F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(every).alias("total"),
    )
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("part") == F.col("own_part")) & (F.col("chunk") == F.col("own_chunk"))
    return numbered.join(placed, same).select("id", "piece", "pieces", "first", "total", "at", "role", "text")


def format_conversations(
    df: DataFrame,
    template: str = MARKED,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece_chars: int = PIECE_CHARS,
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """``(<id>, piece, pieces, formatted, loss)``: the texts, and the spans of
    code points (start, end) in them that are learned."""
    Template(template)  # its errors belong to the caller
    rows = _turns(df, id_col, turn_col, role_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    # written first: its size on disk decides whether the joins broadcast it
    long = materialize(sizes.where((F.col("n") > piece_turns) | (F.col("size") > piece_chars)).select(F.col("id").alias("long_id")), "chat-long")
    of_long = F.col("id").eqNullSafe(F.col("long_id"))
    order = ["turn", "role", "h", "text"]
    whole = F.lit(None).cast("long")
    short = rows.join(long, of_long, "left_anti").repartition("id").sortWithinPartitions("id", *order)
    short = short.select("id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), F.lit(0).cast("long").alias("first"), whole.alias("total"), "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = compiled(template)
        out: list[list] = [[], [], [], [], []]
        held: list[dict] = []
        head: tuple | None = None

        def close() -> None:
            made = engine.render(held, head[3], head[4])
            for col, value in zip(out, (head[0], head[1], head[2], made.text, [{"start": a, "end": b} for a, b in made.spans]), strict=True):
                col.append(value)

        def flush() -> pa.RecordBatch:
            nonlocal out
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            out = [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "pieces", "formatted", "loss"])

        types = None
        size = 0
        for batch in batches:
            types = [column(batch, "id").type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            for *key, role, text in zip(*(column(batch, c).to_pylist() for c in ("id", "piece", "pieces", "first", "total", "role", "text")), strict=True):
                if head is None or key[:2] != list(head[:2]):
                    if head is not None:
                        close()
                    head, held = tuple(key), []
                    if size > piece_chars * 4:
                        size = 0
                        yield flush()
                held.append({"role": role, "text": text})
                size += len(text)
        if head is not None:
            close()
            yield flush()

    schema = f"`{id_col}` {kind}, piece long, pieces long, formatted string, loss array<struct<start:int,end:int>>"
    pieces = _long_pieces(rows.join(long, of_long, "left_semi"), piece_chars, piece_turns)
    pieces = pieces.repartition("id", "piece").sortWithinPartitions("id", "piece", "at").drop("at")
    return short.mapInArrow(render, schema).unionByName(pieces.mapInArrow(render, schema))


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text in the default template."""
    found, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        found.append((unescape_line(m[1]), unescape_control(m[2])))
        end = m.end()
    if end != len(formatted):
        raise ValueError(f"no turn at {end}")
    return found


def _read(formatted: str, loss: list[dict]) -> tuple[int, bytes, list[str], int]:
    turns = turns_of(formatted)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    return len(turns), said.encode("utf-8", "surrogatepass"), [unescape_control(formatted[x["start"] : x["end"]]) for x in loss], len(formatted)


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read from its texts in the default template: the id,
    ``n_turns``, ``turns_sha256`` (role, line end, text, line end a turn),
    ``loss_chars`` and ``loss_sha256`` (the learned texts, joined) and
    ``formatted_chars``."""
    kind = formatted.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    slim = formatted.select(F.col(id_col).alias("id"), "piece", "pieces", "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one conversation come one after another, by piece."""
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        last, turns, chars, learned, text, masked, open_ = None, 0, 0, 0, None, None, False
        for batch in batches:
            types = [column(batch, "id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out: list[list] = [[] for _ in names]
            for name, piece, pieces, formatted, loss in zip(*(column(batch, c).to_pylist() for c in ("id", "piece", "pieces", "formatted", "loss")), strict=True):
                if piece == 0:
                    last, turns, chars, learned, text, masked, open_ = name, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
                if not open_ or name != last:
                    raise ValueError(f"conversation {name} has no first piece")
                n, said, own, size = _read(formatted, loss)
                text.update(said)
                for x in own:
                    masked.update(x.encode("utf-8", "surrogatepass"))
                turns, chars, learned = turns + n, chars + size, learned + sum(map(len, own))
                if piece == pieces - 1:
                    open_ = False
                    for col, value in zip(out, (name, turns, text.hexdigest(), learned, masked.hexdigest(), chars), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    one = slim.where("pieces = 1").mapInArrow(run, schema)
    many = slim.where("pieces > 1").repartition("id").sortWithinPartitions("id", "piece").mapInArrow(run, schema)
    return one.unionByName(many)
