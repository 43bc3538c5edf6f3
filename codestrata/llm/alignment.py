"""Cross-tokenizer alignment (operator 13) by external spill counting.

A text is encoded by two tokenizers, A over byte-level BPE and B over pieces.
Both sides cover the same bytes, so the offsets where a token of each ends cut
a text into groups, and the two tokens ending there are linked.

1. Each task gathers the links of its documents into runs of ``RUN_LINKS``:
   records (pair, document, times) sorted by B id, A id and document, and cut by
   a radix of the B id into ``BUCKETS`` zstd blobs. Their heads hold (pair,
   times) alone. Documents and runs go into one table in the shared folder.
2. Heads of a bucket are merged by a heap over their streams, ``FAN`` at a time
   and in as many passes as that takes. The last pass has every pair's count
   in side-major order, in which the largest count of a B id is known as soon
   as the next B id comes.
3. Runs are streamed again: a run's records take their pairs' counts and are
   added up by document, so one or two sums a document are shuffled.

A linked pair's shorter token is a suffix of its longer one, so the number of
pairs is bounded by the vocabularies alone (``pair_bound``), whatever the
corpus; this is what lets every task of step 3 have all counts. A frequent pair
is one head entry a run, and its records are spread over all runs.

Defined results: null and empty texts, and texts whose tokens do not give back
a space and the text, have no tokens: zeros and an empty digest. Each row is a
document of its own, repeated rows and null ids included; an empty table gives
no rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import chunks, column, materialize, ragged
from codestrata.llm.encoding import ByteIds
from codestrata.llm.token_counts import byte_alphabet, parts

RUN_LINKS = 2_000_000
BUCKETS = 64
FAN = 128
#: Entries of a run that a merge holds at once.
BLOCK = 4_096
LEVEL = 3
MARK = "▁"
#: Row ids: a task's number and the row's number in it.
SPAN = 1 << 33

_HEAD = np.dtype([("pair", "<u8"), ("n", "<u8")])


class PlainByteIds(ByteIds):
    """Byte-level BPE to which special strings inside texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = []

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found


class Side:
    """Byte strings of a vocabulary as one array."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.size[ids])]


class Pair:
    """Both tokenizers, their bytes and the written forms of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.engine = PlainByteIds(path_a)
        alphabet = byte_alphabet()
        vocab = self.engine.library.get_vocab(with_added_tokens=False)
        raw = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            raw[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a = Side(raw)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(names)])
        #: No piece goes on over the start of a word, so long texts can be cut there.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in names)
        self.wide = max(len(raw) - 1, 1).bit_length()
        self.slots = -(-len(names) // BUCKETS)
        na, nb = len(raw), len(names)
        self.codes = [*(b"%d," % k for k in range(na)), *(b"%d|" % k for k in range(na)), *(b"%d," % k for k in range(nb)), *(b"%d;" % k for k in range(nb))]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        whole = []
        for k, text in enumerate(texts):
            if self.cuts and len(text) > 1_000_000:  # the model puts the space before each part back
                out[k] = [i for part in parts(" " + text) for i in self.pieces.encode(part[1:])]
            else:
                whole.append(k)
        for k, ids in zip(whole, self.pieces.encode([texts[k] for k in whole], num_threads=1), strict=True):
            out[k] = ids
        return out

    def radix(self, b: np.ndarray) -> np.ndarray:
        """B ids in bucket order: the low digit first, then the rest."""
        return (b % BUCKETS) * self.slots + b // BUCKETS

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.radix(b) << self.wide) | a

    def ids_of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = key >> self.wide
        return key & ((1 << self.wide) - 1), side % self.slots * BUCKETS + side // self.slots

    def pair_bound(self) -> int:
        """Pairs of which one is a suffix of the other, from above."""
        same: dict[bytes, int] = {}
        for t in self.b.tokens:
            same[t] = same.get(t, 0) + 1
        return int(self.b.size.sum() + self.a.size.sum() * max(same.values()))


@functools.lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Aligned:
    """Tokens, groups and links of a list of texts. ``a``, ``b``: ids of one text
    after another; ``link_a``, ``link_b``: places in them of the linked tokens."""

    def __init__(self, both: Pair, texts: list[str]):
        self.both = both
        engine = both.engine
        a = [engine.ids(" " + t) if t else np.empty(0, np.uint32) for t in texts]
        b = [np.array(x, np.int64) for x in both.ids_b(texts)]
        good = self._same(texts, a, b)
        empty = np.empty(0, np.int64)
        a = [x if ok else empty for x, ok in zip(a, good, strict=True)]
        b = [x if ok else empty for x, ok in zip(b, good, strict=True)]
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        self.a, self.b = (np.concatenate([*x, empty]).astype(np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(both.a.size[self.a]), np.cumsum(both.b.size[self.b])
        at = np.searchsorted(end_b, end_a)
        self.link_a = np.flatnonzero(end_b[at] == end_a) if len(end_a) else empty
        self.link_b = at[self.link_a]
        self.doc = np.repeat(np.arange(len(texts)), self.n_a)[self.link_a]
        self.n_links = np.bincount(self.doc, minlength=len(texts))

    def _same(self, texts: list[str], a: list[np.ndarray], b: list[np.ndarray]) -> list[bool]:
        """Whether the tokens of both sides give back a space and the text."""
        good = []
        for text, x, y in zip(texts, a, b, strict=True):
            said = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)
            good.append(bool(text) and all(np.array_equal(side.joined(np.asarray(ids, np.int64)), said) for side, ids in ((self.both.a, x), (self.both.b, y))))
        return good

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        na, nb = len(self.both.a.tokens), len(self.both.b.tokens)
        code_a, code_b = self.a.copy(), self.b + 2 * na
        code_a[self.link_a] += na
        code_b[self.link_b] += nb
        # a group's A tokens, then its B tokens
        size_a, size_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        before_b, until_a = self.link_b + 1 - size_b, self.link_a + 1
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + np.repeat(before_b, size_a)] = code_a
        codes[np.arange(len(code_b)) + np.repeat(until_a, size_b)] = code_b
        said = list(map(self.both.codes.__getitem__, codes.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(said[first:last])[:-1] for first, last in zip([0, *ends[:-1]], ends, strict=True)]


def run_blobs(links: list[np.ndarray], docs: list[np.ndarray], bits: int, both: Pair) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, head, body) of a run with its pair keys and document numbers."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    coded = np.concatenate(links).astype(np.uint64) << np.uint64(bits) | np.concatenate(docs).astype(np.uint64)
    record, times = np.unique(coded, return_counts=True)
    key, doc = record >> np.uint64(bits), (record & np.uint64((1 << bits) - 1)).astype("<u4")
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    head = np.empty(len(edge), _HEAD)
    head["pair"], head["n"] = key[edge], np.add.reduceat(times, edge)
    size = np.diff(np.append(edge, len(key))).astype("<u4")
    bucket = (head["pair"] >> np.uint64(both.wide)) // np.uint64(both.slots)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    ends = np.append(edge, len(key))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = slice(int(ends[x]), int(ends[y]))
        yield int(bucket[x]), pack(head[x:y].tobytes()), pack(b"".join((size[x:y].tobytes(), doc[own].tobytes(), times[own].astype("<u4").tobytes())))


def unpack(raw: bytes) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)) as reader:
        return reader.read()


class _Stream:
    """A run's head, a block at a time."""

    def __init__(self, raw: bytes, block: int):
        self.reader, self.want = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)), block * _HEAD.itemsize
        self.held = np.empty(0, _HEAD)
        self.fill()

    def fill(self) -> bool:
        raw = bytearray()
        while len(raw) < self.want and (more := self.reader.read(self.want - len(raw))):
            raw += more
        self.held = np.frombuffer(bytes(raw), _HEAD)
        return bool(len(self.held))


def merged(heads: Iterable[bytes], block: int = BLOCK) -> Iterator[np.ndarray]:
    """Sorted streams merged: blocks of distinct pairs in order, counts added.
    The heap knows whose block ends first; up to that end all is at hand."""
    runs = [s for s in (_Stream(raw, block) for raw in heads) if len(s.held)]
    heap = [(int(s.held["pair"][-1]), k) for k, s in enumerate(runs)]
    heapq.heapify(heap)
    live = set(range(len(runs)))
    while heap:
        end = heap[0][0]
        taken = []
        for k in live:
            cut = int(np.searchsorted(runs[k].held["pair"], np.uint64(end), side="right"))
            if cut:
                taken.append(runs[k].held[:cut])
                runs[k].held = runs[k].held[cut:]
        while heap and heap[0][0] == end:
            _, k = heapq.heappop(heap)
            if runs[k].fill():
                heapq.heappush(heap, (int(runs[k].held["pair"][-1]), k))
            else:
                live.discard(k)
        every = np.concatenate(taken)
        order = np.argsort(every["pair"], kind="stable")
        every = every[order]
        edge = np.flatnonzero(np.concatenate([[True], every["pair"][1:] != every["pair"][:-1]]))
        out = np.empty(len(edge), _HEAD)
        out["pair"], out["n"] = every["pair"][edge], np.add.reduceat(every["n"], edge)
        yield out


def side_maxima(blocks: Iterable[np.ndarray], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, whether an entry has its B id's largest count), as B ids end."""
    held = np.empty(0, _HEAD)
    for block in _ended(blocks):
        if block is not None:
            held = np.concatenate([held, block])
        side = held["pair"] >> np.uint64(wide)
        cut = len(held) if block is None else int(np.searchsorted(side, side[-1])) if len(side) else 0
        if cut:
            out, side = held[:cut], side[:cut]
            edge = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            most = np.repeat(np.maximum.reduceat(out["n"], edge), np.diff(np.append(edge, cut)))
            yield out, out["n"] == most
            held = held[cut:]


def _ended(blocks: Iterable[np.ndarray]) -> Iterator[np.ndarray | None]:
    yield from blocks
    yield None


def encoded_runs(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, run_links: int, with_groups: bool) -> DataFrame:
    """One table of documents (``bucket`` null) and of runs' blobs."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = ["row", "n_a", "n_b", "n_links"]
    names = ["id", *counted, "sha", "groups", "bucket", "run", "docs", "head", "body"]
    types = [None, *[pa.int64()] * 4, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    bits = 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        row = base = TaskContext.get().partitionId() * SPAN  # the next row, and the first one of the run
        links: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0
        kind = pa.int64()

        def table(**cols: list) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t or kind) if c in cols else pa.nulls(n, t or kind) for c, t in zip(names, types, strict=True)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal links, docs, held, base
            if held:
                bucket, head, body = zip(*run_blobs(links, docs, bits, both), strict=True)
                yield table(bucket=list(bucket), run=[base] * len(bucket), docs=[row - base] * len(bucket), head=list(head), body=list(body))
            links, docs, held, base = [], [], 0, row

        for batch in batches:
            kind = column(batch, "id").type
            for first, texts in chunks(column(batch, "text").to_pylist()):
                if row - base + len(texts) >= 1 << bits:
                    yield from flush()
                own = Aligned(both, texts)
                n = len(texts)
                said = own.groups()
                cols = {"sha": [hashlib.sha256(x).hexdigest() if x else "" for x in said]}
                if with_groups:
                    cols["groups"] = [x.decode() for x in said]
                yield table(id=column(batch, "id").slice(first, n), row=pa.array(np.arange(row, row + n)), n_a=pa.array(own.n_a), n_b=pa.array(own.n_b), n_links=pa.array(own.n_links), **cols)
                links.append(both.key(own.a[own.link_a], own.b[own.link_b]))
                docs.append(own.doc + (row - base))
                row, held = row + n, held + len(own.doc)
                if held >= run_links:
                    yield from flush()
        yield from flush()

    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, n_a long, n_b long, n_links long, sha string, groups string, bucket int, run long, docs long, head binary, body binary"
    return materialize(slim.mapInArrow(run, schema), "alignment")


def pair_counts(runs: DataFrame, path_a: str, path_b: str, fan: int = FAN) -> DataFrame:
    """``(pair, n, best)`` from the heads of :func:`encoded_runs`."""
    heads = runs.where("bucket is not null").select("bucket", "run", "head")
    n_runs = heads.select("run").distinct().count()

    def grouped(df: DataFrame, groups: int) -> DataFrame:
        dealt = df.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
        return dealt.repartition("bucket", "grp").sortWithinPartitions("bucket", "grp")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
        last, held = None, []
        for batch in batches:
            for *key, head in zip(*(column(batch, c).to_pylist() for c in ("bucket", "grp", "head")), strict=True):
                if key != last:
                    if held:
                        yield tuple(last), held
                    last, held = key, []
                held.append(head)
        if held:
            yield tuple(last), held

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, grp), held in whole(batches):
            pack = zstandard.ZstdCompressor(level=LEVEL).compressobj()
            raw = b"".join([*(pack.compress(x.tobytes()) for x in merged(held)), pack.flush()])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([grp], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "run", "head"])

    while n_runs > fan:  # passes of the merge, each leaves one run of about ``fan``
        n_runs = -(-n_runs // fan)
        heads = materialize(grouped(heads, n_runs).mapInArrow(shorten, "bucket int, run long, head binary"), "alignment-pass")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = pair(path_a, path_b).wide
        for _, held in whole(batches):
            for entries, best in side_maxima(merged(held), wide):
                yield pa.RecordBatch.from_arrays([pa.array(entries["pair"].astype(np.int64)), pa.array(entries["n"].astype(np.int64)), pa.array(best)], ["pair", "n", "best"])

    return materialize(grouped(heads, 1).mapInArrow(finish, "pair long, n long, best boolean"), "alignment-counts")


def contributions(runs: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(row, n_best, count_sum)`` of every document with links."""
    limit = pair(path_a, path_b).pair_bound()
    if counts.count() > limit:
        raise RuntimeError("more pairs than the vocabularies allow")
    table = counts.orderBy("pair").toArrow()  # at most ``limit`` rows, whatever the corpus
    pairs, n, best = table.column("pair").to_numpy().astype(np.uint64), table.column("n").to_numpy(), table.column("best").to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sums = None, np.empty((0, 2), np.int64)

        def flush() -> pa.RecordBatch:
            own = np.flatnonzero(sums[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(own + (base or 0)), pa.array(sums[own, 0]), pa.array(sums[own, 1])], ["row", "n_best", "count_sum"])

        for batch in batches:
            for start, docs, head, body in zip(*(column(batch, c).to_pylist() for c in ("run", "docs", "head", "body")), strict=True):
                if start != base:
                    yield flush()
                    base, sums = start, np.zeros((docs, 2), np.int64)
                own = np.frombuffer(unpack(head), _HEAD)
                at = np.searchsorted(pairs, own["pair"])
                raw = np.frombuffer(unpack(body), "<u4")
                size, (doc, times) = raw[: len(own)], raw[len(own) :].reshape(2, -1)
                times = times.astype(np.int64)
                np.add.at(sums[:, 0], doc, times * np.repeat(best[at], size))
                np.add.at(sums[:, 1], doc, times * np.repeat(n[at], size))
        yield flush()

    found = runs.where("bucket is not null").select("run", "docs", "head", "body").mapInArrow(run, "row long, n_best long, count_sum long")
    return found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokens(df: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", run_links: int = RUN_LINKS, fan: int = FAN, with_groups: bool = False) -> DataFrame:
    """One row per row of ``df``: the id, ``n_a``, ``n_b`` tokens, ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair is the commonest of its B id),
    ``count_sum`` (of the links' corpus-wide counts), ``groups_sha256`` and,
    with ``with_groups``, ``groups`` (``a1,a2|b1;a3|b2,b3``)."""
    runs = encoded_runs(df, tokenizer_a, tokenizer_b, id_col, text_col, run_links, with_groups)
    sums = contributions(runs, pair_counts(runs, tokenizer_a, tokenizer_b, fan), tokenizer_a, tokenizer_b)
    found = runs.where("bucket is null").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = found.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), F.col("sha").alias("groups_sha256"), *(["groups"] if with_groups else []))
    return out
