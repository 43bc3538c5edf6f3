"""Language-model scores by a causal self-attention model (operator 8).

What the scores rest on is counted over all training documents, and the model
itself is trained by the tasks in parallel:

1. One pass cuts the texts into blocks of bounded size; a block keeps its
   documents as places in its own list of distinct words, and that list.
2. Word counts come from the blocks' lists, each distinct word is turned into
   subword ids once, and the lists get counts and ids by a join on the word.
3. Subword counts, and the counts of a subword after a class inside words,
   follow from the word counts: a bounded table each. Classes hold about equal
   parts of all subwords; word-initial and other subwords have classes of
   their own, so that a class tells where words begin.
4. Tasks train copies of the attention model on the training documents; their
   weights are averaged, in integers so that the order of addition does not
   matter, and trained once more. The documents are dealt over these rounds by
   a hash, so that each is learned from once, by all of its runs of ``RUN``
   words.
5. Each block meets its list and is scored: p(subword) is the model's p(class)
   from overlapping windows times p(subword | class, class before). A word is
   spelled by its subwords, up to a subword that begins another, or copied from
   the text before it, or taken as a whole from the training tokens: p(word) is
   the weighted sum of its spelling, its share of the text's words so far and its
   share of the training tokens. The spelling weighs as much as words are new
   (the part of the training tokens that occur once), but no less than a quarter,
   since it knows what came before. So words that recur, in the
   corpus or the text, are likelier than their spelling.

Defined results: a null text is empty and has one token, the end; every row is
scored, repeated rows too; a null id counts as the empty text for the split;
with no training documents all counts are zero; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import attention
from codestrata.llm.common import chunks, column, materialize, ragged
from codestrata.llm.encoding import byte_ids

#: Characters of the texts of a block (one longer text is a block of its own),
#: and of those that are cut into words together.
BLOCK = 17_000_000
PIECE = 1_000_000
#: Rounds of training; each has one in so many training documents, and others than the rounds before.
SHARE = 2
#: Words of a run (a sequence of its own).
RUN = 64
#: Characters of the texts that are learned from together.
LESSON = 125_000
#: Weight of a word's share of the text so far, and bounds of its spelling's.
COPIED = 0.15
SPELLED = 0.25, 0.5
#: Vocabulary of the subword model, its end symbol included.
IDS = 50_257
END = IDS - 1
START_CLASSES = 31
END_CLASS = attention.CLASSES - 1
#: 1 for classes whose subwords begin a word, the end among them.
BEGINS = ((np.arange(attention.CLASSES) < START_CLASSES) | (np.arange(attention.CLASSES) == END_CLASS)).astype(np.float32)
#: Weight of the plain class distribution against that after a class.
KAPPA = 5.0
#: Subwords that are scored together.
STEP = 150_000
SCALE = 1 << 30


class Model(NamedTuple):
    """``classes``: class of each id; ``inside``: ln p(id | its class, class before)."""

    classes: np.ndarray
    inside: np.ndarray
    weights: attention.Weights


def blocks(df: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """Rows of two kinds: documents ``(block, id, held, words)``, words being
    places in the block's list (see :func:`packed`), and the list ``(block, at,
    word, n)`` with the word's number in the block's training documents."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held"))
    names = ["block", "id", "held", "words", "at", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, held = column(batch, "id"), column(batch, "held")
            for first, texts in chunks(column(batch, "text").to_pylist(), BLOCK):
                sizes, parts = [], []
                for _, piece in chunks(texts, PIECE):
                    cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in piece]
                    sizes += map(len, cut)
                    parts.append(pa.array([w for words in cut for w in words], pa.binary()))
                    del cut
                coded = pa.chunked_array(parts, pa.binary()).combine_chunks().dictionary_encode()
                at, words = coded.indices.to_numpy(), coded.dictionary
                # frequent words first: their places are small numbers
                order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                at, words, size = place[at], words.take(pa.array(order)), np.array(sizes, np.int64)
                del coded, parts
                train = np.repeat(~held.slice(first, len(texts)).to_numpy(zero_copy_only=False), size)
                n = np.bincount(at[train], minlength=len(words))
                ends = np.cumsum(size).tolist()
                own = [packed(at[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                none = lambda kind, k: pa.nulls(k, kind)
                k, m = len(texts), len(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), ids.slice(first, k), held.slice(first, k), pa.array(own, pa.binary()), none(pa.int32(), k), none(pa.binary(), k), none(pa.int64(), k)], names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), none(ids.type, m), none(pa.bool_(), m), none(pa.binary(), m), pa.array(np.arange(m, dtype=np.int32)), words, pa.array(n.astype(np.int64))], names)
                block += 1

    return slim.mapInArrow(run, f"block long, id {slim.schema['id'].dataType.simpleString()}, held boolean, words binary, at int, word binary, n long")


def packed(at: np.ndarray) -> bytes:
    """32-bit numbers as their low halves, then their high halves: the latter
    are mostly zero and vanish when compressed."""
    return (at & 0xFFFF).astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, "<u2").astype(np.int32)
    n = len(halves) // 2
    return halves[:n] | halves[n:] << 16


def vocabulary(lists: DataFrame, tokenizer: str) -> DataFrame:
    """``(word, c, ids)``: every distinct word, its training count, its subword ids (16 bits)."""
    counts = lists.groupBy("word").agg(F.sum("n").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_ids(tokenizer).engine.encode_ordinary
        for batch in batches:
            ids = [np.array(encode(" " + w.decode("utf-8", "replace")), "<u2").tobytes() for w in column(batch, "word").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "c"), pa.array(ids, pa.binary())], ["word", "c", "ids"])

    return counts.mapInArrow(run, "word binary, c long, ids binary")


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, their numbers, the words' counts)."""
    raw = column(batch, "ids")
    size = np.asarray(pc.binary_length(raw)).astype(np.int64) // 2
    return np.frombuffer(b"".join(raw.to_pylist()), "<u2").astype(np.int64), size, column(batch, "c").to_numpy()


def _summed(words: DataFrame, count) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of what ``count(ids, sizes, counts)`` gives in each task; the
    keys are bounded, so the table is small enough for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = count(*_ids_of(batch))
            keys, where = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["key", "n"])

    out = words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return out.column("key").to_numpy(), out.column("n").to_numpy()


@functools.lru_cache(maxsize=1)
def initial(tokenizer: str) -> np.ndarray:
    """True for ids that begin with a space, so begin a word."""
    engine = byte_ids(tokenizer).engine
    return np.array([k < END and engine.decode_single_token_bytes(k)[:1] == b" " for k in range(IDS)])


def equal_classes(counts: np.ndarray, first: int, number: int, members: np.ndarray) -> np.ndarray:
    """Class of each member: about equal parts of all counts, frequent ids first."""
    n = counts[members] + 1.0
    order = np.argsort(-n, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    out = np.empty(len(members), np.int64)
    out[order] = first + np.minimum(number - 1, (before / n.sum() * number).astype(np.int64))
    return out


def fit_counts(words: DataFrame, tokenizer: str) -> Model:
    """Classes, in-class probabilities and first weights, from counts alone."""
    counts = np.zeros(IDS)
    keys, n = _summed(words, lambda ids, size, c: (ids, np.repeat(c, size)))
    counts[keys] = n
    begins = initial(tokenizer)
    classes = np.empty(IDS, np.int64)
    for flag, first, number in ((True, 0, START_CLASSES), (False, START_CLASSES, END_CLASS - START_CLASSES)):
        members = np.flatnonzero((begins == flag) & (np.arange(IDS) != END))
        classes[members] = equal_classes(counts, first, number, members)
    classes[END] = END_CLASS

    def pairs(ids, size, c):
        """Subword after class inside words; IDS stands for the word's end."""
        after = np.append(ids[1:], IDS)
        after[np.cumsum(size)[size > 0] - 1] = IDS
        return classes[ids] * (IDS + 1) + after, np.repeat(c, size)

    keys, n = _summed(words, pairs)
    follow = np.zeros((attention.CLASSES + 1, IDS + 1))
    follow[keys // (IDS + 1), keys % (IDS + 1)] = n
    plain = counts + 1.0
    plain[END] = 1
    plain /= np.bincount(classes, weights=plain, minlength=attention.CLASSES)[classes]
    inside = np.empty((attention.CLASSES + 1, IDS), np.float32)
    moves = np.zeros((attention.CLASSES + 1, attention.CLASSES))
    heads = np.bincount(classes[begins], weights=counts[begins], minlength=attention.CLASSES) + 1e-3
    heads /= heads.sum()
    for before in range(attention.CLASSES + 1):
        own = np.where(begins, 0, follow[before, :IDS])
        total = np.bincount(classes, weights=own, minlength=attention.CLASSES)
        inside[before] = np.log((own + KAPPA * plain) / (total[classes] + KAPPA))
        moves[before] = total + (follow[before, IDS] + (before == attention.CLASSES)) * heads
    weights = attention.fresh()
    weights["direct"] = np.log((moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(classes, inside, weights)


def text_words(texts: list[str]) -> list[list[bytes]]:
    """Each text's words and its end, a blank."""
    return [[*t.encode("utf-8", "surrogatepass").lower().split(), b" "] for t in texts]


def word_runs(texts: list[list[bytes]], every: int) -> list[list[bytes]]:
    """One run of words in ``every`` of each text, and one at least; which of
    them goes round with the texts."""
    out = []
    for k, words in enumerate(texts):
        number = -(-len(words) // RUN)
        out += [words[n * RUN : n * RUN + RUN] for n in range(k % min(number, every), number, every)]
    return out


def subwords(runs: list[list[bytes]], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of runs of words laid end to end, and how many each run has;
    a distinct word is turned into ids once."""
    encode = byte_ids(tokenizer).engine.encode_ordinary
    coded = pa.array([w for words in runs for w in words], pa.binary()).dictionary_encode()
    own = [[END] if w == b" " else encode(" " + w.decode("utf-8", "replace")) for w in coded.dictionary.to_pylist()]
    length = np.fromiter(map(len, own), np.int64, len(own))
    pool = np.array([k for ids in own for k in ids], np.int32)
    at, count = coded.indices.to_numpy(), np.fromiter(map(len, runs), np.int64, len(runs))
    return pool[ragged((np.cumsum(length) - length)[at], length[at])], np.add.reduceat(length[at], np.cumsum(count) - count)


def lesson(texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """What the model learns from texts: the subword ids of all their runs laid
    end to end, and how many each run has."""
    return subwords(word_runs(text_words(texts), 1), tokenizer)


def train(df: DataFrame, model: Model, tokenizer: str, text_col: str) -> Model:
    """Average of the weights that the tasks trained on the training texts ``df``."""
    size = len(attention.flat(model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, seen = None, 0
        for batch in batches:
            for _, texts in chunks(column(batch, "text").to_pylist(), LESSON):
                ids, sizes = lesson(texts, tokenizer)
                adam = attention.train(model.weights, ids, model.classes.astype(np.int16)[ids], sizes, adam)
                seen += len(ids)
        if seen:
            values = np.rint(attention.flat(adam.w).astype(np.float64) * SCALE).astype(np.int64) // 1000
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(values), pa.array(np.full(size, seen))], ["at", "value", "weight"])

    made = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "at long, value long, weight long")
    weighted = (F.col("value") * F.col("weight").cast("decimal(20,0)")).cast("decimal(38,0)")
    mean = made.groupBy("at").agg((F.sum(weighted) / F.sum("weight")).cast("double").alias("v")).toArrow()  # as many rows as the model has weights
    if not mean.num_rows:
        return model
    values = np.zeros(size)
    values[mean.column("at").to_numpy()] = mean.column("v").to_numpy() * 1000 / SCALE
    return model._replace(weights=attention.unflat(values))


def spelled_words(model: Model, ids: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """ln p of spelling every word of sequences laid end to end, ends included:
    ``sizes`` subwords a sequence, ``length`` subwords a word. A word's spelling
    ends with a subword that begins another word; which one is the next word's part."""
    classes = model.classes.astype(np.int16)[ids]
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts] = attention.CLASSES
    said, begin = attention.score(model.weights, ids, classes, sizes, BEGINS)
    said = said.astype(np.float64) + model.inside[before, ids]
    heads = np.cumsum(length) - length
    out = np.add.reduceat(said, heads) - begin[heads]
    over = begin[np.append(heads[1:], 0)].astype(np.float64)
    over[np.searchsorted(heads, starts[1:]) - 1] = over[-1] = 0  # nothing follows a text's end
    return out + over


def recurring(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For every word of texts laid end to end (``count`` words each) the share
    that it has of its text's words before it; zero for a text's first."""
    text = np.repeat(np.arange(len(count)), count)
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    place = np.arange(len(words))
    before = np.empty(len(words), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(head, place, 0))
    return before / np.maximum(1, place - np.repeat(np.cumsum(count) - count, count))


def lm_scores(df: DataFrame, tokenizer: str, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known`` (tokens that training has), ``train_tokens``, ``base_score``
    (add-one unigram) and ``score`` (the model), both log10 of the text. ``held_out`` is a
    boolean column: true rows are scored, but not learned from."""
    held = F.coalesce(held_out, F.lit(False))
    table = materialize(blocks(df, id_col, text_col, held), "lm-blocks")
    lists, docs = table.where("word is not null").select("block", "at", "word", "n"), table.where("words is not null").select("block", "id", "held", "words")
    words = materialize(vocabulary(lists, tokenizer), "lm-words")
    ends = docs.where("not held").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, kinds = sums.n + ends, sums.v + (ends > 0)
    spelled = min(SPELLED[1], max(SPELLED[0], sums.once / total)) if total else 1 - COPIED
    rest = max(0.0, 1 - COPIED - spelled)

    model = fit_counts(words, tokenizer)
    for part in range(SHARE):
        own = F.pmod(F.xxhash64(F.lit("train"), id_col, text_col), F.lit(SHARE)) == part
        model = train(df.where(~held & own), model, tokenizer, text_col)
    end, floor = np.log10(ends + 1.0), np.log10(float(total + kinds + 1))
    kind = df.schema[id_col].dataType.simpleString()

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("at").to_numpy())
        c = own.column("c").to_numpy()[order]
        log_c, known = np.log10(c + 1.0), c > 0
        spell, whole = np.log(spelled), np.append(c, ends) * (rest / max(1, total))
        raw = own.column("ids").combine_chunks().take(pa.array(order))
        length = np.asarray(pc.binary_length(raw)).astype(np.int64) // 2
        pool = np.append(np.frombuffer(b"".join(raw.to_pylist()), "<u2"), END).astype(np.int32)
        # one more word: the end
        length = np.append(length, 1)
        start = np.cumsum(length) - length
        rows: list[tuple[int, int, float, float]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            at = np.concatenate(held)
            each = np.array([length[x].sum() for x in held])
            ids = pool[ragged(start[at], length[at])]
            count = np.array([len(x) for x in held])
            with np.errstate(divide="ignore"):
                ready = np.log(whole[at] + COPIED * recurring(at, count))
            words = np.logaddexp(spell + spelled_words(model, ids, each, length[at]), ready)
            found = np.add.reduceat(words, np.cumsum(count) - count) / np.log(10)
            for x, s in zip(held, found.tolist(), strict=True):
                n = len(x)
                rows.append((n, int(known[x[:-1]].sum()) + (ends > 0), float(log_c[x[:-1]].sum() + end - n * floor), s))
            held.clear()

        size = 0
        for words in texts.column("words"):
            held.append(np.append(unpacked(words.as_buffer()), np.int32(len(length) - 1)))
            size += 3 * len(held[-1])
            if size > STEP:
                flush()
                size = 0
        if held:
            flush()
        n, k, base, score = zip(*rows, strict=True)
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    named = lists.join(words, "word").select(F.col("block").alias("own"), "at", "c", "ids")
    scored = docs.groupBy("block").cogroup(named.groupBy("own")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
