"""Spelling variant grouping (operator 12) by PartEnum signatures.

Words are maximal letter runs of Latin-1, ASCII capitals lowered. Two words at
edit distance one have letter multisets that differ in at most two places
(a replaced letter takes one out and puts one in). As a binary vector (one
dimension for each letter and occurrence) they lie within Hamming distance
two: if the dimensions are dealt into ``PARTS`` = 5 parts, at least 3 of them
agree wholly, so the words share one of the 10 signatures "these 3 parts hold
exactly these letters". Letters are dealt by how many words hold them, so that
no signature rests on rare letters alone.

Words with an equal signature are joined and verified. Inside a bucket a pair
at distance one shares the first or the last half of its shorter word, so only
such pairs are looked at. A bucket of over ``bound`` words is cut before it is
gathered: its words are dealt again by (signature, word without one letter),
which words at distance one share and few others do: at most the words that one
more letter can make of it. So no group grows with the corpus and no pair is
lost.

Defined results: a null text has no runs, a null id is an empty string in the
hash below; repeated rows count as often as they stand; an empty table gives no
rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import column, materialize, ragged
from codestrata.llm.components import whole_groups

PARTS, KEPT = 5, 3
BOUND = 4_096
#: Code points up to here are compared as padded rows, longer words one by one.
WIDTH = 64
#: Pairs that are verified at once.
STEP = 1_000_000
#: Fixed: a run's form is changed when this divides its hash.
CHANGED = 31
RUN = "[A-Za-zÀ-ÿ]+"

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 2**64)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(df: DataFrame, id_col: str, text_col: str, min_length: int) -> Column:
    """The words of a row, as an array: a run loses the letter at its hash if
    ``CHANGED`` divides that (crc32 of ``<id>:<run>``)."""
    runs = F.filter(F.regexp_extract_all(F.translate(F.col(text_col), _CAPITALS, _SMALL), F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= min_length)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def changed(run: Column) -> Column:
        h = F.crc32(F.encode(F.concat(name, F.lit(":"), run), "utf-8"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % CHANGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return F.filter(F.transform(runs, changed), lambda w: F.length(w) >= min_length)


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``(word, n)`` of the words with enough letters and occurrences."""
    words = df.select(F.explode(letter_runs(df, id_col, text_col, min_length)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_parts(words: DataFrame, parts: int = PARTS) -> np.ndarray:
    """The part of each of the 256 letters. Reads one count for each letter."""
    held = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).groupBy("c").count().collect()
    order = sorted((-r["count"], ord(r["c"])) for r in held if r["c"])
    out = np.arange(256) % parts
    for k, (_, c) in enumerate(order):  # there and back, so that every part has a common letter
        out[c] = k % parts if k // parts % 2 == 0 else parts - 1 - k % parts
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of Latin-1 letters as one array of bytes, with hashes of their parts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array(list(map(len, words)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        most = int(self.size.max(initial=0))
        power = np.full(most + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        back = np.full(most + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        place = np.arange(len(self.flat)) - np.repeat(self.start, self.size)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * self.power[place], dtype=np.uint64)])

    def first(self, n: np.ndarray) -> np.ndarray:
        """Hash of the first ``n`` letters of each word."""
        return self.sums[self.start + n] - self.sums[self.start]

    def last(self, n: np.ndarray) -> np.ndarray:
        """Hash of the last ``n`` letters of each word."""
        return (self.sums[self.start + self.size] - self.sums[self.start + self.size - n]) * self.back[self.size - n]

    def without_one(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each word itself and without each of its letters."""
        which = np.repeat(np.arange(len(self.words)), self.size)
        at = ragged(np.zeros(len(self.words), np.int64), self.size)
        here = self.start[which] + at
        head = self.sums[here] - self.sums[self.start[which]]
        tail = (self.sums[self.start[which] + self.size[which]] - self.sums[here + 1]) * np.uint64(_INVERSE)
        whole = self.first(self.size)
        return np.concatenate([np.arange(len(self.words)), which]), np.concatenate([whole, head + tail])

    def signatures(self, part: np.ndarray, kept: int = KEPT) -> np.ndarray:
        """(words, signatures): for every choice of ``kept`` parts a hash of the
        letters that a word holds of them."""
        parts = int(part.max()) + 1
        letter = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        value, of = letter[self.flat], part[self.flat]
        # a sum over letters: the multiset's hash, whatever their order
        held = np.empty((len(self.words), parts), np.uint64)
        for p in range(parts):
            total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(of == p, value, np.uint64(0)), dtype=np.uint64)])
            held[:, p] = total[self.start + self.size] - total[self.start]
        out = []
        for k, chosen in enumerate(itertools.combinations(range(parts), kept)):
            key = np.full(len(self.words), k + 1, np.uint64)
            for p in chosen:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + held[:, p])
            out.append(key)
        return np.stack(out, axis=1).view(np.int64)


def distance_one(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words ``a`` and ``b`` (no longer one first) differ by one edit."""
    out = np.zeros(len(a), bool)
    size_a, size_b = words.size[a], words.size[b]
    short = np.flatnonzero((size_b <= WIDTH) & (size_b - size_a <= 1))
    if len(short):
        x, y, n = a[short], b[short], size_a[short]
        place = np.arange(int(n.max()))
        inside = place < n[:, None]
        top = len(words.flat) - 1
        get = lambda at: words.flat[np.clip(at, 0, top)]
        front = inside & (get(words.start[x, None] + place) == get(words.start[y, None] + place))
        rear = inside & (get((words.start + words.size)[x, None] - 1 - place) == get((words.start + words.size)[y, None] - 1 - place))
        agree = np.logical_and.accumulate(front, axis=1).sum(axis=1) + np.logical_and.accumulate(rear, axis=1).sum(axis=1)
        # one place differs: what agrees at both ends leaves one letter of the longer word at most
        equal = size_a[short] == size_b[short]
        out[short] = np.where(equal, agree == n - 1, agree >= n)
    for k in np.flatnonzero(size_b > WIDTH):
        x, y = words.words[a[k]], words.words[b[k]]
        low, high = 0, len(x)
        while low < high:  # longest common prefix by halving
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
        out[k] = x != y and len(y) - len(x) <= 1 and x[low + (len(x) == len(y)) :] == y[low + 1 :]
    return out


def near_pairs(words: Words, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at distance one of words in the same bucket, each pair once or
    more. They share the first half of the shorter word or the rest of it."""
    one, two = [], []
    size = words.size
    keys, roles, owners = [], [], []
    for less in (0, 1):  # as the shorter or equal word, and as the longer one
        n = size - less
        who = np.flatnonzero(n > 0)
        half = np.maximum(n, 0) // 2
        for side, part in ((1, words.first(half)), (2, words.last(np.maximum(n, 0) - half))):
            key = mixed(mixed(part + np.uint64(side)) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + bucket.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            keys.append(key[who])
            roles.append(np.full(len(who), less, np.int8))
            owners.append(who)
    key, role, owner = map(np.concatenate, (keys, roles, owners))
    order = np.lexsort((role, key))
    key, role, owner = key[order], role[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.repeat(np.append(edge[1:], len(key)), np.diff(np.append(edge, len(key))))
    # each shorter-or-equal row meets every row after it in its group
    lead = np.flatnonzero((role == 0) & (end - np.arange(len(key)) > 1))
    count = end[lead] - lead - 1
    total = np.cumsum(count)
    first = 0
    while first < len(lead):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + STEP, side="right")))
        left = np.repeat(lead[first:last], count[first:last])
        right = ragged(lead[first:last] + 1, count[first:last])
        a, b = owner[left], owner[right]
        same = (bucket[a] == bucket[b]) & (size[b] - size[a] == role[right])
        a, b = a[same], b[same]
        good = distance_one(words, a, b)
        one.append(a[good])
        two.append(b[good])
        first = last
    return (np.concatenate(one), np.concatenate(two)) if one else (np.empty(0, np.int64),) * 2


def signature_rows(words: DataFrame, part: np.ndarray) -> DataFrame:
    """``(g, word, n)``: a row for each signature of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = Words(column(batch, "word").to_pylist()).signatures(part)
            at = pa.array(np.repeat(np.arange(batch.num_rows), signs.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(signs.ravel()), column(batch, "word").take(at), column(batch, "n").take(at)], ["g", "word", "n"])

    return words.mapInArrow(run, "g long, word string, n long")


def cut_rows(rows: DataFrame) -> DataFrame:
    """Rows of large buckets, dealt again by (signature, word without a letter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, left = Words(column(batch, "word").to_pylist()).without_one()
            g = mixed(column(batch, "g").to_numpy().view(np.uint64)[which] * np.uint64(0x9E3779B97F4A7C15) + mixed(left)).view(np.int64)
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(g), column(batch, "word").take(at), column(batch, "n").take(at)], ["g", "word", "n"])

    return rows.mapInArrow(run, "g long, word string, n long").distinct()


def near_words(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """``(a, na, b, nb)``: every pair of words at distance one, once."""
    part = letter_parts(words)
    rows = signature_rows(words, part)
    # written first: its size on disk decides whether the joins broadcast it
    large = materialize(rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > bound).select("g"), "spelling-large")
    dealt = rows.join(large, "g", "left_anti").union(cut_rows(rows.join(large, "g", "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "g"):
            long = np.diff(cuts) > 1
            if not long.any():
                continue
            table = table.filter(pa.array(np.repeat(long, np.diff(cuts)))).combine_chunks()
            own = Words(table.column("word").to_pylist())
            a, b = near_pairs(own, table.column("g").to_numpy())
            if not len(a):
                continue
            low = np.array([x <= y for x, y in zip(map(own.words.__getitem__, a.tolist()), map(own.words.__getitem__, b.tolist()), strict=True)])
            a, b = pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a))
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            found = pa.table([word.take(a), n.take(a), word.take(b), n.take(b)], ["a", "na", "b", "nb"])
            yield from found.group_by(["a", "na", "b", "nb"]).aggregate([]).to_batches()

    grouped = dealt.repartition("g").sortWithinPartitions("g")
    return grouped.mapInArrow(run, "a string, na long, b string, nb long").distinct()


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, ratio: int = 10, bound: int = BOUND) -> DataFrame:
    """One row a word: ``word, form, root, n, n_near, form_n``. A word's form is
    its near word with the largest count (then the smallest word), if that is
    at least ``ratio`` times its own; root is where following forms ends."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word: ratio is 2 or more")
    words = materialize(word_counts(df, id_col, text_col, min_length, min_count), "spelling-words")
    pairs = materialize(near_words(words, bound), "spelling-pairs")
    both = pairs.union(pairs.select("b", "nb", "a", "na"))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    good = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(formed.select("word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "spelling-forms")
    # each link multiplies the count, so a chain has under 64 links at ratio 2: six doublings
    ends = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ends = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
