"""Token counts by rank-synchronous array merging (operator 1).

Texts are cut into pre-tokens; the distinct unseen pre-tokens of a chunk of
texts are held as one ragged array of byte symbols, and in every round each
sequence merges its own lowest-rank pair, all sequences at once. What is left
of a sequence when it has no mergeable pair are its tokens; only their number
is kept.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every input
row gives one row, repeated rows and null ids included; the special string is
one token wherever it stands in a text; an empty table gives no rows. Columns
other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import chunks, column, ragged

#: Characters whose letter, number and space classes are the same in every
#: Unicode version and regex library; other texts are cut by the tokenizer's
#: own pre-tokenizer.
PLAIN_SET = r"\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u0220\u2010-\u2015\u2018-\u201E\u2020-\u2022\u2026\u20AC"
PLAIN = regex.compile(f"[{PLAIN_SET}]*+")


def plain_class(kind: str) -> str:
    """The plain characters of a Unicode category (L or N), for a regex class."""
    plain = [c for c in map(chr, range(0x2100)) if re.fullmatch(f"[{PLAIN_SET}]", c) and unicodedata.category(c)[0] == kind]
    runs = [plain[k] for k in range(len(plain)) if not k or ord(plain[k]) != ord(plain[k - 1]) + 1]
    ends = [plain[k] for k in range(len(plain)) if k + 1 == len(plain) or ord(plain[k + 1]) != ord(plain[k]) + 1]
    return "".join(f"{a}-{b}" for a, b in zip(runs, ends, strict=True))


LETTER, NUMBER = plain_class("L"), plain_class("N")
#: Between two non-spaces, one space always begins a new pre-token.
CUT = regex.compile(r"(?<=[^\s]) (?=[^\s])")
CACHE = 400_000
PIECE = 1_000_000
EMPTY = np.uint32(0xFFFFFFFF)
NO_RANK = np.int32(0x7FFFFFFF)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for the code points from 256 on, in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ArrayMerger:
    """Merge tables of a byte-level BPE as arrays, and the batched merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], bits: int = 19):
        alphabet = byte_alphabet()
        self.of_byte = np.zeros(256, np.uint32)
        for ch, b in alphabet.items():
            self.of_byte[b] = vocab[ch]
        left = np.array([vocab[a] for a, _ in merges], np.uint32)
        right = np.array([vocab[b] for _, b in merges], np.uint32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.uint32)
        keys = (left << np.uint32(16)) | right
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.uint32)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing, one step for all keys still without a slot
            free = self.keys[slot[todo]] == EMPTY
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at], self.ranks[at] = keys[won], won.astype(np.int32)
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint32(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, NO_RANK for pairs that never merge."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NO_RANK)
        todo = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint32(1)) & self.mask
            there = self.keys[slot[todo]]
            found = there == keys[todo]
            out[todo[found]] = self.ranks[slot[todo[found]]]
            todo = todo[~found & (there != EMPTY)]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each byte string."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        which = np.flatnonzero(lengths > 1)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        sym = self.of_byte[data[ragged(starts[which], lengths[which])]]
        length = lengths[which]
        rank = self._pairs(sym, length)
        while len(which):
            start = np.cumsum(length) - length
            low = np.minimum.reduceat(rank, start)
            done = low == NO_RANK
            if done.any():
                out[which[done]] = length[done]
                keep = np.repeat(~done, length)
                sym, rank = sym[keep], rank[keep]
                which, length, low = which[~done], length[~done], low[~done]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), length)
            hit = rank == low[owner]
            # of a run of overlapping hits (one symbol repeated) every second one merges
            at = np.flatnonzero(hit)
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.result[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            length = length - np.bincount(owner[at], minlength=len(which))
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            before = np.flatnonzero(gone[:-1]) - 1  # what stands before a merged pair that follows another
            touched[before[before >= 0]] = True
            keep = ~gone
            sym, rank, touched = sym[keep], rank[keep], touched[keep]
            # a pair's left symbol may be a merged one two places before
            touched[:-1] |= touched[1:]
            rank[touched] = self._pairs(sym, length)[touched] if touched.mean() > 0.5 else self._some(sym, length, np.flatnonzero(touched))
        return out

    def _pairs(self, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rank of (symbol, next symbol) in its sequence; NO_RANK at the end."""
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank((sym[:-1] << np.uint32(16)) | sym[1:])
        rank[np.cumsum(length) - 1] = NO_RANK
        return rank

    def _some(self, sym: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        last = np.zeros(len(sym), bool)
        last[np.cumsum(length) - 1] = True
        out = np.full(len(at), NO_RANK, np.int32)
        inner = ~last[at]
        k = at[inner]
        out[inner] = self.rank((sym[k] << np.uint32(16)) | sym[k + 1])
        return out


class PreTokens:
    """Cuts texts into the byte strings that the model merges one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the model's own pattern, its classes spelled out for plain characters
        self.pattern = re.compile(rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
        self.alphabet = byte_alphabet()

    def split(self, text: str) -> list[str | bytes]:
        """Pre-tokens, as str or (of texts with unusual characters) as bytes."""
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        alphabet = self.alphabet
        return [bytes(alphabet[c] for c in token) for token, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


def parts(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of a long text, cut only where a pre-token ends in any case."""
    at = 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = ArrayMerger(model["vocab"], merges)
        self.pre = PreTokens(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str | bytes, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list]] = []
        size = 0
        for k, text in enumerate(texts):
            pieces = [text]
            if self.cut is not None and self.cut.search(text):
                pieces = self.cut.split(text)
                out[k] += len(pieces) - 1
            for piece in pieces:
                for part in parts(piece):
                    held.append((k, self.pre.split(part)))
                    size += len(part)
                    if size > 4 * PIECE:
                        self._flush(held, out)
                        held, size = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, list]], out: list[int]) -> None:
        seen: set = set()
        for _, tokens in held:
            seen.update(tokens)
        if len(self.known) + len(seen) > CACHE:
            self.known.clear()
        new = [t for t in seen if t not in self.known]
        if new:
            self.known.update(zip(new, self.merger.counts([t.encode() if isinstance(t, str) else t for t in new]).tolist(), strict=True))
        get = self.known.__getitem__
        for k, tokens in held:
            out[k] += sum(map(get, tokens))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``df``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens). ``tokenizer`` is the path of a
    byte-level BPE file on every worker. No shuffle."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = counter(tokenizer)
        for batch in batches:
            counts: list[int] = []
            for _, texts in chunks(column(batch, "text").to_pylist()):
                counts += engine.count(texts)
            size = pc.binary_length(column(batch, "text").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), size.cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
