"""Token ids of whole texts, equal to those of the tokenizers library."""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex

from codestrata.llm.common import ragged
from codestrata.llm.token_counts import LETTER, NUMBER, PLAIN, byte_alphabet, parts

#: Distinct words that a task's pool holds at most before it begins anew.
CACHE = 700_000
#: Plain characters whose small letters are plain, too.
LOWERED = regex.compile("[" + "".join(f"\\U{ord(c):08X}" for c in map(chr, range(0x2100)) if PLAIN.fullmatch(c) and PLAIN.fullmatch(c.lower())) + "]*+")


class ByteIds:
    """Byte-level BPE. Ordinary texts go through the byte-pair engine over the
    same vocabulary, which is faster; texts with special strings or unusual
    characters through the tokenizers library itself."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.engine = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or not PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        found = [np.asarray(self.engine.encode_to_numpy(part, disallowed_special=()), np.uint32) for part in parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


class WordIds:
    """BPE over lower-cased words: each distinct word is encoded once by the
    library and its ids are kept in a bounded pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the model's own pattern, its classes spelled out for plain characters
        self.pattern = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.start = self.length = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        coded = self.library.encode(" ".join(words), add_special_tokens=False)
        owner = np.array(coded.word_ids, np.int64)
        if len(owner) and owner[-1] + 1 == len(words):
            ids, length = np.array(coded.ids, np.uint32), np.bincount(owner, minlength=len(words))
        else:  # some word was cut in two: one by one
            each = [x.ids for x in self.library.encode_batch(words, add_special_tokens=False)]
            ids, length = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        begin = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, ids])
        self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, length])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [[] if "<|" in t or not LOWERED.fullmatch(t) else self.pattern.findall(t.lower()) for t in texts]
        coded = pa.array(itertools.chain.from_iterable(cut), pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > CACHE:
            self._forget()
            new = words
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        length = self.length[at]
        flat = self.pool[ragged(self.start[at], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(list(map(len, cut)), dtype=np.int64)]
        out, first = [], 0
        for text, words, end in zip(texts, cut, ends.tolist(), strict=True):
            # no plain words: an empty text, or one for the library
            out.append(flat[first:end] if words else np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
            first = end
        return out


@functools.lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
