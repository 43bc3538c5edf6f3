"""Quality rules by distribution divergence (operator 10).

Two passes. The first counts, per language and over all documents, the
character classes and the words; the classes and the commonest words are that
language's references. The second compares each document's two histograms with
its language's references by Jensen-Shannon distance (base 2, 0 to 1) and
rejects documents that lie too far off. Guards: a histogram is compared only
if the document has enough words for it to mean something.

Every language has a reference of its own, kept as a table. What is sent to the
tasks is bounded: the references of the ``MAX_LANGS`` largest languages. The
documents of other languages are joined to theirs, by the same rules and with
the same answers. Documents without a language are held against the reference
pooled over all of them.

Defined results: a null text has no words and fails the base rule; one row per
input row; an empty table gives no rows. Ties among common words go to the
smaller word. Other columns are ignored, or passed on untouched by
:func:`quality_filter`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import chunks, column, materialize
from codestrata.plans.topk import top_k_per_group

COMMON = 50
MAX_LANGS = 512
FLUSH = 400_000
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


#: Class counts; place of each common word; counts of them and of all others.
Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


class Limits(NamedTuple):
    """Base limits are fixed; the distances and guards are the method's."""

    min_words: int = 50
    class_distance: float = 0.30
    class_guard: int = 50
    word_distance: float = 0.38
    word_guard: int = 100


def _byte_classes() -> np.ndarray:
    """Class of each byte; UTF-8 continuation bytes are in the last, dropped one."""
    out = np.full(256, 8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SPACES.encode(), b".,;:!?'\"()-", SYMBOLS.encode())):
        out[list(chars)] = k
    out[[b for b in range(128) if out[b] == 8]] = 6  # other ASCII
    out[0xC2:0xCB] = 7  # accented and extended Latin
    out[0xCB:0xF8] = 9  # other scripts and signs
    out[0x80:0xC0] = 10
    return out


CLASS_OF = _byte_classes()
CLASSES = 11


def class_histogram(raw: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(CLASS_OF, weights=by_byte, minlength=CLASSES)[: CLASSES - 1]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    both = [(x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(both) / 2)))


def repeat_words(words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Words inside three-word windows that occur twice or more; and the number of each word."""
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    counts = dict(zip(place, np.bincount(ids).tolist(), strict=True)) if len(ids) else {}
    if len(ids) < 4:
        return 0, counts
    n = len(place)
    pair = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(key)] |= twice
    return int(covered.sum()), counts


def base_metrics(text: str, words: list[bytes], repeats: int) -> tuple[int, int, int, int, int, bool]:
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, max_langs: int = MAX_LANGS) -> dict[str | None, Reference]:
    """The references of the largest languages and (None) of all pooled."""
    return language_references(df, text_col, lang_col, common, max_langs)[0]


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, max_langs: int = MAX_LANGS) -> tuple[dict[str | None, Reference], DataFrame | None]:
    """By language (None: all pooled): class counts, place of each common word,
    and the counts of the common words with that of all others at the end; and
    a table ``(lang, ref)`` of the languages beyond the ``max_langs`` largest."""
    slim = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}
        docs: Counter = Counter()

        def flush(all_of: bool) -> pa.RecordBatch:
            rows = [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            if all_of:
                rows += [(lang, "c", b"%02d" % k, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
                rows += [(lang, "d", b"", n) for lang, n in docs.items()]
            a = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.string()), pa.array(a[2], pa.binary()), pa.array(a[3], pa.int64())], ["lang", "kind", "item", "n"])

        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for first, texts in chunks(column(batch, "text").to_pylist()):
                for lang, text in zip(langs[first : first + len(texts)], texts, strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    words.setdefault(lang, Counter()).update(raw.split())
                    classes[lang] = classes.get(lang, 0) + class_histogram(raw)
                    docs[lang] += 1
                if sum(map(len, words.values())) > FLUSH:
                    yield flush(False)
        yield flush(True)

    parts = slim.mapInArrow(run, "lang string, kind string, item binary, n long")
    counts = parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # the commonest words of each language, of all of them pooled, and the sums: a bounded table
    counts = materialize(counts, "language-counts")
    sizes = counts.where("kind = 'd' and lang is not null")
    largest = [r.lang for r in sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    pooled = counts.where("kind != 'd'").groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "item", "n")
    both = counts.where("kind != 'd' and lang is not null").unionByName(pooled)
    top = top_k_per_group(both.where("kind = 'w'"), ["lang"], [F.desc("n"), F.asc("item")], common, salt_cols=["item"]).select("lang", "kind", "item", "n")
    sums = both.where("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("t").alias("kind"), F.lit(b"").alias("item"), "n")
    rows = materialize(top.unionByName(sums).unionByName(both.where("kind = 'c'")), "language-references")
    entries = rows.groupBy("lang").agg(F.collect_list(F.struct("kind", "item", "n")).alias("ref"))  # common + 12 entries at most
    known = F.col("lang").isNull() | F.col("lang").isin(largest)
    found = {r.lang: reference([e.asDict() for e in r.ref]) for r in entries.where(known).collect()}
    return found, None if sizes.count() <= max_langs else entries.where(~known)


def reference(entries: list[dict]) -> Reference:
    classes = np.zeros(CLASSES - 1)
    for e in entries:
        if e["kind"] == "c":
            classes[int(bytes(e["item"]))] = e["n"]
    ranked = sorted((-e["n"], bytes(e["item"])) for e in entries if e["kind"] == "w")
    total = sum(e["n"] for e in entries if e["kind"] == "t")
    hist = np.array([-n for n, _ in ranked] + [total + sum(n for n, _ in ranked)], float)
    return classes, {w: k for k, (_, w) in enumerate(ranked)}, hist


def with_references(df: DataFrame, lang_col: str, refs: dict[str | None, Reference], rest: DataFrame | None) -> DataFrame:
    """``(row, lang, ref)``: rows as structs, so that no column of theirs clashes;
    ref is null where the tasks have the language's reference."""
    rows = df.select(F.struct("*").alias("row"), F.col(lang_col).cast("string").alias("lang"))
    none = F.lit(None).cast("array<struct<kind:string,item:binary,n:bigint>>").alias("ref")
    if rest is None:
        return rows.select("row", "lang", none)
    known = F.col("lang").isNull() | F.col("lang").isin([x for x in refs if x is not None])
    return rows.where(known).select("row", "lang", none).union(rows.where(~known).join(rest, "lang").select("row", "lang", "ref"))


def references_of(batch: pa.RecordBatch, refs: dict[str | None, Reference]) -> Iterator[Reference | None]:
    for lang, entries in zip(column(batch, "lang").to_pylist(), column(batch, "ref").to_pylist(), strict=True):
        yield refs.get(lang, refs.get(None)) if entries is None else reference(entries)


def judge(text: str, ref, limits: Limits):
    """Base metrics, both distances (None where the guard forbids) and the verdict."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeats, counts = repeat_words(words)
    base = base_metrics(text, words, repeats)
    by_class = by_word = None
    if ref is not None:
        classes, place, hist = ref
        if len(words) >= max(1, limits.class_guard) and classes.sum():
            by_class = distance(class_histogram(raw), classes)
        if len(words) >= max(1, limits.word_guard) and hist.sum():
            own = np.zeros(len(hist))
            for w, k in place.items():
                own[k] = counts.get(w, 0)
            own[-1] = len(words) - own.sum()
            by_word = distance(own, hist)
    kept = not base[-1] and (by_class is None or by_class <= limits.class_distance) and (by_word is None or by_word <= limits.word_distance)
    return *base, by_class, by_word, kept


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), max_langs: int = MAX_LANGS) -> DataFrame:
    """One row per row: the id, base metrics, ``base_failed``, ``kept`` and the
    two distances."""
    refs, rest = language_references(df, text_col, lang_col, max_langs=max_langs)
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, _ = column(batch, "row").flatten()
            rows = [judge(t.as_py(), ref, limits) for t, ref in zip(texts, references_of(batch, refs), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", *names])

    out = with_references(slim, "lang", refs, rest).mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")
    return out.withColumnRenamed("id", id_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), max_langs: int = MAX_LANGS) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns."""
    refs, rest = language_references(df, text_col, lang_col, max_langs=max_langs)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = column(batch, "row")
            keep = [judge(t.as_py() or "", ref, limits)[-1] for t, ref in zip(row.flatten()[at], references_of(batch, refs), strict=True)]
            yield pa.RecordBatch.from_arrays(row.filter(pa.array(keep, pa.bool_())).flatten(), [f.name for f in row.type])

    return with_references(df, lang_col, refs, rest).mapInArrow(run, df.schema)
