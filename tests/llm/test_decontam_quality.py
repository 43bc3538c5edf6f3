"""Decontamination and quality rules against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import decontam as C
from codestrata.llm import quality as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_of
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(listed), listed))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [13, 4, 1])
def test_decontamination(spark, size):
    rng = np.random.default_rng(size)
    vocab = ["a", "b", "É", "é", "c9", "中", "zz"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(rng.integers(0, 20))) for k in range(12)] + [(90, "B"), (91, "a, A"), (92, ""), (93, None), (None, "zz zz zz"), (5, "a b")]
    docs = [(k, text(rng.integers(0, 200))) for k in range(40)]
    docs += [(100, "x " + items[1][1] + " y"), (101, None), (102, ""), (103, "b"), (103, "b"), (None, "zz ZZ zz zz")]
    d = spark.createDataFrame([(a, t, 1) for a, t in docs], "doc_id long, text string, items int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = C.decontaminate(d, i, window=size).collect()
    assert sorted(map(str, map(tuple, got))) == brute_hits(docs, items, size)
    assert C.decontaminate(d.where("doc_id = -1"), i).count() == 0
    none = C.decontaminate(d, i.where("item_id = -1")).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.n_items for r in none)


def test_no_python_on_the_main_path(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = C.decontaminate(d, i)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def slow_metrics(text):
    raw = (text or "").encode()
    w = raw.split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def prose(rng, lang, n):
    own = {"en": ["the", "of", "and", "house", "water"], "fr": ["le", "de", "été", "à", "forêt"]}[lang]
    rest = {"en": "abcdehilnorst", "fr": "abcdeéèilnorst"}[lang]
    return " ".join(rng.choice(own) if rng.random() < 0.4 else "".join(rng.choice(list(rest), rng.integers(2, 9))) for _ in range(n))


def quality_rows():
    rng = np.random.default_rng(6)
    rows = [(k, prose(rng, lang := ["en", "fr"][k % 2], 60 + k * 5), lang) for k in range(60)]
    junk = " ".join("".join(rng.choice(list("#$%0123456789|<>"), 6)) for _ in range(150))
    loud = " ".join("".join(rng.choice(list("ABCDEFGH"), 6)) for _ in range(150))
    odd = " ".join("".join(rng.choice(list("qxzjkwvy"), 5)) for _ in range(200))
    rows += [(200, junk, "en"), (201, loud, "en"), (202, odd, "fr"), (203, None, "en"), (204, "", None), (205, "a b c " * 40, "en"), (206, prose(rng, "en", 300), None), (206, prose(rng, "en", 300), "xx")]
    rows += [(207, "one\ntwo\none\n \none", "en"), (None, prose(rng, "en", 80), "en"), (208, "x\x1fy z \x85 w", "en"), (209, "a b a b a b a", "en")]
    return rows


def test_quality(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int").repartition(3).cache()
    refs = Q.references(df)
    got = Q.quality(df).collect()
    # references against a plain count
    for lang in ("en", "fr", None):
        own = [t or "" for _, t, x in rows if lang in (None, x)]
        count = Counter(w for t in own for w in t.encode().split())
        classes, place, hist = refs[lang]
        top = sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[: Q.COMMON]
        assert list(place) == [w for w, _ in top] and hist[:-1].tolist() == [n for _, n in top]
        assert hist.sum() == sum(count.values())
        assert np.array_equal(classes, sum(Q.class_histogram(t.encode()) for t in own))

    def verdict(text, lang):
        base = slow_metrics(text)
        classes, place, hist = refs.get(lang, refs[None])
        w = (text or "").encode().split()
        own = np.array([*[w.count(x) for x in place], 0.0])
        own[-1] = len(w) - own.sum()

        def js(p, q):
            p, q = p / p.sum(), q / q.sum()
            kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
            return np.sqrt(max(0, (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2))

        limits = Q.Limits()
        far = len(w) >= limits.class_guard and js(Q.class_histogram((text or "").encode()), classes) > limits.class_distance
        return not base[-1] and not far and not (len(w) >= limits.word_guard and js(own, hist) > limits.word_distance)

    want = sorted(str((d, *slow_metrics(t), verdict(t, lang))) for d, t, lang in rows)
    assert sorted(str(tuple(r)[:8]) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert {200, 201, 202, 203, 204, 205, 207, 209}.isdisjoint(kept) and 40 in kept
    left = Q.quality_filter(df).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str((d, t)) for d, t, lang in rows if verdict(t, lang))
    assert Q.quality(df.where("doc_id = -1")).count() == 0 and Q.quality_filter(df.where("doc_id = -1")).count() == 0


def test_repeat_words_with_many_distinct_words():
    words = [b"w%d" % (k % 1_100_000) for k in range(1_100_010)]
    assert Q.repeat_words(words)[0] == 20


@pytest.mark.parametrize("max_langs", [0, 1])
def test_languages_beyond_those_sent_to_the_tasks_get_the_same_verdicts(spark, max_langs):
    rows = quality_rows()
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, lang string, kept int, row string").repartition(3)
    key = lambda r: str((r[0], *[round(x, 9) if isinstance(x, float) else x for x in r[1:]]))
    want = sorted(key(r) for r in Q.quality(df).collect())
    assert sorted(key(r) for r in Q.quality(df, max_langs=max_langs).collect()) == want
    left = lambda out: sorted(str(tuple(r)) for r in out.collect())
    assert left(Q.quality_filter(df, max_langs=max_langs)) == left(Q.quality_filter(df))
