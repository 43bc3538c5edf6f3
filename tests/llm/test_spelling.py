import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, min_length=7, min_count=2, ratio=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    form, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(others)]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, *out[w], words.get(form[w]))
    return out


def got(df, **how):
    rows = spelling.spelling_groups(df, **how).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus(rng, docs=60):
    bases = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    words = bases * 12
    for w in bases:
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz×") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :], w[:k] + w[k:][::-1]])] * rng.randrange(1, 4)
    return [(rng.choice([d, d, None]), " ".join(rng.choice([w, w.capitalize(), w.upper()]) + rng.choice([",", " 1", "", "\n"]) for w in rng.choices(words, k=60))) for d in range(docs)]


@pytest.mark.parametrize("bound", [spelling.BOUND, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force_whole_and_cut_buckets(spark, bound, seed):
    rows = corpus(random.Random(seed)) + [(None, None), (7, ""), (8, "short a"), (8, "short a")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute(rows)
    assert any(v[0] for v in want.values()) and any(v[3] > 3 for v in want.values())
    assert got(df, bound=bound) == want


def test_chains_ties_and_empty(spark):
    counts = {"aaaaaaa": 2000, "aaaaaab": 200, "aaaaabb": 20, "aaaabbb": 2, "zzzzzzz": 30, "zzzzzzx": 30, "zzzzzz": 5, "zzzzzzzz": 3}
    words = [w for w, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame([(d, " ".join(words)) for d in range(2)], "doc_id long, text string")
    assert got(df) == brute(df.collect())
    assert got(df, min_length=1, min_count=1) == brute(df.collect(), 1, 1)
    assert got(df.limit(0)) == {}


def test_very_long_words(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    words = [base, base[:-1], "x" + base, base[:100] + "z" + base[101:], base[:50] + base[51:], base + "zz", base[::-1]]
    rows = [(d, " ".join(words)) for d in range(3)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_pairs_within_distance_two_share_a_signature():
    rng = random.Random(3)
    part = np.array([rng.randrange(spelling.PARTS) for _ in range(256)])
    part[: spelling.PARTS] = range(spelling.PARTS)
    for _ in range(500):
        a = [rng.randrange(97, 123) for _ in range(rng.randrange(1, 12))]
        b = a[:]
        rng.shuffle(b)
        kind = rng.randrange(3)
        if kind:
            b.append(rng.randrange(97, 123))
        if kind == 2:
            b.pop(0)
        signs = spelling.Words(["".join(map(chr, a)), "".join(map(chr, b))]).signatures(part)
        assert (signs[0] == signs[1]).any()


def test_distance_one_equals_the_definition():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abà") for _ in range(rng.randrange(1, 6))) for _ in range(200)}) + ["a" * 70, "a" * 71, "a" * 69 + "b", "b" + "a" * 69]
    own = spelling.Words(words)
    pairs = [(a, b) for a in range(len(words)) for b in range(len(words)) if a != b and len(words[a]) <= len(words[b])]
    a, b = map(np.array, zip(*pairs, strict=True))
    assert spelling.distance_one(own, a, b).tolist() == [near(words[x], words[y]) for x, y in pairs]
    one, two = spelling.near_pairs(own, np.zeros(len(words), np.int64))
    assert {frozenset(p) for p in zip(one.tolist(), two.tolist(), strict=True)} == {frozenset(p) for p in pairs if near(words[p[0]], words[p[1]])}
