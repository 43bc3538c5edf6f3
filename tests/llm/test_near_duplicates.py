"""SimHash components, links in buckets and line de-duplication against brute force."""

import random

import numpy as np
import pytest
import xxhash

from codestrata.llm import line_dedup as L
from codestrata.llm import simhash as S
from codestrata.llm.components import connected_components


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_covering_masks_meet_every_pair_in_the_radius():
    masks = [m & (2**64 - 1) for m in S.masks(3)]
    assert len(masks) == 15
    for a in range(64):
        for b in range(a, 64):
            for c in range(b, 64):
                assert any(not m >> a & 1 and not m >> b & 1 and not m >> c & 1 for m in masks)


def test_fingerprint_with_blocks(monkeypatch):
    text = "Ab c  D é e\x0bf\x85g h i j k l " * 20
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint(None) == S.fingerprint(" \n\t") == 0
    assert S.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def near_rows():
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 300))]
        for _ in range(rnd.randint(1, 8)):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    return [*rows, (900, None), (901, ""), (902, "  "), (903, "x"), (903, "x"), (None, "x")]


@pytest.mark.parametrize("bound", [S.BOUND, 2])
def test_near_duplicates(spark, bound):
    rows = near_rows()
    df = spark.createDataFrame([(d, t, "f") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = S.near_duplicates(df, bound=bound).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    sets = Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[sets.find(k)] = min(least.get(sets.find(k), d), d)
    want = [(d, f"{prints[k]:016x}", least.get(sets.find(k))) for k, (d, _) in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({w[2] for w in want}) < len(rows) - 20
    assert S.near_duplicates(df.where("doc_id = -1")).count() == 0


def test_forest_connects_what_is_connected():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 5, dtype=np.uint64)
    values = np.unique(np.concatenate([base[k % 5 : k % 5 + 1] ^ (np.uint64(1) << rnd.integers(0, 64, 1, dtype=np.uint64)) for k in range(200)]))
    sets, want = Sets(len(values)), Sets(len(values))
    place = {int(v): k for k, v in enumerate(values)}
    for a, b in S.forest(values, 3):
        assert (a ^ b).bit_count() <= 3
        sets.join(place[a], place[b])
    for a in range(len(values)):
        for b in range(a):
            if int(values[a] ^ values[b]).bit_count() <= 3:
                want.join(a, b)
    same = lambda s: {frozenset(k for k in range(len(values)) if s.find(k) == r) for r in {s.find(k) for k in range(len(values))}}
    assert same(sets) == same(want)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(100, 101), (101, 100), (None, 3)], [(k, (k * 7) % 60) for k in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    sets = Sets(200)
    for a, b in edges:
        if a is not None and b is not None:
            sets.join(a, b)
    assert got == {n: min(m for m in nodes if sets.find(m) == sets.find(n)) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(4)
    for _ in range(2000):
        a = [rnd.choice("abé ") for _ in range(rnd.randint(0, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            if rnd.random() < 0.5:
                b.insert(rnd.randint(0, len(b)), rnd.choice("abc"))
            elif b:
                b.pop(rnd.randrange(len(b)))
        a, b, most = "".join(a), "".join(b), rnd.randint(0, 8)
        want, got = levenshtein(a, b), L.edit_distance(a, b, most)
        assert got == want if want <= most else got > most


def line_rows():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            own = rnd.choice(base).split()
            if rnd.random() < 0.5:
                own[rnd.randrange(len(own))] = rnd.choice(words)
            lines.append(rnd.choice(["", " ", "  "]) + "  ".join(own).upper() if rnd.random() < 0.2 else " ".join(own))
        rows.append((k * 2, "\n".join(lines)))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (503, "one two\nOne  two\nfour"), (503, "one two\nOne  two\nfour"), (None, "four\nnew line")]


@pytest.mark.parametrize("bound", [L.BOUND, 2])
def test_line_dedup(spark, bound):
    rows = line_rows()
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = L.dedup_lines(df, bound=bound, dropped="gone").collect()
    keys, places = {}, []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").encode().split(b"\n")):
            if words := L.line_words(line):
                places.append((d, n, keys.setdefault(b" ".join(words), len(keys))))
    lines = list(keys)
    blocks = L.simhash_blocks([x.split(b" ") for x in lines])
    sets = Sets(len(lines))
    for a in range(len(lines)):
        for b in range(a):
            if (blocks[a] == blocks[b]).any() and levenshtein(x := lines[a].decode(), y := lines[b].decode()) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                sets.join(a, b)
    first, gone = {}, {}
    for d, n, k in places:
        if first.setdefault(sets.find(k), (d, n)) != (d, n):
            gone.setdefault(d, set()).add(n)
    assert len({sets.find(k) for k in range(len(lines))}) < len(lines)
    texts = dict(rows)
    for r in got:
        assert set(r.gone) == gone.get(r.doc_id, set())
        text = texts[r.doc_id]
        assert r.text == (text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(r.gone)))
    assert len(got) == len(rows) and sorted(r.k for r in got) == list(range(len(rows)))
    assert L.dedup_lines(df.where("doc_id = -1")).count() == 0


def test_line_of_many_steps(monkeypatch):
    lines = [[b"w%d" % (k * 7 % 400) for k in range(n)] for n in (3, 900, 1, 50, 0, 2)]
    lines = [x or [b"y"] for x in lines]
    whole = L.simhash_blocks(lines)
    monkeypatch.setattr(L, "STEP", 64)
    assert (L.simhash_blocks(lines) == whole).all()


@pytest.mark.parametrize("words,changed", [(10, 1), (20, 4), (27, 5), (55, 5), (55, 11)])
def test_line_recall_against_edit_similarity_alone(words, changed):
    """Of pairs at similarity 0.8 or more, by whatever hash, nearly all are candidates."""
    rnd = random.Random(words)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    left, right = [], []
    while len(left) < 300:
        a = [word() for _ in range(words)]
        b = list(a)
        for k in rnd.sample(range(words), changed):
            b[k] = word()
        x, y = " ".join(a), " ".join(b)
        if levenshtein(x, y) <= int(0.2 * len(max(x, y, key=len)) + 1e-9):
            left.append([w.encode() for w in a])
            right.append([w.encode() for w in b])
    assert (L.simhash_blocks(left) == L.simhash_blocks(right)).any(axis=1).mean() > 0.95


def test_line_dedup_finds_pairs_at_the_threshold(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        own = [word() for _ in range(27)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:11], *(word() for _ in range(5)), *own[16:]]))]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), dropped="gone").where("size(gone) > 0").collect()
    assert len(got) >= 37 and all(r.doc_id % 2 for r in got)


def test_edit_distances_of_many_pairs():
    from codestrata.llm.edit_batch import within

    rnd = random.Random(11)
    pairs, most = [], []
    for _ in range(900):
        a = "".join(rnd.choice("abcdé") for _ in range(rnd.choice([0, 1, 3, 20, 63, 64, 65, 128, 130, 200])))
        b = list(a)
        for _ in range(rnd.randrange(max(2, len(a) // 3))):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(2)] = rnd.choice(["", "z", "ab", "\U0001f600"])
        other = "".join(b) if rnd.random() < 0.9 else "".join(rnd.choice("abc") for _ in range(rnd.randrange(200)))
        pairs.append((a, other))
        most.append(int(0.2 * max(len(a), len(other))) if rnd.random() < 0.7 else rnd.randrange(200))
    assert within(pairs, most).tolist() == [levenshtein(a, b) <= m for (a, b), m in zip(pairs, most, strict=True)]
    assert within([], []).tolist() == []


def test_forests_side_by_side_equal_one_by_one():
    rnd = random.Random(12)
    buckets = []
    for _ in range(30):
        base = ["".join(rnd.choice("abcde ") for _ in range(60)) for _ in range(3)]
        buckets.append([x[:k] + rnd.choice("xyz") * rnd.randrange(9) + x[k:] for x in base for k in (5, 20, 40)])
    for bucket, links in zip(buckets, L.forests(buckets, 0.8), strict=True):
        sets, want = Sets(len(bucket)), Sets(len(bucket))
        for a, b in links:
            assert L.similar(bucket[a], bucket[b], 0.8)
            sets.join(a, b)
        for a in range(len(bucket)):
            for b in range(a):
                if L.similar(bucket[a], bucket[b], 0.8):
                    want.join(a, b)
        assert [[sets.find(a) == sets.find(b) for b in range(len(bucket))] for a in range(len(bucket))] == [[want.find(a) == want.find(b) for b in range(len(bucket))] for a in range(len(bucket))]


def test_a_pair_of_many_buckets_is_verified_once(monkeypatch):
    """And of a bucket no pair that something connects already; few rounds ask for many pairs."""
    rnd = random.Random(13)
    line = lambda: "".join(rnd.choice("abcde ") for _ in range(60))
    near = [x[:k] + "xy" + x[k:] for x in [line()] for k in range(5, 50, 3)]
    far = [line() for _ in range(24)]
    asked, real = [], L.within
    monkeypatch.setattr(L, "within", lambda pairs, most: asked.append(pairs) or real(pairs, most))
    buckets = [rnd.sample(near, 8) + rnd.sample(far, 12) for _ in range(9)] + [near, far]
    links = L.forests(buckets, 0.8)
    pairs = [frozenset(p) for round_ in asked for p in round_]
    assert len(pairs) == len(set(pairs)) and len(asked) < 10
    made = [(b[x], b[y]) for b, own in zip(buckets, links, strict=True) for x, y in own]
    assert len(made) == len(near) - 1 and {x for p in made for x in p} == set(near)


def test_letters_alone_rule_out_only_what_is_too_far():
    from codestrata.llm import edit_batch

    rnd = random.Random(14)
    pairs = [tuple("".join(rnd.choice(k) for _ in range(rnd.randrange(1, 40))) for k in (rnd.choice(["ab", "bc\u0163", "cd\U0001f600"]), rnd.choice(["ab", "bc"]))) for _ in range(1500)]
    most = [rnd.randrange(20) for _ in pairs]
    kept = set(edit_batch._open(pairs, most))
    assert 100 < len(kept) < 1400
    assert all(levenshtein(a, b) > m for k, ((a, b), m) in enumerate(zip(pairs, most, strict=True)) if k not in kept)


def test_a_bucket_of_near_copies_costs_one_comparison_a_line(monkeypatch):
    """Even with a line among them that is like none."""
    near = [f"{'abcde ' * 10}{k:04d}" for k in range(3000)]
    held, real = [0], L.plain_verdict
    monkeypatch.setattr(L, "plain_verdict", lambda *a: held.__setitem__(0, held[0] + 1) or real(*a))
    links = L.forest([*near, "x" * 60], 0.8)
    assert len(links) == len(near) - 1 and held[0] < 2.1 * len(near)
    monkeypatch.setattr(L, "TOGETHER", 3)
    assert sorted(L.forest(near[:50], 0.8)) == [(0, k) for k in range(1, 50)]


def test_aligned_words_bound_the_distance_from_above():
    rnd = random.Random(15)
    words = ["a", "bcd", "efghij", "klm", "nopqrstu", "v"]
    found = 0
    for _ in range(1500):
        left = [rnd.choice(words) for _ in range(rnd.randrange(1, 14))]
        right = list(left)
        for _ in range(rnd.randrange(6)):
            k = rnd.randrange(len(right) + 1)
            right[k : k + rnd.randrange(3)] = [rnd.choice(words) for _ in range(rnd.randrange(3))]
        right = right or ["v"]
        most = rnd.randrange(25)
        if L.aligned(left, right, most):
            found += 1
            assert levenshtein(" ".join(left), " ".join(right)) <= most
    assert found > 300


def test_words_put_in_need_no_edit_distance(monkeypatch):
    rnd = random.Random(16)
    own = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    asked, real = [], L.within
    monkeypatch.setattr(L, "within", lambda pairs, most: asked.extend(pairs) or real(pairs, most))
    assert L.forest([" ".join(own), " ".join([*own[:9], "new", "words", *own[9:30], *own[31:]])], 0.8) == [(0, 1)]
    assert not asked


def test_a_repeated_line_is_hashed_once_a_task(spark, monkeypatch):
    lines = [" ".join(f"w{k * j % 97}" for j in range(1, 12)) for k in range(30)]
    rows = [(k, "\n".join([lines[k % 30], lines[k * 7 % 30], lines[k % 30]])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    places = L.line_places(L._keyed(df, "doc_id", "text"), L.BLOCKS).collect()
    given = {}
    for r in places:
        if r.blocks is not None:
            assert given.setdefault((r.h1, r.h2), r.blocks) is r.blocks
    assert len(places) == 270 and set(given) == {(r.h1, r.h2) for r in places} and len(given) == 30
    want = L.simhash_blocks([x.encode().split(b" ") for x in lines])
    assert sorted(map(list, given.values())) == sorted(map(list, want.tolist()))


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_buckets_hold_a_line_once(spark, batch):
    """Equal lines of several tasks, also where a batch ends between them."""
    rnd = random.Random(17)
    rows = [(h, [h % 3, h % 5]) for h in range(20) for _ in range(rnd.randrange(1, 4))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = L.shared_blocks(spark.createDataFrame(rows, "h1 long, blocks array<int>").repartition(3), 4_096).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted((b << 32 | h % (3, 5)[b], h) for h in range(20) for b in (0, 1))


def test_counts_of_letters_tell_only_what_is_too_far(monkeypatch):
    from codestrata.llm import edit_batch

    rnd = random.Random(18)
    texts = ["", "a", *("".join(rnd.choice(rnd.choice(["abc", "abcdefgh", "xy\u0163\U0001f600"])) for _ in range(rnd.randrange(60))) for _ in range(60))]
    texts += [x[:9] + "q" + x[10:] for x in texts]
    pairs = [(rnd.randrange(len(texts)), rnd.randrange(len(texts))) for _ in range(1500)]
    most = [rnd.randrange(20) for _ in pairs]
    want = edit_batch.Letters(texts).apart(pairs, most)
    assert 300 < want.sum() < 1400
    assert all(levenshtein(texts[a], texts[b]) > m for (a, b), m, far in zip(pairs, most, want.tolist(), strict=True) if far)
    monkeypatch.setattr(edit_batch, "LANES", 7)
    monkeypatch.setattr(edit_batch, "KEPT", 14)
    monkeypatch.setattr(edit_batch, "COUNTED", 100)
    assert (edit_batch.Letters(texts).apart(pairs, most) == want).all()


def test_unlike_lines_are_not_compared_one_by_one(monkeypatch):
    """Lines that share a common word and no more, as in a large bucket."""
    rnd = random.Random(19)
    kinds = ["abcdefg", "hijklmn", "opqrstu", "vwxyz01", "2345678"]
    lines = ["common " + "".join(rnd.choice(kinds[k % 5] + " ") for _ in range(80)) for k in range(150)]
    held, real = [0], L.plain_verdict
    monkeypatch.setattr(L, "plain_verdict", lambda *a: held.__setitem__(0, held[0] + 1) or real(*a))
    assert L.forest(lines, 0.8) == [] and held[0] < 150 * 149 / 2 / 3


def test_bucket_rows_are_sorted_by_one_number(spark):
    """Lines with equal last bits may come twice, and none is lost or changed."""
    rnd = random.Random(5)
    hashes = [*(rnd.randrange(-(2**63), 2**63) for _ in range(40)), *(k << L.TAIL for k in range(-3, 3)), -1, 2**63 - 1, -(2**63)]
    rows = [(h, [[-7, 2**31 - 1, -(2**31)][h % 3], h % 5, *[0] * 25, h % 2]) for h in hashes]
    found = L.shared_blocks(spark.createDataFrame(rows * 3, "h1 long, blocks array<int>").repartition(3), 4_096)
    assert {tuple(r) for r in found.collect()} == {(b << 32 | v & 0xFFFFFFFF, h) for h, own in rows for b, v in enumerate(own)}


def test_bucket_rows_have_one_sort_key(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(L, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df)
    L.shared_blocks(spark.createDataFrame([(1, [2, 3])], "h1 long, blocks array<int>"), 4_096)
    assert [x.count(" ASC ") for x in plans[0].split("\n") if "Sort [" in x] == [1]
