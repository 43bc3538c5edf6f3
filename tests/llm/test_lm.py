"""Attention model and scores: base against a count, model against a slow one."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codestrata.llm import attention as A
from codestrata.llm import lm_scoring as M

PATH = public_tokenizers.path("byte_bpe_50k.json")


GROUP = (np.arange(A.CLASSES) % 3 == 0).astype(np.float32)


def slow_scores(w, ids, classes):
    """Every target by its own window, one place at a time: (class, group)."""
    out, whole = [], []
    for t in range(len(classes)):
        first = max(0, t // A.STEP * A.STEP - A.BACK)
        skip = A.BACK - (t // A.STEP * A.STEP - first)  # places before the text
        before = range(first, t + 1)
        x = np.array([w["embed"][classes[k - 1] if k else A.START] + w["own"][A.slots(ids[k - 1 : k])[0] if k else 0] for k in before])
        x = x + w["place"][skip : skip + len(x)]
        q, k, v = np.tanh(x @ w["query"]), np.tanh(x @ w["key"]), x @ w["value"]
        a = np.exp(q[-1] @ k.T / A.SIZE**0.5)
        logits = np.tanh(x[-1] + (a / a.sum()) @ v @ w["mix"]) @ w["out"] + w["direct"][classes[t - 1] if t else A.START]
        p = np.exp(logits) / np.exp(logits).sum()
        out.append(np.log(p[classes[t]]))
        whole.append(np.log(p[GROUP > 0].sum()))
    return np.array(out), np.array(whole)


def weights(seed):
    rng = np.random.default_rng(seed)
    w = A.fresh(seed)
    for name in ("direct", "own"):
        w[name] = rng.standard_normal(w[name].shape).astype(np.float32)
    return w


def test_windows_score_each_token_once():
    rng = np.random.default_rng(3)
    w = weights(5)
    sizes = np.array([1, 15, 16, 17, 31, 32, 33, 60, 200])
    ids = rng.integers(0, 50_000, sizes.sum())
    classes = rng.integers(0, A.CLASSES, 50_000)[ids].astype(np.int16)
    got = A.score(w, ids, classes, sizes, GROUP)
    cuts = np.cumsum(sizes)[:-1]
    want = [slow_scores(w, x, y) for x, y in zip(np.split(ids, cuts), np.split(classes, cuts), strict=True)]
    for k in (0, 1):
        assert np.allclose(got[k], np.concatenate([x[k] for x in want]), atol=1e-4)


def test_runs_of_every_text():
    texts = [[b"%d.%d" % (t, k) for k in range(n)] + [b" "] for t, n in enumerate((0, 5, 63, 64, 3000, 1, 700))]
    whole = M.word_runs(texts, 1)
    assert sum(whole, []) == sum(texts, []) and max(map(len, whole)) == M.RUN
    some = M.word_runs(texts, 8)
    assert all(x in whole for x in some) and len(some) < len(whole) / 4
    assert {x[0].split(b".")[0] for x in some if x != [b" "]} >= {b"1", b"2", b"4", b"5", b"6"}


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in weights(1).items()}
    inputs, targets = rng.integers(0, A.CLASSES + 1, (3, A.WIDTH)), rng.integers(0, A.CLASSES, (3, A.STEP))
    inputs[0, : A.BACK] = A.NONE
    own = rng.integers(0, A.SLOTS, inputs.shape)
    counts = rng.random((3, A.STEP)) < 0.7
    loss = lambda: -A.log_probs(w, inputs, own, targets, GROUP)[0][counts].mean()
    g = A.gradient(w, inputs, own, targets, counts)
    for name, shape in A.SHAPES.items():
        at = tuple(int(rng.integers(0, n)) for n in shape)
        at = (int({"embed": inputs, "direct": inputs, "own": own}[name][0, A.BACK + 1]), *at[1:]) if name in ("embed", "direct", "own") else at
        old = w[name][at]
        w[name][at] = old + 1e-4
        up = loss()
        w[name][at] = old - 1e-4
        down = loss()
        w[name][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[name][at], abs=1e-7, rel=1e-3)


def test_training_learns_what_follows():
    rng = np.random.default_rng(2)
    classes = np.zeros(20_000, np.int16)
    for k in range(2, len(classes)):
        classes[k] = (3 * classes[k - 1] + 5) % 64 if rng.random() < 0.8 else rng.integers(0, 64)
    sizes = np.full(20, 1000)
    mean = lambda w: A.score(w, classes, classes, sizes, GROUP)[0].mean()
    assert mean(A.train(A.fresh(), classes, classes, sizes).w) > mean(A.fresh()) + 0.5


def test_attention_sees_what_lies_further_back():
    """Half of a text's subwords are its topic, the others anything: the more
    places are seen, the better the topic is known."""
    rng = np.random.default_rng(4)
    topic = np.repeat(rng.integers(0, 8, 3000), 48)
    classes = np.where(rng.random(len(topic)) < 0.5, topic, rng.integers(8, A.CLASSES, len(topic))).astype(np.int16)
    sizes = np.full(3000, 48)
    w = A.train(A.fresh(), classes, classes, sizes).w
    said = A.score(w, classes, classes, sizes, GROUP)[0].reshape(3000, 48)
    assert said[:, 16:].mean() > said[:, 1:3].mean() + 0.2
    blind = A.score(w | {"mix": np.zeros_like(w["mix"])}, classes, classes, sizes, GROUP)[0].reshape(3000, 48)
    assert said[:, 16:].mean() > blind[:, 16:].mean() + 0.2


def test_recurring():
    words, count = np.array([3, 3, 5, 3, 3, 9, 9]), np.array([4, 1, 2])
    assert M.recurring(words, count).tolist() == [0, 1, 0, 2 / 3, 0, 0, 1]


def test_subwords_are_those_of_the_words():
    found, sizes = M.subwords(M.text_words(["The cat", "", " a\n the "]), PATH)
    encode = M.byte_ids(PATH).engine.encode_ordinary
    assert found.tolist() == [*encode(" the"), *encode(" cat"), M.END, M.END, *encode(" a"), *encode(" the"), M.END]
    assert sizes.sum() == len(found) and sizes[1] == 1


def texts():
    rng = np.random.default_rng(8)
    words = [f"wo{k}rd" for k in range(40)] + ["the", "of", "É", "a b", "<|endoftext|>", "it's"]
    return [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(120)] + [None, "", " \n", "The THE the"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(5, "again", "y"), (5, "again", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).cache()


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def test_scores(docs, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 2)
    rows = docs.collect()
    counts = Counter()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    for r in rows:
        if not held(r.doc_id):
            counts.update(words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id), len(words(r.text)), sum(counts[w] > 0 for w in words(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r.text)), 6)) for r in rows)
    got = M.lm_scores(docs, PATH, held_out()).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # words drawn evenly and alone: nothing can beat their counts, little may be lost
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 1.02 * sum(r.base_score for r in out)


def test_held_out_texts_with_topics_beat_the_unigram(spark):
    rng = np.random.default_rng(9)
    words = np.array([f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter") for b in ("ven", "dri", "son", "pe", "qui") for c in ("ly", "ed", "ing", "or", "ast")])
    rows = [(k, " ".join(rng.choice(rng.choice(words, 6), 80))) for k in range(300)]
    got = M.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), PATH, held_out()).where("held_out").collect()
    assert len(got) > 20
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_model_is_a_distribution(spark):
    words = spark.createDataFrame([(b"the", 50), (b"wood", 3), (b"of", 20), (b"unseen", 0)], "word binary, n long")
    model = M.fit_counts(M.vocabulary(words, PATH).cache(), PATH)
    sums = np.zeros(A.CLASSES)
    for before in (0, 7, A.CLASSES):
        sums = np.bincount(model.classes, weights=np.exp(model.inside[before].astype(np.float64)), minlength=A.CLASSES)
        assert np.allclose(sums[sums > 0], 1, atol=1e-3)
    begins = M.initial(PATH)
    assert not set(model.classes[begins]) & set(model.classes[~begins])


def test_spelled_words_against_a_slow_sum(spark):
    """Words of two texts, one by one; an end has nothing after it."""
    words = spark.createDataFrame([(b"the", 50), (b"woodenish", 3), (b"of", 20)], "word binary, n long")
    model = M.fit_counts(M.vocabulary(words, PATH).cache(), PATH)
    model = model._replace(weights=weights(6) | {"direct": model.weights["direct"]})
    ids, sizes = M.subwords(M.text_words(["the woodenish of", "of the"]), PATH)
    encode = M.byte_ids(PATH).engine.encode_ordinary
    length = [len(encode(" " + x)) if x else 1 for x in ("the", "woodenish", "of", "", "of", "the", "")]
    got = M.spelled_words(model, ids, sizes, np.array(length))
    said, begin = A.score(model.weights, ids, model.classes[ids].astype(np.int16), sizes, M.BEGINS)
    want, at, ends = [], 0, set(np.cumsum(sizes).tolist())
    for n in length:
        total = -begin[at]
        for k in range(at, at + n):
            before = A.CLASSES if k == 0 or k in ends else model.classes[ids[k - 1]]
            total += said[k] + model.inside[before, ids[k]]
        at += n
        want.append(total + (0 if at in ends else begin[at]))
    assert np.allclose(got, want, atol=1e-4)


def test_all_held_out_and_empty(docs):
    got = M.lm_scores(docs, PATH, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert M.lm_scores(docs.where("doc_id = -1"), PATH, held_out()).count() == 0


def test_blocks_do_not_change_scores(docs, monkeypatch):
    whole = sorted(map(str, M.lm_scores(docs, PATH, held_out()).select("doc_id", "base_score", F.round("score", 2)).collect()))
    monkeypatch.setattr(M, "BLOCK", 50)
    monkeypatch.setattr(M, "STEP", 40)
    assert sorted(map(str, M.lm_scores(docs, PATH, held_out()).select("doc_id", "base_score", F.round("score", 2)).collect())) == whole


def test_every_training_document_is_learned_from_once(docs, monkeypatch):
    """By the registered values, and none that is held out."""
    seen, real = [], M.train

    def spy(df, *rest):
        seen.extend((r.doc_id, r.text) for r in df.collect())
        return real(df, *rest)

    monkeypatch.setattr(M, "train", spy)
    M.lm_scores(docs, PATH, held_out())
    want = [(r.doc_id, r.text) for r in docs.where(~held_out()).collect()]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_the_model_learns_from_every_run():
    texts = [" ".join(f"w{t}x{k}" for k in range(n)) for t, n in enumerate((0, 5, 64, 3000))]
    ids, sizes = M.lesson(texts, PATH)
    whole, own = M.subwords(M.word_runs(M.text_words(texts), 1), PATH)
    assert np.array_equal(ids, whole) and np.array_equal(sizes, own)
    assert len(sizes) == sum(-(-(n + 1) // M.RUN) for n in (0, 5, 64, 3000)) and sizes.sum() == len(ids)


def test_adam_moves_all_weights_as_one_row():
    """The same numbers as by one array after another, and the weights are views of them."""
    rng = np.random.default_rng(6)
    adam, w = A.Adam(weights(3)), {k: v.copy() for k, v in weights(3).items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for t in range(1, 4):
        g = {k: rng.standard_normal(x.shape).astype(np.float32) for k, x in w.items()}
        adam.step(g)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    assert all(np.allclose(adam.w[k], w[k], rtol=1e-6, atol=1e-7) for k in w)
    assert np.array_equal(adam.row, A.flat(adam.w)) and all(np.shares_memory(adam.row, x) for x in adam.w.values())
