import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codestrata.llm import alignment
from codestrata.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the ", "anatomy", "  ", "\n", "é", "日本", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "don't", "12345", "\t", "ƏLI", "\x00", "﻿", "ﬁ", "é", "ing ", "\r\n", "\xa0", "·"]


def brute(rows):
    """Straight from the definition, with both libraries."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    alphabet = byte_alphabet()
    found = []
    for _, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw_a = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[x:u], b[y:v]))
            x, y = u, v
        found.append((a, b, groups, [(s, t) for s, e in zip(a, ends_a, strict=True) for t, f in zip(b, ends_b, strict=True) if e == f]))
    counts = Counter(p for *_, links in found for p in links)
    most: dict = {}
    for (_, t), n in counts.items():
        most[t] = max(most.get(t, 0), n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, found, strict=True):
        said = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=str)


def rows_of(rng, n=150):
    out = [(rng.choice([k, k, None, 3]), rng.choice(["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))), None, "", "the anatomy of the ing"])) for k in range(n)]
    return [*out, (9, " "), (9, " "), (10, "a"), (11, "a" * 3000)]


@pytest.mark.parametrize("how", [{}, {"run_links": 40, "fan": 3}])
def test_alignment_equals_brute_force(spark, how):
    rows = rows_of(random.Random(5))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, bucket string").repartition(3)
    got = alignment.align_tokens(df, A, B, **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_groups_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the anatomy"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align_tokens(df, A, B, with_groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert rows[2].groups == "" and rows[2].count_sum == 0
    assert alignment.align_tokens(df.limit(0), A, B).collect() == []


def test_long_texts_are_cut_without_a_change():
    both = alignment.pair(A, B)
    rng = random.Random(2)
    text = "".join(rng.choice(PARTS[:10] + ["word "] * 10) for _ in range(330_000))
    assert len(text) > 1_000_000 and both.ids_b([text, "x"]) == both.pieces.encode([text, "x"])


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_merge_counts_and_maxima(block):
    rng = random.Random(block)
    heads, want = [], Counter()
    pack = alignment.zstandard.ZstdCompressor().compress
    for _ in range(9):
        own = sorted(rng.sample(range(200), rng.randrange(0, 60)))
        raw = np.array([(p, rng.randrange(1, 9)) for p in own], alignment._HEAD)
        heads.append(pack(raw.tobytes()))
        want.update({int(p): int(n) for p, n in raw})
    merged = list(alignment.merged(heads, block))
    flat = np.concatenate(merged)
    assert flat["pair"].tolist() == sorted(want) and dict(zip(flat["pair"].tolist(), flat["n"].tolist(), strict=True)) == want
    best = [(int(p), bool(b)) for entries, flags in alignment.side_maxima(iter(merged), 4) for p, b in zip(entries["pair"], flags, strict=True)]
    assert best == [(p, want[p] == max(n for q, n in want.items() if q >> 4 == p >> 4)) for p in sorted(want)]


def test_pairs_are_bounded_by_the_vocabularies():
    both = alignment.pair(A, B)
    own = {t: k for k, t in enumerate(both.a.tokens)}
    suffixes = sum(t[k:] in own for t in both.b.tokens for k in range(len(t)))
    assert suffixes < both.pair_bound() < 2_000_000
    keys = both.key(np.arange(32_000), np.arange(32_000))
    a, b = both.ids_of(keys)
    assert a.tolist() == b.tolist() == list(range(32_000))
