"""Token counts, packing and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codestrata.llm import packing, token_counts, token_files
from codestrata.llm.encoding import WordIds

CHARS = " \n\t\r'sdLaaaaÀ bAé1½²٣中文😀  \u0085\x1c​İ<|endoftext|>.,!Σς'll_"


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [*made, "a<|endoftext|> b<|startoftext|>", "", None, "ab" * 3000, "aaa aaaa aaaaa", "   ", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k, "x") for k, t in enumerate(texts())] + [(3, "again", 0, "y"), (3, "again", 0, "y"), (None, "no id", 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string").repartition(3).cache()


def expected(name, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + end, "<u4")


def test_token_counts(docs):
    ids = expected("byte_bpe_50k.json", [])
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=20).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 20) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rounds_merge_overlapping_runs():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    ids = expected("byte_bpe_50k.json", [])
    words = ["a" * n for n in range(1, 70)] + ["ab" * n for n in range(1, 40)] + ["é" * n for n in range(1, 20)]
    assert counter.count(words) == [len(ids(w)) for w in words]


def test_long_text_is_cut_where_tokens_end(monkeypatch):
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "it's a  long text,\n with  spaces  and words " * 50
    whole = counter.count([text])
    monkeypatch.setattr(token_counts.parts, "__defaults__", (37,))
    assert len(list(token_counts.parts(text))) > 10 and "".join(token_counts.parts(text)) == text
    assert counter.count([text]) == whole


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where("doc_id = -1")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(none, path).count() == 0
    assert packing.pack(none, path).count() == 0
    token_files.write_token_files(none, str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.document_index(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs):
    ids = expected("byte_bpe_50k.json", [0])
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=64, group_docs=50, with_ids=True)
    rows = got.collect()
    want = {}
    for r in docs.collect():
        own = ids(r.text)
        for a in range(0, len(own), 64):
            part = own[a : a + 64]
            want.setdefault((r.doc_id, a, len(part), zlib.crc32(part.tobytes()), len(own)), []).append(part.tobytes())
    have = {}
    for r in rows:
        have.setdefault((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(bytes(r.ids))
    assert have == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 64
    assert sum(r.length for r in rows) > 0.93 * 64 * len(by_sequence)
    joined = packing.sequences(got).collect()
    assert all(len(r.ids) == 4 * r.used for r in joined) and len(joined) == len(by_sequence)


def test_first_fit_decreasing_like_brute_force():
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 100) for _ in range(3000)), reverse=True)
    packer, free, want = packing.GroupPacker(100), [], []
    for s in sizes:
        if s == 100:
            free.append(0)
            want.append((len(free) - 1, 0))
            continue
        at = next((k for k, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(100)
            at = len(free) - 1
        want.append((at, 100 - free[at]))
        free[at] -= s
    assert [packer.place(s) for s in sizes] == want


def test_packer_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MAX_ITEMS", 8)
    packer = packing.GroupPacker(10)
    places = [packer.place(3) for _ in range(100)]
    assert len(packer.number) <= 8 and len(set(places)) == 100


@pytest.mark.parametrize("file_ids", [500, 8_000_000])
def test_token_files(spark, docs, tmp_path, file_ids):
    ids = expected("word_bpe_49k.json", [2])
    path = str(tmp_path / "files")
    token_files.write_token_files(docs.repartition(4), path, public_tokenizers.path("word_bpe_49k.json"), 2, length=128, file_ids=file_ids)
    got = sorted(token_files.document_index(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted(str((r.doc_id, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes()))) for r in rows)
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == want
    # any sequence straight from the mapped file
    for f in (tmp_path / "files").glob("part-*"):
        reader = pa.ipc.open_file(pa.memory_map(str(f)))
        batch = reader.get_batch(0)
        assert batch.schema.field("input_ids").type == pa.list_(pa.uint16(), 128)
        assert len(batch.column(0)[0]) == len(batch.column(1)[0]) == 128


def test_word_pool_begins_anew(monkeypatch):
    from codestrata.llm import encoding

    monkeypatch.setattr(encoding, "CACHE", 50)
    engine, ids = WordIds(public_tokenizers.path("word_bpe_49k.json")), expected("word_bpe_49k.json", [])
    many = [t or "" for t in texts()]
    for k in range(0, len(many), 7):
        for got, text in zip(engine.batch(many[k : k + 7]), many[k : k + 7], strict=True):
            assert got.tolist() == ids(text).tolist()


def test_word_ids_of_every_plain_letter():
    """Capitals whose small letters are not plain go through the library."""
    from codestrata.llm.token_counts import PLAIN

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(0x2100)) if PLAIN.fullmatch(c)]
    texts = [t for c in letters for t in (c, f"the {c}LI", f"a{c}b {c}{c}", f"x{c}1")]
    got = WordIds(path).batch(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in got] == want
