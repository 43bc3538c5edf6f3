"""WARC round trips, with whole records and bare magic inside payloads."""

import base64
import hashlib
import random

import pytest

from codestrata.llm import warc as W

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    rnd = random.Random(2)
    hard = [None, "", FAKE, "a" + FAKE + "b" + FAKE, "WARC/1.0\r\n", "é WARC/1.0\r\nWARC/1.0\r\nx", FAKE * 20, "\r\n\r\n", "WWARC/1.0\r\nWARC/1.0", "WAWARC/1.0\r\nfoo", "a" + FAKE + "b" + FAKE, "x" * 3000 + FAKE, "plain", "plain", "plain"]
    hard += ["y" * rnd.randint(0, 300) + FAKE * rnd.randint(0, 2) + "WARC/1.0\r\n" * rnd.randint(0, 2) for _ in range(60)]
    return [(k, f"http://x/{k}", h, "x") for k, h in enumerate(hard)] + [(None, None, "q", "x"), (None, "u\r\nX: y", "q", "x"), (900, "u", "q", "x"), (7, "u", "plain", "x")]


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = page is not None and first[html or ""] < page
        out.append((page, len(raw), digest, "revisit" if again else "response", first[html or ""] if again else None, True))
    return sorted(map(str, out))


@pytest.mark.parametrize("split", ["128m", "5k", "700"])
def test_round_trip(spark, tmp_path, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, type string").repartition(2).cache()
    path = str(tmp_path / "warc")
    W.write_warc(df, path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = W.page_records(W.read_warc(spark, path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(str, map(tuple, got))) == expected(rows)


def test_written_records_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a b/", "<p>é</p>"), (2, None, "<p>é</p>")], "page_id long, url string, html string").coalesce(1)
    W.write_warc(df, str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert raw.startswith(b"WARC/1.0\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC/1.0\r\n") == 2
    assert b"WARC-Target-URI: http://a%20b/\r\n" in raw and "\r\n\r\n<p>é</p>\r\n\r\n".encode() in raw
    assert b"WARC-Refers-To: <urn:page:1>\r\n" in raw and b"Content-Length: 0\r\n" in raw


def test_small_payloads_are_not_revisited(spark, tmp_path):
    df = spark.createDataFrame([(k, None, "ab") for k in range(3)], "page_id long, url string, html string")
    W.write_warc(df, str(tmp_path / "w"), least=3)
    assert {r.record_type for r in W.page_records(W.read_warc(spark, str(tmp_path / "w"))).collect()} == {"response"}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_warc(df, str(tmp_path / "w"))
    assert W.page_records(W.read_warc(spark, str(tmp_path / "w"))).count() == 0


def test_broken_tail_is_not_a_record(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "one"), (2, None, "two")], "page_id long, url string, html string").coalesce(1)
    W.write_warc(df, str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(b"junk" + part.read_bytes())
    # the chain starts at the file's first byte
    assert W.read_warc(spark, str(tmp_path / "cut")).count() == 0
