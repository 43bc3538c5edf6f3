import datetime as dt

from pyspark.sql import functions as F

from codestrata.operators import accounting as A
from codestrata.operators import packages as P


def test_tokens(spark):
    df = spark.createDataFrame([("hello world test string",), ("",)], "text string")
    r = df.select(A.tokens(F.col("text")).alias("a"), A.tokens(F.col("text"), "word").alias("w")).collect()
    assert 3 <= r[0].a <= 10 and r[0].w == 5 and r[1].a == 0 and r[1].w == 0


def test_cost_defaults(spark):
    df = spark.createDataFrame([(1_000_000, "gpt-4o", "output"), (1_000_000, "nope", "sideways")], "t long, m string, d string")
    c = [r.c for r in df.select(A.cost_usd(F.col("t"), F.col("m"), F.col("d")).alias("c")).collect()]
    assert c == [10.0, 3.0]


def test_session_metrics(spark):
    lines = [
        '{"type":"assistant","timestamp":"2024-01-01T00:00:00Z","usage":{"input_tokens":1,"output_tokens":2},"content":[{"type":"tool_use"}]}',
        "not json",
        "",
        '{"type":"user","content":"text"}',
        '{"type":"turn.completed","ts":"2024-01-01T00:00:10Z","input_tokens":5,"output_tokens":6}',
    ]
    raw = spark.createDataFrame([("s1", i, v) for i, v in enumerate(lines)], "session_id string, line_no long, value string")
    m = A.session_metrics(A.parse_session_events(raw)).first()
    assert (m.input_tokens, m.output_tokens, m.turn_count, m.tool_calls, m.wall_clock_seconds) == (6, 8, 2, 1, 10.0)


def test_timing_summary_single_row(spark):
    t = spark.createDataFrame([("s", "noop", i, 1.0 + i, 5.0) for i in range(5)] + [("s", "one", 0, 2.0, 1.0)], "suite string, name string, iteration int, ms double, peak_kb double")
    r = {x.name: x for x in A.timing_summary(t).collect()}
    assert r["noop"].median_ms == 3.0 and r["one"].std_dev_ms == 0.0


def test_version_spec(spark):
    req = spark.createDataFrame([(1, "1.5.0", ">=1.0,<999.0"), (2, "1.5.0", ">=2"), (3, None, ">=1"), (4, "1.0", "~=1.0")], "request_id int, version string, spec string")
    r = {x.request_id: x for x in P.check_spec(req).collect()}
    assert r[1].compatible and not r[2].compatible and not r[3].compatible and not r[4].compatible
    assert "Unsupported" in r[4].details[0]


def test_fingerprint_matches_python(spark):
    import hashlib
    import json

    pk = [("e", "b", "2.0"), ("e", "a", "1.0")]
    df = spark.createDataFrame(pk, "env string, name string, version string")
    want = hashlib.sha256(json.dumps(sorted([(n, v) for _, n, v in pk]), sort_keys=True).encode()).hexdigest()[:16]
    assert P.inventory_fingerprint(df).first().fingerprint == want


def test_lfu_and_freshness(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [("e", f"n{i}", "pkg", "1.0", now - dt.timedelta(hours=i), 5 if i == 0 else 0) for i in range(500)]
    idx = spark.createDataFrame(rows, "env string, name string, package string, package_version string, cached_at timestamp, hit_count long")
    v = P.lfu_victims(idx, count=50).collect()
    assert len(v) == 50 and "n0" not in {r.name for r in v}
    pk = spark.createDataFrame([("e", "pkg", "2.0")], "env string, name string, version string")
    st = {r.status for r in P.doc_freshness(idx, pk, F.lit(now)).collect()}
    assert st == {"stale_version"}


def test_package_manager(spark):
    markers = spark.createDataFrame([("proj", "pyproject.toml", "[tool.poetry]\n")], "dir string, file string, text string")
    req = spark.createDataFrame([(1, "proj/src"), (2, "other")], "request_id int, dir string")
    m = {r.request_id: r.manager for r in P.detect_manager(markers, req).collect()}
    assert m == {1: "poetry", 2: "pip"}


def test_version_change_invalidates_and_evicts(spark):
    now = dt.datetime(2024, 2, 1)
    idx = spark.createDataFrame(
        [("e", f"doc{i}", "pkg", "1.0.0", now, 0) for i in range(3)], "env string, name string, package string, package_version string, cached_at timestamp, hit_count long"
    )
    old = spark.createDataFrame([("e", "pkg", "1.0.0")], "env string, name string, version string")
    new = spark.createDataFrame([("e", "pkg", "2.0.0")], "env string, name string, version string")
    r = P.refresh(old, new, idx).first()
    assert (r.changed, r.evicted) == (1, 3)
    assert P.refresh(old, old, idx).first().evicted == 0
    st = {x.status for x in P.doc_freshness(idx, new, F.lit(now)).collect()}
    assert st == {"stale_version"}
    assert {x.status for x in P.doc_freshness(idx, old, F.lit(now)).collect()} == {"hit"}
    assert P.stale_inventories(old, new).first().stale and not P.stale_inventories(old, old).first().stale


def test_auto_tokens_fall_back(spark):
    import pytest

    df = spark.createDataFrame([("hello world test string",)], "text string")
    if not A.exact_tokenizer_available():
        assert df.select(A.tokens(F.col("text"), "auto").alias("t")).first().t == 5
        with pytest.raises(RuntimeError):
            A.tokens(F.col("text"), "tiktoken")
    else:
        assert df.select(A.tokens(F.col("text"), "tiktoken").alias("t")).first().t > 0


def test_hit_count_rises_before_ttl(spark):
    now = dt.datetime(2024, 2, 1)
    idx = spark.createDataFrame(
        [("e", "old", "pkg", "1.0", now - dt.timedelta(hours=500), 2), ("e", "new", "pkg", "1.0", now, 2), ("e", "stale", "pkg", "0.9", now, 2)],
        "env string, name string, package string, package_version string, cached_at timestamp, hit_count long",
    )
    pk = spark.createDataFrame([("e", "pkg", "1.0")], "env string, name string, version string")
    r = {x.name: (x.status, x.hit_count_after) for x in P.doc_freshness(idx, pk, F.lit(now)).collect()}
    assert r == {"old": ("expired", 3), "new": ("hit", 3), "stale": ("stale_version", 2)}


def test_exact_median_ties_nulls_and_a_hot_group(spark):
    import statistics

    values = {"hot": [float(i * 7919 % 5003) for i in range(4000)], "tied": [2.0] * 9 + [5.0] * 9, "one": [3.5], "even": [1.0, 4.0], None: [8.0, 1.0, 2.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("void", None)]
    got = {r.k: r.median for r in A.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_timing_summary_keeps_groups_without_values(spark):
    t = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 4.0), ("s", "b", None), (None, "a", 7.0)], "suite string, name string, ms double")
    got = {(r.suite, r.name): r.median_ms for r in A.timing_summary(t, peak=None).collect()}
    assert got == {("s", "a"): 2.5, ("s", "b"): None, (None, "a"): 7.0}
