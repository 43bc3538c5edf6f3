import datetime as dt
import json

from pyspark.sql import functions as F

from codestrata.operators import diagnostics as D
from codestrata.operators import extract as X
from codestrata.sources.corpus import synthetic_project
from codestrata.sources.logs import to_json_lines
from codestrata.sources.tables import decode_files
from codestrata.streaming.sessions import doc_index_ttl_stream


def test_decode_files(spark):
    df = spark.createDataFrame([("p", "a.py", bytearray(b"x = 1\n")), ("p", "b.py", bytearray(b"\xff\xfe"))], "project string, path string, content binary")
    assert [r.path for r in decode_files(df).collect()] == ["a.py"]


def test_json_sink(spark):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    assert json.loads(to_json_lines(df).first().json) == {"n": 1, "s": "a"}


def test_synthetic_project(spark):
    f = synthetic_project(spark, 5, 50)
    a = X.analyze_files(f)
    s = {r.path: r for r in X.file_summary(a).collect()}
    assert len(s) == 5 and all(r.error is None and r.n_functions == 5 for r in s.values())
    assert s["file_0.py"].n_imports == 1 and s["file_1.py"].n_imports == 2


def test_type_checker_fallback(spark):
    cols = "project string, path string, line long, column long, severity string, source string, message string"
    mypy = spark.createDataFrame([("p", "a.py", 1, 0, "error", "mypy", "m")], cols)
    pyright = spark.createDataFrame([("p", "a.py", 2, 0, "error", "pyright", "x"), ("p", "b.py", 3, 0, "error", "pyright", "y")], cols)
    got = sorted((r.path, r.source) for r in D.type_checker_fallback(mypy, pyright).collect())
    assert got == [("a.py", "mypy"), ("b.py", "pyright")]


def test_ttl_dedup_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(hours=1)), ("b", t0)]
    spark.createDataFrame(rows, "name string, cached_at timestamp").write.parquet(str(tmp_path / "d"))
    s = spark.readStream.schema("name string, cached_at timestamp").parquet(str(tmp_path / "d"))
    q = doc_index_ttl_stream(s).writeStream.format("memory").queryName("ttl_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.name for r in spark.sql("SELECT name FROM ttl_out").collect()) == ["a", "b"]
