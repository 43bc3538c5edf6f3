from codestrata.operators import search as S
from codestrata.sources.tables import document_files

SF = "/root/testdata/sf0.001"


def test_search_matches_duckdb_line_split(spark):
    import duckdb

    f = document_files(spark, SF)
    got = S.search_text(f, "License").count()
    con = duckdb.connect()
    want = con.sql(
        f"SELECT count(*) FROM (SELECT unnest(string_split(CASE WHEN right(text,1)=chr(10) THEN substr(text,1,length(text)-1) ELSE text END, chr(10))) AS l "
        f"FROM '{SF}/documents.parquet') WHERE regexp_matches(l, 'License')"
    ).fetchall()[0][0]
    assert got == want


def test_limits_and_truncation(spark, files):
    f = files([("a.py", "x = KEY\ny = KEY\nz = KEY\n"), ("b.py", "KEY\n")])
    m = S.search_text(f, "KEY")
    s = S.search_summary(m, 2).first()
    assert (s["total"], s["count"], s["truncated"]) == (4, 2, True)
    assert [(r.path, r.line) for r in S.first_results(m, 2).collect()] == [("a.py", 1), ("a.py", 2)]
    assert S.search_text(f, "KEY", per_file_limit=1).count() == 2


def test_case_context_and_offsets(spark, files):
    f = files([("a.py", "one\nx = DATABASE_URL\nthree\n")])
    assert S.search_text(f, "database_url").count() == 0
    assert S.search_text(f, "database_url", case_sensitive=False).count() == 1
    r = S.search_text(f, "DATABASE", context_lines=1).first()
    assert (r.before, r.after) == ("one", "three")
    sub = S.submatch_offsets(S.search_text(f, "DATABASE_URL"), "DATABASE_URL").first().submatches[0]
    assert (sub.start, sub.end) == (4, 16)


def test_config_classifier(spark):
    cases = {
        "settings.py": "python", "config.yaml": "yaml", "c.yml": "yaml", "docker-compose.yml": "docker-compose",
        "docker-compose.prod.yaml": "docker-compose", "pyproject.toml": "toml", ".env": "env", ".env.production": "env",
        "setup.cfg": "config", "tox.ini": "config", "nginx.conf": "config", "package.json": "json", "Dockerfile": "docker",
        "Dockerfile.dev": "docker", "main.rs": "other",
    }
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.c for r in df.select("path", S.config_category(F.col("path")).alias("c")).collect()}
    assert got == cases


def test_config_trace(spark, files):
    f = files([("settings.py", "DATABASE_URL = 1\n"), ("config.yaml", "database_url: x\n"), (".env", "DATABASE_URL=y\n"), ("notes.md", "DATABASE_URL\n")])
    refs = S.find_config_references(f, "DATABASE_URL")
    counts = {r.category: r.n_refs for r in S.config_category_counts(refs).collect()}
    assert counts == {"python": 1, "yaml": 1, "env": 1, "TOTAL": 3}
