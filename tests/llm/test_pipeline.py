"""The pipeline's stages against what each operator decides alone, and SQL where it can say it."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from codestrata.llm import decontam, line_dedup, quality, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_takes_effect(spark, stages):
    docs, good, lines, single, clean, packed = stages
    assert ids(good) == ids(quality.quality(docs).where("kept"))
    own = {r.doc_id: r.text for r in line_dedup.dedup_lines(good).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == own and all(r.n_chars == len(r.text) for r in lines.collect())
    assert ids(single) == ids(simhash.near_duplicates(lines).where("doc_id = component_id"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(clean) == ids(decontam.decontaminate(single, items).where(~decontam.contaminated()))
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean)
    assert 0 < clean.count() < docs.count()


def test_nulls_and_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(2)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars"))
    for rows in (docs.limit(20).unionByName(odd), docs.limit(0)):
        now = rows.cache()
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF).cache()
        assert now.columns[0] == "doc_id"


def test_run_and_registration(spark):
    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def odd_documents(spark):
    """Two unlike texts on one id, repeated rows, null ids and a clashing column."""
    words = [f"{w}{k}" for k in range(40) for w in ("stone", "river", "cloud")]
    text = lambda k: " ".join(words[k:] + words[:k])
    a, b, c = text(1), " ".join(w[::-1] for w in words), " ".join(w.upper() + "x" for w in words)
    rows = [(1, a, 0), (1, b, 0), (1, a, 0), (2, a, 1), (None, c, 2), (None, c, 2), (None, a, 3), (5, None, 4), (6, "", 5), (1, b, 9)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, key int")


def test_near_dedup_keeps_one_document_of_each_component(spark):
    rows, df = odd_documents(spark)
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, df.repartition(4), SF).collect()), key=str)
    a, b, c = rows[0][1], rows[1][1], rows[4][1]
    assert got == sorted([(1, a, 0), (1, b, 0), (None, c, 2), (5, None, 4)], key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), SF).count() == 0


def test_decontamination_judges_texts_that_share_an_id_apart(spark, tmp_path):
    rows, df = odd_documents(spark)
    b, c = rows[1][1], rows[4][1]
    spark.createDataFrame([(1, " ".join(b.split()[:40])), (2, " ".join(c.split()[-30:]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()), key=str)
    assert got == sorted([r for r in rows if r[1] not in (b, c)], key=str)


def test_line_stage_without_n_chars_and_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "same line here\nown one", 1, 2, "x"), (2, "same line here\nanother thing", 3, 4, "y")], "doc_id long, text string, gone_id int, numbers int, row string")
    got = {tuple(r) for r in corpus_pipeline.repeated_lines(spark, df, SF).collect()}
    assert got == {(1, "same line here\nown one", 1, 2, "x"), (2, "another thing", 3, 4, "y")}
