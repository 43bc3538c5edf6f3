"""Registered log-ingestion queries (A4, A8-A10, K6) over data Spark derives
from the driver tables."""

from pyspark.sql import functions as F

from ..operators import accounting as A
from ..operators import search as S
from ..sources import logs as L
from ..sources.corpus import _parallelism
from ..sources.tables import document_files, table
from .corpus_views import code_files
from .registry import query
from .sql_common import DOC_FILES, with_


def _rg_events(spark, sf_dir):
    """Search-tool JSON event stream for ``License`` over the documents:
    a begin event per file, a match event per line, plus noise lines."""
    m = S.search_text(document_files(spark, sf_dir), "License")
    ev = m.select(
        F.to_json(
            F.struct(
                F.lit("match").alias("type"),
                F.struct(
                    F.struct(F.col("path").alias("text")).alias("path"),
                    F.col("line").alias("line_number"),
                    F.struct(F.concat("text", F.lit("\n")).alias("text")).alias("lines"),
                    F.array(F.struct(F.struct(F.lit("License").alias("text")).alias("match"), F.lit(0).alias("start"), F.lit(7).alias("end"))).alias("submatches"),
                ).alias("data"),
            )
        ).alias("value")
    )
    begin = m.select(F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(F.struct(F.col("path").alias("text")).alias("path")).alias("data"))).alias("value"))
    noise = table(spark, sf_dir, "documents").select(F.concat(F.lit("not json "), F.col("doc_id").cast("string")).alias("value"))
    return ev.unionByName(begin).unionByName(noise)


@query(
    "search_event_ingest",
    with_(DOC_FILES) + "SELECT path, CAST(line AS BIGINT) AS line, text FROM doc_lines WHERE regexp_matches(text, 'License')",
)
def search_event_ingest(spark, sf_dir):
    return L.parse_search_events(_rg_events(spark, sf_dir)).select("path", "line", "text")


APPROX = "CASE WHEN length(coalesce({t}, '')) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END"


@query(
    "session_log_ingest",
    f"""SELECT CAST(conv_id AS VARCHAR) AS session_id,
              CAST(sum(CASE WHEN role = 'assistant' THEN {APPROX.format(t='text')} ELSE 0 END) AS BIGINT) AS output_tokens,
              CAST(sum(CASE WHEN role <> 'assistant' THEN {APPROX.format(t='text')} ELSE 0 END) AS BIGINT) AS input_tokens,
              CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS turn_count,
              CAST(count(*) FILTER (WHERE role = 'assistant' AND turn % 4 = 1) AS BIGINT) AS tool_calls,
              coalesce(CAST(max(turn) FILTER (WHERE role = 'assistant') - min(turn) FILTER (WHERE role = 'assistant') AS DOUBLE), 0.0) AS wall_clock_seconds
         FROM conversations GROUP BY conv_id""",
)
def session_log_ingest(spark, sf_dir):
    """A8 + L1: conversations written as JSONL session logs (one file per
    conversation, events in turn order), then parsed back."""
    c = table(spark, sf_dir, "conversations")
    tok = A.tokens(F.col("text"))
    asst = F.col("role") == "assistant"
    event = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.when(asst, F.date_format(F.timestamp_seconds(F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
            F.when(asst, tok).alias("output_tokens"),
            F.when(~asst, F.struct(tok.alias("input_tokens"))).alias("usage"),
            F.when(asst & (F.col("turn") % 4 == 1), F.array(F.struct(F.lit("tool_use").alias("type")))).otherwise(F.array().cast("array<struct<type:string>>")).alias("content"),
        )
    )
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    lines = L.numbered_lines(files.select(F.lit("logs").alias("project"), F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), "text"))
    m = A.session_metrics(A.parse_session_events(lines))
    return m.select("session_id", "output_tokens", "input_tokens", "turn_count", "tool_calls", "wall_clock_seconds")


@query(
    "free_text_sessions",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id,
              CAST(sum(len(string_split(line, 'ASSISTANT:')) - 1 + len(string_split(line, 'assistant')) - 1) AS BIGINT) AS turn_count,
              CAST(CASE WHEN sum(length(line)) > 0 THEN greatest(1, sum(length(line)) // 4) ELSE 0 END AS BIGINT) AS total_tokens
         FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END || ': ' || text AS line FROM conversations) GROUP BY conv_id""",
)
def free_text_sessions(spark, sf_dir):
    """One free-text log file per turn, grouped by conversation: ``ROLE: text``
    on even turns and ``role: text`` on odd ones, so both halves of the
    counting rule meet rows."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role"))
    f = c.select(F.col("conv_id").cast("string").alias("project"), F.concat(F.col("turn").cast("string"), F.lit(".txt")).alias("path"), F.concat(role, F.lit(": "), F.col("text")).alias("text"))
    return L.free_text_sessions(f)


@query("file_representations")
def file_representations(spark, sf_dir):
    """K6: raw source vs AST dump vs structured JSON sizes per file (no SQL
    oracle: the AST dump text is a Python rendering)."""
    from ..operators import extract as X

    f = code_files(spark, sf_dir)
    a = X.analyze_files(f, with_dump=True).join(f.select("project", "path", "text"), ["project", "path"])
    return A.file_representations(a.where(F.col("error").isNull()))


@query(
    "generic_sessions",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id,
              CAST(CASE WHEN sum(length(text)) > 0 THEN greatest(1, sum(length(text)) // 4) ELSE 0 END AS BIGINT) AS total_tokens
         FROM conversations GROUP BY conv_id""",
)
def generic_sessions(spark, sf_dir):
    """A10: one log file per conversation turn part; session = file stem."""
    c = table(spark, sf_dir, "conversations")
    f = c.select(F.lit("logs").alias("project"), F.concat(F.lit("sessions/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("path"), "text")
    return L.generic_sessions(f)


def _runs(spark, sf_dir):
    """Evaluation runs, several of one key, in the order of their suppliers."""
    s = table(spark, sf_dir, "supplier").orderBy("s_suppkey")
    none = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in L.RUN_SCHEMA.split(", ")}
    k = F.col("s_suppkey")
    own = {
        "task_id": F.concat(F.lit("t"), (k % 5).cast("string")),
        "agent": F.concat(F.lit("a"), (k % 2).cast("string")),
        "skill_enabled": k % 3 == 0,
        "tests_total": k,
        "total_tokens": k * 10,
        "timestamp": F.lit("2024-01-01T00:00:00+00:00"),
    }
    return s.select(*[own.get(c, none[c]).alias(c) for c in L.RUN_KEYS])


def _folder(spark, name):
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/codestrata-{name}-{uuid.uuid4().hex}"


_RUNS_CTE = "runs AS (SELECT 't' || CAST(s_suppkey % 5 AS VARCHAR) AS task_id, 'a' || CAST(s_suppkey % 2 AS VARCHAR) AS agent, s_suppkey % 3 = 0 AS skill_enabled, s_suppkey AS k FROM supplier)"


@query("saved_runs", f"WITH {_RUNS_CTE} SELECT task_id, agent, skill_enabled, max(k) AS tests_total, max(k) * 10 AS total_tokens FROM runs GROUP BY ALL")
def saved_runs(spark, sf_dir):
    """Of the rows of one key the last one is kept."""
    path = _folder(spark, "runs")
    L.save_runs(_runs(spark, sf_dir), path)
    return spark.read.parquet(path).select("task_id", "agent", "skill_enabled", "tests_total", "total_tokens")


@query("loaded_runs", f"WITH {_RUNS_CTE} SELECT task_id, agent, skill_enabled, k AS tests_total, k * 10 AS total_tokens FROM runs WHERE k % 7 <> 0 AND k % 11 <> 0")
def loaded_runs(spark, sf_dir):
    """One JSON file a run; every seventh is cut off, every eleventh has a
    key too many."""
    path = _folder(spark, "run-files")
    json = L.to_json_lines(_runs(spark, sf_dir)).withColumn("k", F.get_json_object("json", "$.tests_total").cast("long"))
    cut, odd = F.expr("substring(json, 1, length(json) - 3)"), F.concat(F.lit('{"surprise": 1, '), F.expr("substring(json, 2)"))
    text = F.when(F.col("k") % 7 == 0, cut).when(F.col("k") % 11 == 0, odd).otherwise(F.col("json"))
    # a file a run: written by all tasks, and moved into place by them (not one after the other by the driver)
    runs = json.select(text.alias("value")).repartition(_parallelism(spark) * 2)
    runs.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return L.load_results(spark, path).select("task_id", "agent", "skill_enabled", "tests_total", "total_tokens")


@query(
    "json_lines",
    """SELECT '{"n":' || CAST(s_suppkey AS VARCHAR) || ',"name":"' || s_name || '","flag":' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS json FROM supplier""",
)
def json_lines(spark, sf_dir):
    """Rows as JSON documents."""
    s = table(spark, sf_dir, "supplier")
    return L.to_json_lines(s.select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("flag")))
