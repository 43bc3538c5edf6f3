"""Log and result-file ingestion.

Every reader returns a DataFrame; malformed lines become NULL structs under
``from_json`` and are filtered out, never raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RG_EVENT_SCHEMA = (
    "type string, data struct<path:struct<text:string>,line_number:long,lines:struct<text:string>,"
    "submatches:array<struct<match:struct<text:string>,start:long,end:long>>>"
)


def parse_search_events(raw: DataFrame) -> DataFrame:
    """A4: search-tool JSON event lines -> matches ``(path, line, text,
    submatches)``; only ``match`` events, trailing newline stripped."""
    j = F.from_json(F.col("value"), RG_EVENT_SCHEMA)
    m = raw.select(j.alias("e")).where(F.col("e.type") == "match")
    return m.select(
        F.col("e.data.path.text").alias("path"),
        F.col("e.data.line_number").alias("line"),
        F.regexp_replace(F.col("e.data.lines.text"), r"\r?\n$", "").alias("text"),
        F.transform("e.data.submatches", lambda s: F.struct(s["match"]["text"].alias("match"), s["start"].alias("start"), s["end"].alias("end"))).alias("submatches"),
    )


def numbered_lines(files: DataFrame) -> DataFrame:
    """A8 helper: ``files(project, path, text)`` -> ``(session_id, line_no,
    value)`` with the file stem as session id (``spark.read.text`` has no line
    numbers, which first/last-in-file-order rules need)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("session_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def free_text_sessions(files: DataFrame) -> DataFrame:
    """Free-text logs grouped by conversation (``project``): turns =
    occurrences of ``ASSISTANT:`` plus ``assistant``; tokens from the summed
    length (approximate, not a sum of per-file floors)."""
    per = files.select(
        F.col("project").alias("session_id"),
        (F.regexp_count("text", F.lit("ASSISTANT:")) + F.regexp_count("text", F.lit("assistant"))).alias("turns"),
        F.length("text").alias("n"),
    )
    g = per.groupBy("session_id").agg(F.sum("turns").cast("long").alias("turn_count"), F.sum("n").alias("chars"))
    return g.select("session_id", "turn_count", F.when(F.col("chars") > 0, F.greatest(F.lit(1), F.floor(F.col("chars") / 4))).otherwise(0).cast("long").alias("total_tokens"))


def generic_sessions(files: DataFrame) -> DataFrame:
    """A10: any log: tokens only, session id = file stem."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    g = files.groupBy(stem.alias("session_id")).agg(F.sum(F.length("text")).alias("chars"))
    return g.select("session_id", F.when(F.col("chars") > 0, F.greatest(F.lit(1), F.floor(F.col("chars") / 4))).otherwise(0).cast("long").alias("total_tokens"))


RUN_SCHEMA = (
    "task_id string, agent string, skill_enabled boolean, tests_total long, tests_passed long, accuracy_pct double, "
    "input_tokens long, output_tokens long, total_tokens long, wall_clock_seconds double, turn_count long, tool_calls long, "
    "retry_count long, estimated_cost_usd double, model string, session_id string, timestamp string, notes string"
)
RUN_KEYS = [f.split()[0] for f in RUN_SCHEMA.split(", ")]


def load_results(spark: SparkSession, directory: str) -> DataFrame:
    """One run per JSON file (whole text); invalid JSON, missing required
    keys or unknown keys drop the file. ``filename`` orders runs."""
    raw = spark.read.option("wholetext", True).text(directory).select(F.col("value"), F.input_file_name().alias("filename"))
    keys = F.expr("json_object_keys(value)")
    ok = F.expr("try_parse_json(value) IS NOT NULL") & F.forall(keys, lambda k: k.isin(*RUN_KEYS))
    parsed = raw.where(ok).select("filename", F.from_json("value", RUN_SCHEMA).alias("r")).select("filename", "r.*")
    return parsed.where(F.col("task_id").isNotNull() & F.col("agent").isNotNull() & F.col("skill_enabled").isNotNull())


def save_runs(runs: DataFrame, directory: str) -> None:
    """Last write wins per (task, agent, flag), also among the rows of
    ``runs``, by their order: dynamic partition overwrite of exactly the
    partitions present in ``runs``, stamped with the UTC write time."""
    keys = ["task_id", "agent", "skill_enabled"]
    rows = runs.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("at"))
    runs = rows.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(F.max_by("r", "at").alias("r")).select("r.*")
    stamped = runs.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id", "agent", "skill_enabled").parquet(directory)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON document (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
