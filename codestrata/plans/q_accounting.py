"""Registered accounting, evaluation and timing queries (K, L, M)."""

from pyspark.sql import functions as F

from ..operators import accounting as A
from ..sources.tables import table
from .registry import query
from .sql_common import with_

_MODELS = list(A.MODEL_PRICING) + ["unknown-model"]
_MODELS_SQL = ", ".join(f"'{m}'" for m in _MODELS)
_PRICES_SQL = ", ".join(f"('{m}', {r[0]}, {r[1]})" for m, r in A.MODEL_PRICING.items())
_TASKS = list(A.EVAL_TASKS)
_TASKS_SQL = ", ".join(f"'{t}'" for t in _TASKS)
_AGENTS = ["claude_code", "codex", "gemini_cli"]
_AGENTS_SQL = ", ".join(f"'{a}'" for a in _AGENTS)

APPROX_SQL = "CASE WHEN length(coalesce({t}, '')) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END"
WORD_SQL = "CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, CAST(floor(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) / 0.75) AS BIGINT)) END"


def _approx(t):
    return APPROX_SQL.format(t=t)


@query("tokens_approx", f"SELECT doc_id, CAST({_approx('text')} AS BIGINT) AS tokens FROM documents")
def tokens_approx(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", A.tokens(F.col("text")).alias("tokens"))


@query("tokens_word", f"SELECT doc_id, CAST({WORD_SQL.format(t='text')} AS BIGINT) AS tokens FROM documents")
def tokens_word(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", A.tokens(F.col("text"), "word").alias("tokens"))


@query(
    "cost",
    f"""WITH pricing(model, input, output) AS (VALUES {_PRICES_SQL}),
        d AS (SELECT doc_id, CAST({_approx('text')} AS BIGINT) AS tokens, ([{_MODELS_SQL}])[doc_id % 9 + 1] AS model,
                     (['input', 'output', 'cache'])[doc_id % 3 + 1] AS direction FROM documents)
        SELECT doc_id, d.model, direction, tokens,
               round(tokens * CASE WHEN direction = 'output' THEN coalesce(p.output, 15.0) ELSE coalesce(p.input, 3.0) END / 1000000.0, 9) AS cost_usd
        FROM d LEFT JOIN pricing p ON p.model = d.model""",
)
def cost(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("doc_id") % 9 + 1).cast("int"))
    direction = F.element_at(F.array(F.lit("input"), F.lit("output"), F.lit("cache")), (F.col("doc_id") % 3 + 1).cast("int"))
    t = A.tokens(F.col("text"))
    return d.select(
        "doc_id", model.alias("model"), direction.alias("direction"), t.alias("tokens"), F.round(A.cost_usd(t, model, direction), 9).alias("cost_usd")
    )


def _doc_comparison(spark, sf_dir, keys):
    """Raw text and word count without the skill; with it the structured record
    and the outline (first word of every line), all from one scan and one row."""
    d = table(spark, sf_dir, "documents").withColumn("scenario", F.col("doc_id").cast("string"))
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n", -1)
    record = F.concat(
        F.lit('{"doc_id": '), F.col("scenario"), F.lit(', "lang": "'), F.coalesce("lang", F.lit("")), F.lit('", "source": "'), F.coalesce("source", F.lit("")),
        F.lit('", "characters": '), F.length(t).cast("string"), F.lit(', "lines": '), F.size(lines).cast("string"), F.lit("}"),
    )
    outline = F.array_join(F.transform(lines, lambda x: F.substring_index(x, " ", 1)), "\n")
    return A.compare_in_row(d, [A.tokens(F.col("text")), A.tokens(F.col("text"), "word")], [A.tokens(record), A.tokens(outline)], keys=keys)


_SAVINGS_CTE = f"""
rec AS (
  SELECT doc_id, '{{"doc_id": ' || CAST(doc_id AS VARCHAR) || ', "lang": "' || coalesce(lang, '') || '", "source": "' || coalesce(source, '')
         || '", "characters": ' || CAST(length(coalesce(text, '')) AS VARCHAR) || ', "lines": ' || CAST(len(string_split(coalesce(text, ''), chr(10))) AS VARCHAR) || '}}' AS record,
         array_to_string([split_part(x, ' ', 1) for x in string_split(coalesce(text, ''), chr(10))], chr(10)) AS outline
  FROM documents),
est AS (
  SELECT CAST(doc_id AS VARCHAR) AS scenario, 'without' AS side, {_approx('text')} AS tokens FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'without', {WORD_SQL.format(t='text')} FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'with', {_approx("record")} FROM rec
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'with', {_approx("outline")} FROM rec),
cmp AS (
  SELECT scenario, CAST(min(tokens) FILTER (WHERE side = 'without') AS BIGINT) AS best_without_tokens,
         CAST(min(tokens) FILTER (WHERE side = 'with') AS BIGINT) AS best_with_tokens
  FROM est GROUP BY scenario)
"""


@query(
    "token_savings",
    with_(_SAVINGS_CTE)
    + """SELECT scenario, best_without_tokens, best_with_tokens, best_without_tokens - best_with_tokens AS tokens_saved,
              round(CASE WHEN best_without_tokens > 0 THEN (best_without_tokens - best_with_tokens) * 100.0 / best_without_tokens ELSE 0.0 END, 6) AS savings_pct,
              round((best_without_tokens - best_with_tokens) * 1000 * 3.0 / 1000000.0, 9) AS cost_saved_per_1k
         FROM cmp""",
)
def token_savings(spark, sf_dir):
    c = _doc_comparison(spark, sf_dir, ("scenario",))
    return c.withColumn("savings_pct", F.round("savings_pct", 6)).withColumn("cost_saved_per_1k", F.round("cost_saved_per_1k", 9))


@query(
    "token_total_rollup",
    with_(_SAVINGS_CTE)
    + """, j AS (SELECT d.lang, c.* FROM cmp c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.scenario)
         SELECT coalesce(lang, 'TOTAL') AS lang, CAST(sum(best_without_tokens) AS BIGINT) AS base_tokens,
                CAST(sum(best_with_tokens) AS BIGINT) AS with_tokens,
                CAST(sum(best_without_tokens - best_with_tokens) AS BIGINT) AS tokens_saved, CAST(count(*) AS BIGINT) AS n,
                round(CASE WHEN sum(best_without_tokens) > 0 THEN sum(best_without_tokens - best_with_tokens) * 100.0 / sum(best_without_tokens) ELSE 0.0 END, 6) AS savings_pct
         FROM j GROUP BY ROLLUP (lang)""",
)
def token_total_rollup(spark, sf_dir):
    c = _doc_comparison(spark, sf_dir, ("scenario", "lang"))
    return A.savings_rollup(c, "lang").withColumn("savings_pct", F.round("savings_pct", 6))


@query(
    "session_metrics",
    f"""SELECT CAST(conv_id AS VARCHAR) AS session_id,
              CAST(sum(CASE WHEN role <> 'assistant' THEN {_approx('text')} ELSE 0 END) AS BIGINT) AS input_tokens,
              CAST(sum(CASE WHEN role = 'assistant' THEN {_approx('text')} ELSE 0 END) AS BIGINT) AS output_tokens,
              CAST(sum({_approx('text')}) AS BIGINT) AS total_tokens,
              CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS turn_count,
              CAST(count(*) FILTER (WHERE role = 'tool') AS BIGINT) AS tool_calls,
              CAST(0.0 AS DOUBLE) AS wall_clock_seconds
         FROM conversations GROUP BY conv_id""",
)
def session_metrics(spark, sf_dir):
    return A.conversation_metrics(table(spark, sf_dir, "conversations"))


def runs_from_events(spark, sf_dir):
    """Evaluation runs derived from ``events`` (one run per event)."""
    e = table(spark, sf_dir, "events")
    task = F.element_at(F.array(*[F.lit(t) for t in _TASKS]), (F.col("user_id") % 10 + 1).cast("int"))
    agent = F.element_at(F.array(*[F.lit(a) for a in _AGENTS]), (F.col("event_id") % 3 + 1).cast("int"))
    runs = e.select(
        task.alias("task_id"),
        agent.alias("agent"),
        (F.col("event_id") % 2 == 0).alias("skill_enabled"),
        F.col("event_id").alias("filename"),
        (F.col("event_id") % 5).cast("long").alias("tests_total"),
        F.least(F.col("event_id") % 5, F.col("user_id") % 4).cast("long").alias("tests_passed"),
        (F.col("event_id") % 1000 * 10).cast("long").alias("input_tokens"),
        (F.col("user_id") * 7 % 500).cast("long").alias("output_tokens"),
        F.col("value").alias("wall_clock_seconds"),
        (F.col("event_id") % 13).cast("long").alias("turn_count"),
        (F.col("event_id") % 7).cast("long").alias("tool_calls"),
    )
    return A.record_run(runs)


_RUNS_CTE = f"""
runs AS (
  SELECT ([{_TASKS_SQL}])[user_id % 10 + 1] AS task_id, ([{_AGENTS_SQL}])[event_id % 3 + 1] AS agent,
         event_id % 2 = 0 AS skill_enabled, event_id AS filename,
         event_id % 5 AS tests_total, least(event_id % 5, user_id % 4) AS tests_passed,
         CASE WHEN event_id % 5 > 0 THEN least(event_id % 5, user_id % 4) * 100.0 / (event_id % 5) ELSE 0.0 END AS accuracy_pct,
         event_id % 1000 * 10 + user_id * 7 % 500 AS total_tokens, value AS wall_clock_seconds,
         event_id % 13 AS turn_count, event_id % 7 AS tool_calls FROM events),
last AS (
  SELECT task_id, agent, skill_enabled, arg_max(accuracy_pct, filename) AS acc, arg_max(total_tokens, filename) AS tok,
         arg_max(wall_clock_seconds, filename) AS wall, arg_max(turn_count, filename) AS turns, arg_max(tool_calls, filename) AS tools
  FROM runs GROUP BY ALL),
pairs AS (
  SELECT w.task_id, w.agent, w.acc - o.acc AS accuracy_improvement,
         CASE WHEN o.tok > 0 THEN (o.tok - w.tok) * 100.0 / o.tok ELSE 0.0 END AS token_savings_pct,
         CASE WHEN o.wall > 0 THEN (o.wall - w.wall) * 100.0 / o.wall ELSE 0.0 END AS speed_improvement_pct,
         CAST(o.tools - w.tools AS BIGINT) AS tool_call_reduction, CAST(o.turns - w.turns AS BIGINT) AS turn_reduction
  FROM last w JOIN last o ON w.task_id = o.task_id AND w.agent = o.agent AND w.skill_enabled AND NOT o.skill_enabled)
"""


@query(
    "run_pairs",
    with_(_RUNS_CTE)
    + """SELECT task_id, agent, round(accuracy_improvement, 6) AS accuracy_improvement, round(token_savings_pct, 6) AS token_savings_pct,
              round(speed_improvement_pct, 6) AS speed_improvement_pct, tool_call_reduction, turn_reduction FROM pairs""",
)
def run_pairs(spark, sf_dir):
    p = A.run_pairs(runs_from_events(spark, sf_dir))
    return p.select(
        "task_id", "agent", *[F.round(c, 6).alias(c) for c in ("accuracy_improvement", "token_savings_pct", "speed_improvement_pct")],
        "tool_call_reduction", "turn_reduction",
    )


@query(
    "agent_averages",
    with_(_RUNS_CTE)
    + """SELECT agent, CAST(count(*) AS BIGINT) AS n_tasks, round(avg(accuracy_improvement), 6) AS avg_accuracy_improvement,
              round(avg(token_savings_pct), 6) AS avg_token_savings_pct, round(avg(speed_improvement_pct), 6) AS avg_speed_improvement_pct,
              round(avg(tool_call_reduction), 6) AS avg_tool_call_reduction, round(avg(turn_reduction), 6) AS avg_turn_reduction
         FROM pairs GROUP BY agent""",
)
def agent_averages(spark, sf_dir):
    a = A.agent_averages(A.run_pairs(runs_from_events(spark, sf_dir)))
    return a.select("agent", "n_tasks", *[F.round(c, 6).alias(c) for c in a.columns[2:]])


def timings_from_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("suite"),
        F.col("event_type").alias("name"),
        F.col("value").alias("ms"),
        (F.col("value") * 10).alias("peak_kb"),
    )


_TIMING_CTE = """
tim AS (
  SELECT 'u' || CAST(user_id % 4 AS VARCHAR) AS suite, event_type AS name, CAST(count(*) AS BIGINT) AS iterations,
         round(avg(value), 3) AS mean_ms, round(median(value), 3) AS median_ms, round(min(value), 3) AS min_ms,
         round(max(value), 3) AS max_ms, round(coalesce(stddev_samp(value), 0.0), 3) AS std_dev_ms,
         round(max(value * 10), 1) AS memory_peak_kb
  FROM events GROUP BY ALL)
"""


@query("timing_summary", with_(_TIMING_CTE) + "SELECT * FROM tim")
def timing_summary(spark, sf_dir):
    return A.timing_summary(timings_from_events(spark, sf_dir))


@query(
    "speedups",
    with_(_TIMING_CTE)
    + """SELECT o.suite, o.name, round(o.median_ms / b.median_ms, 6) AS speedup
         FROM tim o JOIN tim b ON o.suite = b.suite AND b.name = 'view' AND o.name <> 'view' WHERE b.median_ms > 0""",
)
def speedups(spark, sf_dir):
    s = A.speedups(A.timing_summary(timings_from_events(spark, sf_dir)), "view")
    return s.withColumn("speedup", F.round("speedup", 6))


_LIMITS = [("view", 20.0), ("click", 25.0), ("error", 10.0), ("signup", 30.0), ("purchase", 15.0)]


@query(
    "threshold_guard",
    with_(_TIMING_CTE)
    + "SELECT t.suite, t.name, t.median_ms, l.limit_ms FROM tim t JOIN (VALUES "
    + ", ".join(f"('{n}', CAST({v} AS DOUBLE))" for n, v in _LIMITS)
    + ") l(name, limit_ms) ON t.name = l.name WHERE t.median_ms > l.limit_ms",
)
def threshold_guard(spark, sf_dir):
    limits = spark.createDataFrame(_LIMITS, "name string, limit_ms double")
    g = A.threshold_guard(A.timing_summary(timings_from_events(spark, sf_dir)), limits)
    return g.select("suite", "name", "median_ms", "limit_ms")


@query(
    "run_pairs_rounded",
    with_(_RUNS_CTE)
    + """SELECT task_id, agent, round_even(accuracy_improvement, 1) AS accuracy_improvement_r1,
              round_even(token_savings_pct, 1) AS token_savings_pct_r1, round_even(speed_improvement_pct, 1) AS speed_improvement_pct_r1 FROM pairs""",
)
def run_pairs_rounded(spark, sf_dir):
    p = A.run_pairs(runs_from_events(spark, sf_dir))
    return p.select("task_id", "agent", "accuracy_improvement_r1", "token_savings_pct_r1", "speed_improvement_pct_r1")


_TASK_ROWS = ", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}')" for k, v in A.EVAL_TASKS.items())


@query(
    "task_labels",
    with_(_RUNS_CTE)
    + f""", tasks(task_id, task_name, category, difficulty) AS (VALUES {_TASK_ROWS})
         SELECT p.task_id, p.agent, coalesce(t.task_name, p.task_id) AS task_name, t.category, t.difficulty
         FROM pairs p LEFT JOIN tasks t USING (task_id)""",
)
def task_labels(spark, sf_dir):
    p = A.run_pairs(runs_from_events(spark, sf_dir))
    t = A.task_dimension(spark)
    return p.join(F.broadcast(t), "task_id", "left").select(
        "task_id", "agent", F.coalesce(A.task_label(F.col("task_id")), F.col("task_id")).alias("task_name"), "category", "difficulty"
    )


@query(
    "project_text_tokens",
    """SELECT source AS scenario, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS text_length,
              CAST(CASE WHEN sum(length(text)) + count(*) - 1 <= 0 THEN 0 ELSE greatest(1, (sum(length(text)) + count(*) - 1) // 4) END AS BIGINT) AS tokens
       FROM documents GROUP BY source""",
)
def project_text_tokens(spark, sf_dir):
    """K7 ``without`` side: all text of a project joined by newlines (lengths
    summed, never concatenated) and its token estimate; the ``with`` side is
    the JSON report, compared by ``compare``."""
    from ..sources.tables import document_files

    f = document_files(spark, sf_dir)
    empty = spark.createDataFrame([], "project string, json string")
    r = A.project_representations(f, empty)
    return r.where(F.col("side") == "without").select("scenario", "text_length", "tokens")
