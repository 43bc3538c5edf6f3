"""Token and cost accounting (K), run/session evaluation (L) and timing
statistics (M). All column expressions and aggregates; the only lookup
tables (model prices, task names) are fixed, tiny literals inlined as maps.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, word_tokens

# USD per 1M tokens (input, output) per model, and the default model.
MODEL_PRICING = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1": (2.00, 8.00),
    "claude-3.5-sonnet": (3.00, 15.00),
    "claude-3.7-sonnet": (3.00, 15.00),
    "claude-4-sonnet": (3.00, 15.00),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-2.5-flash": (0.15, 0.60),
}
DEFAULT_MODEL = "claude-3.5-sonnet"

# Evaluation task id -> (name, category, difficulty).
EVAL_TASKS = {
    "task_01_doc_lookup": ("Documentation Lookup", "Documentation", "Easy"),
    "task_02_error_handling": ("Error Handling", "Documentation", "Medium"),
    "task_03_class_usage": ("Class Usage", "Documentation", "Medium"),
    "task_04_file_analysis": ("File Analysis", "Understanding", "Easy"),
    "task_05_project_deps": ("Project Dependencies", "Understanding", "Hard"),
    "task_06_refactor": ("Refactor", "Code Generation", "Medium"),
    "task_07_debug_fix": ("Debug Fix", "Code Generation", "Easy"),
    "task_08_test_generation": ("Test Generation", "Code Generation", "Hard"),
    "task_09_api_integration": ("API Integration", "Cross-Module", "Hard"),
    "task_10_cross_module": ("Cross-Module Enhancement", "Cross-Module", "Medium"),
}


# ---------------------------------------------------------------------------
# K: tokens and cost
# ---------------------------------------------------------------------------


_EXACT_AVAILABLE: bool | None = None


def exact_tokenizer_available() -> bool:
    """Whether the cl100k_base encoding loads here (probed once on the driver;
    it needs a vocabulary file that may not be present offline)."""
    global _EXACT_AVAILABLE
    if _EXACT_AVAILABLE is None:
        try:
            import tiktoken

            tiktoken.get_encoding("cl100k_base")
            _EXACT_AVAILABLE = True
        except Exception:  # noqa: BLE001 - missing package, vocabulary or network
            _EXACT_AVAILABLE = False
    return _EXACT_AVAILABLE


def _exact_tokens_udf():
    import pandas as pd

    @F.pandas_udf("long")
    def exact(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding("cl100k_base")
        return pd.Series([0 if not t else len(enc.encode(t, disallowed_special=())) for t in texts], dtype="int64")

    return exact


def tokens(text: Column, method: str = "approximate") -> Column:
    """K1-K3: ``approximate`` (4 characters per token), ``word`` (0.75 words
    per token), ``tiktoken`` (exact cl100k_base counts in an Arrow-batched
    UDF; raises when the encoding cannot load) and ``auto`` (exact when
    available, else approximate)."""
    if method == "auto":
        method = "tiktoken" if exact_tokenizer_available() else "approximate"
    if method == "approximate":
        return approx_tokens(text)
    if method == "word":
        return word_tokens(text)
    if method == "tiktoken":
        if not exact_tokenizer_available():
            raise RuntimeError("tiktoken cl100k_base encoding is not available")
        return _exact_tokens_udf()(text)
    raise ValueError(f"unknown token method {method!r}")


def _rate_map(idx: int) -> Column:
    return F.create_map(*[x for m, r in MODEL_PRICING.items() for x in (F.lit(m), F.lit(r[idx]))])


def cost_usd(n_tokens: Column, model: Column | str = DEFAULT_MODEL, direction: Column | str = "input") -> Column:
    """K4: ``tokens * rate / 1e6``; unknown model -> default model's prices,
    unknown direction -> input price."""
    model = F.lit(model) if isinstance(model, str) else model
    direction = F.lit(direction) if isinstance(direction, str) else direction
    d_in, d_out = MODEL_PRICING[DEFAULT_MODEL]
    known = F.array_contains(F.map_keys(_rate_map(0)), model)
    rate_in = F.when(known, F.element_at(_rate_map(0), model)).otherwise(F.lit(d_in))
    rate_out = F.when(known, F.element_at(_rate_map(1), model)).otherwise(F.lit(d_out))
    rate = F.when(direction == "output", rate_out).otherwise(rate_in)
    return n_tokens.cast("double") * rate / F.lit(1_000_000.0)


def estimate(df: DataFrame, text_col: str, label: str | Column, scenario: Column, side: str, quality: int, model: str = DEFAULT_MODEL) -> DataFrame:
    """K5: one estimate row per input row."""
    t = approx_tokens(F.col(text_col))
    return df.select(
        scenario.alias("scenario"),
        F.lit(side).alias("side"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("text_length"),
        t.alias("tokens"),
        cost_usd(t, model).alias("cost_usd"),
        F.lit(quality).alias("info_quality"),
    )


def file_representations(analysis_with_text: DataFrame) -> DataFrame:
    """K6: per file three ``without`` / ``with`` estimates: raw text, AST dump
    and the structured record as JSON (``stack`` of three lengths).
    Needs ``text`` and ``ast_dump`` columns plus the analysis fields."""
    structured = F.to_json(F.struct("module_doc", "imports", "from_imports", "functions", "classes", "variables", "decorators_used"))
    rows = analysis_with_text.select(F.col("path").alias("scenario"), "text", "ast_dump", structured.alias("structured"))
    st = rows.selectExpr(
        "scenario",
        "stack(3, 'without', 'raw source', text, 4, 'without', 'ast dump', ast_dump, 2, 'with', 'structured', structured, 5) AS (side, label, body, info_quality)",
    )
    t = approx_tokens(F.col("body"))
    return st.select("scenario", "side", "label", F.length(F.coalesce("body", F.lit(""))).cast("long").alias("text_length"), t.alias("tokens"), cost_usd(t).alias("cost_usd"), "info_quality")


def compare(estimates: DataFrame, model: str = DEFAULT_MODEL, keys=("scenario",)) -> DataFrame:
    """K9: per scenario, best (minimum) tokens of each side, tokens saved,
    percent saved (0 when the base is 0) and dollars saved per 1k calls.
    ``keys`` may add attributes of the scenario carried along (e.g. a group
    for the rollup), avoiding a join back to the source."""
    g = estimates.groupBy(*keys).agg(
        F.min(F.when(F.col("side") == "without", F.col("tokens"))).cast("long").alias("best_without_tokens"),
        F.min(F.when(F.col("side") == "with", F.col("tokens"))).cast("long").alias("best_with_tokens"),
    )
    return savings(g, model, keys)


def compare_in_row(rows: DataFrame, without: list[Column], with_: list[Column], model: str = DEFAULT_MODEL, keys=("scenario",)) -> DataFrame:
    """K9 where all estimates of a scenario are columns of one row: the best of
    each side is a ``least``, so nothing is shuffled."""
    best = [F.least(*side) if len(side) > 1 else side[0] for side in (without, with_)]
    named = rows.select(*keys, best[0].cast("long").alias("best_without_tokens"), best[1].cast("long").alias("best_with_tokens"))
    return savings(named, model, keys)


def savings(g: DataFrame, model: str = DEFAULT_MODEL, keys=("scenario",)) -> DataFrame:
    """Tokens, percent and dollars saved from the best tokens of both sides."""
    saved = F.col("best_without_tokens") - F.col("best_with_tokens")
    return g.select(
        *keys,
        "best_without_tokens",
        "best_with_tokens",
        saved.alias("tokens_saved"),
        F.when(F.col("best_without_tokens") > 0, saved * 100.0 / F.col("best_without_tokens")).otherwise(F.lit(0.0)).alias("savings_pct"),
        cost_usd(saved * 1000, model).alias("cost_saved_per_1k"),
    )


def savings_rollup(comparisons: DataFrame, group: str = "scenario") -> DataFrame:
    """Per group plus a ``TOTAL`` row; percent = sum(saved)/sum(base)."""
    r = comparisons.rollup(group).agg(
        F.sum("best_without_tokens").cast("long").alias("base_tokens"),
        F.sum("best_with_tokens").cast("long").alias("with_tokens"),
        F.sum("tokens_saved").cast("long").alias("tokens_saved"),
        F.count("*").cast("long").alias("n"),
    )
    return r.select(
        F.coalesce(F.col(group).cast("string"), F.lit("TOTAL")).alias(group),
        "base_tokens",
        "with_tokens",
        "tokens_saved",
        "n",
        F.when(F.col("base_tokens") > 0, F.col("tokens_saved") * 100.0 / F.col("base_tokens")).otherwise(F.lit(0.0)).alias("savings_pct"),
    )


# ---------------------------------------------------------------------------
# L: sessions and runs
# ---------------------------------------------------------------------------

EVENT_SCHEMA = (
    "type string, role string, timestamp string, ts string, input_tokens long, output_tokens long, "
    "usage struct<input_tokens:long,output_tokens:long>"
)


def parse_session_events(raw: DataFrame) -> DataFrame:
    """``raw(session_id, line_no, value)`` JSONL lines -> typed events.
    Blank and malformed lines are dropped; ``content`` blocks are parsed
    separately so a string ``content`` counts zero blocks."""
    v = F.trim(F.col("value"))
    j = F.from_json(v, EVENT_SCHEMA)
    blocks = F.from_json(F.get_json_object(v, "$.content"), "array<struct<type:string>>")
    ok = (v != "") & F.expr("try_parse_json(trim(value)) IS NOT NULL") & F.startswith(v, F.lit("{"))
    return raw.where(ok).select(
        "session_id",
        "line_no",
        F.coalesce(j["type"], F.lit("")).alias("type"),
        j["role"].alias("role"),
        F.coalesce(F.when(j["timestamp"] != "", j["timestamp"]), F.when(j["ts"] != "", j["ts"])).alias("ts"),
        F.coalesce(j["usage"]["input_tokens"], F.lit(0)).alias("usage_in"),
        F.coalesce(j["usage"]["output_tokens"], F.lit(0)).alias("usage_out"),
        F.coalesce(j["input_tokens"], F.lit(0)).alias("top_in"),
        F.coalesce(j["output_tokens"], F.lit(0)).alias("top_out"),
        F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "tool_use")), F.lit(0)).alias("tool_blocks"),
    )


def session_metrics(events: DataFrame) -> DataFrame:
    """L1: per session input/output/total tokens, turns, tool calls and wall
    clock (last minus first timestamp in line order). One partial
    aggregation per session; ``min_by``/``max_by`` keep file order."""
    turn = F.col("type").isin("assistant", "turn.completed")
    g = events.groupBy("session_id").agg(
        (F.sum("usage_in") + F.sum(F.when(turn, F.col("top_in")).otherwise(0))).cast("long").alias("input_tokens"),
        (F.sum("usage_out") + F.sum(F.when(turn, F.col("top_out")).otherwise(0))).cast("long").alias("output_tokens"),
        F.count_if(turn).cast("long").alias("turn_count"),
        (F.count_if((F.col("type") == "tool_use") | (F.col("role") == "tool")) + F.sum("tool_blocks")).cast("long").alias("tool_calls"),
        F.min_by(F.col("ts"), F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("first_ts"),
        F.max_by(F.col("ts"), F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last_ts"),
    )
    t1 = F.expr("try_cast(first_ts AS timestamp)")
    t2 = F.expr("try_cast(last_ts AS timestamp)")
    wall = F.when(t1.isNotNull() & t2.isNotNull(), (F.unix_micros(t2) - F.unix_micros(t1)) / F.lit(1e6)).otherwise(F.lit(0.0))
    return g.select(
        "session_id",
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "turn_count",
        "tool_calls",
        wall.alias("wall_clock_seconds"),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Conversation turns as session events: ``assistant`` turns are turn
    events whose approximate tokens count as output; other roles' tokens are
    input usage; a ``tool`` role counts as a tool call."""
    t = approx_tokens(F.col("text"))
    is_asst = F.col("role") == "assistant"
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("line_no"),
        F.col("role").alias("type"),
        F.col("role").alias("role"),
        F.lit(None).cast("string").alias("ts"),
        F.when(is_asst, F.lit(0)).otherwise(t).cast("long").alias("usage_in"),
        F.lit(0).cast("long").alias("usage_out"),
        F.lit(0).cast("long").alias("top_in"),
        F.when(is_asst, t).otherwise(F.lit(0)).cast("long").alias("top_out"),
        F.lit(0).alias("tool_blocks"),
    )


def conversation_metrics(conversations: DataFrame) -> DataFrame:
    """L1 over conversation tables."""
    return session_metrics(conversation_events(conversations))


def record_run(runs: DataFrame) -> DataFrame:
    """L2: ``accuracy_pct = passed/total*100`` (0 when total is 0) and
    ``total_tokens = input + output``."""
    return runs.withColumn(
        "accuracy_pct",
        F.when(F.col("tests_total") > 0, F.col("tests_passed") * 100.0 / F.col("tests_total")).otherwise(F.lit(0.0)),
    ).withColumn("total_tokens", (F.col("input_tokens") + F.col("output_tokens")).cast("long"))


RUN_METRICS = ["tests_total", "tests_passed", "accuracy_pct", "input_tokens", "output_tokens", "total_tokens", "wall_clock_seconds", "turn_count", "tool_calls"]


def latest_runs(runs: DataFrame, order_col: str = "filename") -> DataFrame:
    """L3 first half: the last run (by ``order_col``) per (task, agent, flag)."""
    cols = [c for c in runs.columns if c not in ("task_id", "agent", "skill_enabled")]
    g = runs.groupBy("task_id", "agent", "skill_enabled").agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("r"))
    return g.select("task_id", "agent", "skill_enabled", "r.*")


def run_pairs(runs: DataFrame, order_col: str = "filename") -> DataFrame:
    """L3 + L4: pairs of latest with/without runs per (task, agent) and their
    comparison. Percentages are kept unrounded; ``*_r1`` columns round half
    to even on the decimal value (``bround``)."""
    # one aggregation per (task, agent): the latest run of each side via a
    # conditional max_by (NULL ordering values are skipped), no self-join
    metrics = F.struct(*RUN_METRICS)
    g = runs.groupBy("task_id", "agent").agg(
        F.max_by(metrics, F.when(F.col("skill_enabled"), F.col(order_col))).alias("w"),
        F.max_by(metrics, F.when(~F.col("skill_enabled"), F.col(order_col))).alias("o"),
        F.count_if(F.col("skill_enabled")).alias("_nw"),
        F.count_if(~F.col("skill_enabled")).alias("_no"),
    ).where((F.col("_nw") > 0) & (F.col("_no") > 0))
    p = g.select("task_id", "agent", *[F.col("w." + c).alias("w_" + c) for c in RUN_METRICS], *[F.col("o." + c).alias("o_" + c) for c in RUN_METRICS])
    tok = F.when(F.col("o_total_tokens") > 0, (F.col("o_total_tokens") - F.col("w_total_tokens")) * 100.0 / F.col("o_total_tokens")).otherwise(F.lit(0.0))
    spd = F.when(
        F.col("o_wall_clock_seconds") > 0, (F.col("o_wall_clock_seconds") - F.col("w_wall_clock_seconds")) * 100.0 / F.col("o_wall_clock_seconds")
    ).otherwise(F.lit(0.0))
    acc = F.col("w_accuracy_pct") - F.col("o_accuracy_pct")
    return p.select(
        "task_id",
        "agent",
        acc.alias("accuracy_improvement"),
        tok.alias("token_savings_pct"),
        spd.alias("speed_improvement_pct"),
        (F.col("o_tool_calls") - F.col("w_tool_calls")).cast("long").alias("tool_call_reduction"),
        (F.col("o_turn_count") - F.col("w_turn_count")).cast("long").alias("turn_reduction"),
        F.bround(acc, 1).alias("accuracy_improvement_r1"),
        F.bround(tok, 1).alias("token_savings_pct_r1"),
        F.bround(spd, 1).alias("speed_improvement_pct_r1"),
    )


def task_dimension(spark: SparkSession) -> DataFrame:
    """The ten evaluation tasks (fixed, 10 rows)."""
    rows = [(k, *v) for k, v in EVAL_TASKS.items()]
    return spark.createDataFrame(rows, "task_id string, task_name string, category string, difficulty string")


def task_label(task_id: Column) -> Column:
    """L6 as a literal map lookup; unknown ids label themselves."""
    m = F.create_map(*[x for k, v in EVAL_TASKS.items() for x in (F.lit(k), F.lit(v[0]))])
    return F.coalesce(F.element_at(m, task_id), task_id)


def agent_averages(pairs: DataFrame) -> DataFrame:
    """Per agent averages over its task comparisons."""
    return pairs.groupBy("agent").agg(
        F.count("*").cast("long").alias("n_tasks"),
        F.avg("accuracy_improvement").alias("avg_accuracy_improvement"),
        F.avg("token_savings_pct").alias("avg_token_savings_pct"),
        F.avg("speed_improvement_pct").alias("avg_speed_improvement_pct"),
        F.avg("tool_call_reduction").alias("avg_tool_call_reduction"),
        F.avg("turn_reduction").alias("avg_turn_reduction"),
    )


# ---------------------------------------------------------------------------
# M: timing statistics
# ---------------------------------------------------------------------------


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(*keys, median)``, exact, with bounded state however large a group is.

    Each group is cut at 63 approximate quantiles; the counts of its ranges say
    which range holds the middle ranks, and only the distinct values of that
    range, with their counts, are put in order. Nulls are left out, as by
    ``median``; null keys are a group of their own."""
    r = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias("_v"))
    shares = [F.lit(i / 64) for i in range(1, 64)]
    cuts = r.groupBy("_g").agg(F.percentile_approx("_v", F.array(*shares), F.lit(1000)).alias("_cuts"))
    placed = r.groupBy("_g", "_v").agg(F.count("*").alias("_n")).join(cuts, "_g")
    placed = placed.select("_g", "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
    ranges = placed.groupBy("_g", "_b").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy("_g")
    seen = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select("_g", "_b", (F.sum("_m").over(seen) - F.col("_m")).alias("_before"), "_m", F.sum("_m").over(group).alias("_all"))
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = ranges.where((F.col("_before") < upper) & (F.col("_before") + F.col("_m") >= lower)).select("_g", "_b", "_before", "_all")
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_n").over(inside)
    ranked = placed.join(middle, ["_g", "_b"]).select("_g", "_v", "_all", "_n", upto.alias("_upto"))
    hit = ranked.where((F.col("_upto") - F.col("_n") < upper) & (F.col("_upto") >= lower))
    return hit.groupBy("_g").agg(((F.min("_v") + F.max("_v")) / 2).alias("median")).select("_g.*", "median")


def timing_summary(timings: DataFrame, keys=("suite", "name"), value: str = "ms", peak: str | None = "peak_kb") -> DataFrame:
    """M1: per key mean, median, min, max, sample stdev (0 for one value),
    rounded to 3 places; peak rounded to 1. The median is :func:`exact_median`."""
    v = F.col(value)
    aggs = [
        F.count("*").cast("long").alias("iterations"),
        F.round(F.avg(v), 3).alias("mean_ms"),
        F.round(F.min(v), 3).alias("min_ms"),
        F.round(F.max(v), 3).alias("max_ms"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 3).alias("std_dev_ms"),
    ]
    if peak:
        aggs.append(F.round(F.max(peak), 1).alias("memory_peak_kb"))
    summary = timings.groupBy(*keys).agg(*aggs)
    names = list(keys)
    medians = exact_median(timings, names, value).select(*[F.col(k).alias(f"_{k}") for k in names], F.round("median", 3).alias("median_ms"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names])
    order = [*names, "iterations", "mean_ms", "median_ms", *[c for c in summary.columns if c not in (*names, "iterations", "mean_ms")]]
    return summary.join(medians, same, "left").select(*order)


def speedups(summary: DataFrame, baseline: str, key: str = "suite", name: str = "name") -> DataFrame:
    """M2: ``median(other) / median(baseline)`` within each key, only where
    the baseline median is positive."""
    # the summary has one row per (key, name): a window over it replaces a
    # self-join that would aggregate the raw timings twice
    w = Window.partitionBy(key)
    s = summary.withColumn("base_median", F.max(F.when(F.col(name) == baseline, F.col("median_ms"))).over(w))
    return s.where((F.col(name) != baseline) & (F.col("base_median") > 0)).select(
        key, F.col(name).alias("name"), (F.col("median_ms") / F.col("base_median")).alias("speedup")
    )


def threshold_guard(summary: DataFrame, thresholds: DataFrame, name: str = "name") -> DataFrame:
    """M3: summary rows whose median exceeds their limit. ``thresholds`` is a
    small fixed table (name, limit_ms); broadcast it."""
    return summary.join(F.broadcast(thresholds), name).where(F.col("median_ms") > F.col("limit_ms"))


def project_representations(files: DataFrame, project_json: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """K7: per project, all source text joined by newlines (``without``) vs
    the structured project report as JSON (``with``). ``project_json`` has
    ``(project, json)``. Lengths are summed, never concatenated."""
    raw = files.groupBy("project").agg((F.sum(F.length("text")) + F.count("*") - 1).cast("long").alias("text_length"))
    n = F.col("text_length")
    tok = F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / 4).cast("long")))
    without = raw.select(F.col("project").alias("scenario"), F.lit("without").alias("side"), F.lit("all source text").alias("label"), "text_length", tok.alias("tokens"))
    w = project_json.select(F.col("project").alias("scenario"), F.lit("with").alias("side"), F.lit("project analysis").alias("label"), F.length("json").cast("long").alias("text_length"), approx_tokens(F.col("json")).alias("tokens"))
    return without.unionByName(w).withColumn("cost_usd", cost_usd(F.col("tokens"), model)).withColumn(
        "info_quality", F.when(F.col("side") == "with", F.lit(4)).otherwise(F.lit(5))
    )


def doc_representations(docs: DataFrame, budget_docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """K8: per documented name, the full docstring with its signature
    (``without``) vs the budget-projected structured record as JSON (``with``)."""
    full = docs.select(F.col("name").alias("scenario"), F.concat_ws("\n", F.coalesce("signature", F.lit("")), F.coalesce("docstring", F.lit(""))).alias("body"))
    rec = budget_docs.select(F.col("name").alias("scenario"), F.to_json(F.struct(*budget_docs.columns)).alias("body"))
    a = full.select("scenario", F.lit("without").alias("side"), F.lit("full docstring").alias("label"), "body", F.lit(3).alias("info_quality"))
    b = rec.select("scenario", F.lit("with").alias("side"), F.lit("structured record").alias("label"), "body", F.lit(5).alias("info_quality"))
    t = approx_tokens(F.col("body"))
    return a.unionByName(b).select("scenario", "side", "label", F.length("body").cast("long").alias("text_length"), t.alias("tokens"), cost_usd(t, model).alias("cost_usd"), "info_quality")
