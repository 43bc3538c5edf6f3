"""Structured Streaming forms.

The batch operators are stateless projections or keyed aggregates, so the
streaming versions reuse them; state is bounded by watermarks.

* S1 session metrics over append-only event logs: session windows per
  ``session_id`` closed by the watermark (append mode). In a stream the
  file order is not defined, so wall clock uses event-time min/max.
  ``session_metrics_stateful`` keeps a session for good; ``expiring_sessions``
  lets it go when event time has passed it by.
* S2 doc-index TTL: ``dropDuplicatesWithinWatermark`` keeps the first entry
  per name inside the 168 h TTL.
* S3 text search / lint over newly landed files: the batch functions applied
  to a streaming ``files`` DataFrame (no global limit in a stream).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import search as S


def session_metrics_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """``events(session_id, event_time timestamp, type, role, usage_in,
    usage_out, top_in, top_out, tool_blocks)`` -> one row per closed session
    window."""
    turn = F.col("type").isin("assistant", "turn.completed")
    g = (
        events.withWatermark("event_time", watermark)
        .groupBy(F.session_window("event_time", gap).alias("w"), "session_id")
        .agg(
            (F.sum("usage_in") + F.sum(F.when(turn, F.col("top_in")).otherwise(0))).cast("long").alias("input_tokens"),
            (F.sum("usage_out") + F.sum(F.when(turn, F.col("top_out")).otherwise(0))).cast("long").alias("output_tokens"),
            F.count_if(turn).cast("long").alias("turn_count"),
            (F.count_if((F.col("type") == "tool_use") | (F.col("role") == "tool")) + F.sum("tool_blocks")).cast("long").alias("tool_calls"),
            F.min("event_time").alias("first_ts"),
            F.max("event_time").alias("last_ts"),
        )
    )
    return g.select(
        "session_id",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "turn_count",
        "tool_calls",
        ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)).alias("wall_clock_seconds"),
    )


def doc_index_ttl_stream(entries: DataFrame, ttl: str = "168 hours") -> DataFrame:
    """First cached entry per name within the TTL; older state expires
    with the watermark."""
    return entries.withWatermark("cached_at", ttl).dropDuplicatesWithinWatermark(["name"])


def search_stream(files: DataFrame, pattern: str, **kwargs) -> DataFrame:
    """S3: line matches of newly landed files (stateless); a per-file limit
    would need a window over the file and is refused."""
    if kwargs.get("per_file_limit") is not None:
        raise ValueError("per_file_limit is not available in a stream")
    return S.search_text(files, pattern, **kwargs)


def lint_stream(files: DataFrame, rules=None) -> DataFrame:
    """S3: rule findings for newly landed files (stateless ``mapInArrow``)."""
    from ..operators import structural as E

    return E.check_rules(files, rules)


_STATE_SCHEMA = "input_tokens long, output_tokens long, turn_count long, tool_calls long, first_ts string, last_ts string"
_OUT_SCHEMA = (
    "session_id string, input_tokens long, output_tokens long, total_tokens long, turn_count long, tool_calls long, "
    "first_ts string, last_ts string, wall_clock_seconds double"
)


def _session_state_update(key, pdfs, state):
    """Per session: fold each micro-batch (in line order) into running totals;
    the first timestamp seen stays first, the latest line's becomes last --
    the batch reader's file-order rule, kept across batches."""
    import pandas as pd

    (sid,) = key
    if state.exists:
        inp, out, turns, tools, first, last = state.get
    else:
        inp, out, turns, tools, first, last = 0, 0, 0, 0, None, None
    for pdf in pdfs:
        pdf = pdf.sort_values("line_no")
        is_turn = pdf["type"].isin(["assistant", "turn.completed"])
        inp += int(pdf["usage_in"].sum() + pdf.loc[is_turn, "top_in"].sum())
        out += int(pdf["usage_out"].sum() + pdf.loc[is_turn, "top_out"].sum())
        turns += int(is_turn.sum())
        tools += int(((pdf["type"] == "tool_use") | (pdf["role"] == "tool")).sum() + pdf["tool_blocks"].sum())
        ts = pdf["ts"].dropna()
        if len(ts):
            first = first if first is not None else ts.iloc[0]
            last = ts.iloc[-1]
    state.update((inp, out, turns, tools, first, last))
    wall = 0.0
    if first and last:
        t1 = pd.to_datetime(first, utc=True, errors="coerce")
        t2 = pd.to_datetime(last, utc=True, errors="coerce")
        if not (pd.isna(t1) or pd.isna(t2)):
            wall = (t2 - t1).total_seconds()
    yield pd.DataFrame(
        [{"session_id": sid, "input_tokens": inp, "output_tokens": out, "total_tokens": inp + out, "turn_count": turns,
          "tool_calls": tools, "first_ts": first, "last_ts": last, "wall_clock_seconds": wall}]
    )


def session_metrics_stateful(events: DataFrame) -> DataFrame:
    """S1, exact file-order semantics in a stream: ``applyInPandasWithState``
    keeps one small state row per session (running totals, first/last
    timestamp), output mode ``update``. ``events`` has the columns of
    ``accounting.parse_session_events`` (``session_id, line_no, type, role,
    ts, usage_in, usage_out, top_in, top_out, tool_blocks``)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("session_id").applyInPandasWithState(
        _session_state_update, _OUT_SCHEMA, _STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )


TOTALS_SCHEMA = "input_tokens long, output_tokens long, turn_count long, tool_calls long, first_line long, first_ts string, last_line long, last_ts string, until_ms long"
EXPIRED_SCHEMA = _OUT_SCHEMA


class _ExpiringSession(StatefulProcessor):
    """Running totals of a session, with one event-time timer at its end."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.totals.get()
        inp, out, turns, tools, first_line, first, last_line, last, until = held if held is not None else (0, 0, 0, 0, None, None, None, None, None)
        before = until
        for r in rows:
            turn = r.type in ("assistant", "turn.completed")
            inp += (r.usage_in or 0) + ((r.top_in or 0) if turn else 0)
            out += (r.usage_out or 0) + ((r.top_out or 0) if turn else 0)
            turns += turn
            tools += (r.type == "tool_use" or r.role == "tool") + (r.tool_blocks or 0)
            if r.ts is not None:  # by line number, in whatever order the rows come
                if first_line is None or r.line_no < first_line:
                    first_line, first = r.line_no, r.ts
                if last_line is None or r.line_no > last_line:
                    last_line, last = r.line_no, r.ts
            if r.event_time is not None:
                end = int(r.event_time.replace(tzinfo=r.event_time.tzinfo or datetime.timezone.utc).timestamp() * 1000) + self.gap_ms
                until = end if until is None else max(until, end)
        if until is None:  # no time at all: it ends a gap after what has been seen
            until = max(timerValues.getCurrentWatermarkInMs(), 0) + self.gap_ms
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.totals.update((inp, out, turns, tools, first_line, first, last_line, last, until))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        inp, out, turns, tools, _, first, _, last, _ = self.totals.get()
        self.totals.clear()
        yield Row(
            session_id=key[0], input_tokens=inp, output_tokens=out, total_tokens=inp + out, turn_count=turns, tool_calls=tools,
            first_ts=first, last_ts=last, wall_clock_seconds=_seconds(first, last),
        )

    def close(self) -> None:
        pass


def _seconds(first: str | None, last: str | None) -> float:
    import pandas as pd

    if not first or not last:
        return 0.0
    a, b = (pd.to_datetime(x, utc=True, errors="coerce") for x in (first, last))
    return 0.0 if pd.isna(a) or pd.isna(b) else (b - a).total_seconds()


def expiring_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """S1 with bounded state: one row a session, when the watermark has passed
    its last event by ``gap``; then its state is gone, and rows that come later
    begin a session anew. First and last timestamps go by line number, however
    the rows are cut into batches. ``events`` has the columns of
    ``accounting.parse_session_events`` and ``event_time``. Output mode
    ``append``; needs the RocksDB state store (:func:`use_rocksdb`)."""
    gap_ms = int(pd_timedelta(gap) * 1000)
    slim = events.select("session_id", "line_no", "type", "role", "ts", "usage_in", "usage_out", "top_in", "top_out", "tool_blocks", "event_time")
    keyed = slim.withWatermark("event_time", watermark).groupBy("session_id")
    return keyed.transformWithState(_ExpiringSession(gap_ms), EXPIRED_SCHEMA, "Append", "EventTime")


def pd_timedelta(span: str) -> float:
    import pandas as pd

    return pd.Timedelta(span).total_seconds()


def use_rocksdb(spark) -> None:
    """Timers need this state store; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
