"""Secret scan by one combined deterministic automaton (operator 4).

All rules are compiled together (subset construction, minimisation) into one
transition array; a single byte pass over the concatenated texts of a chunk
gives the places where some rule's match can end. The pass runs many lanes at
once: each lane starts in the initial state, and lanes whose predecessor ended
elsewhere are walked again from the true state until they meet what they had
before. A mirrored automaton of the rule then walks back from each end to the
leftmost start after the rule's previous match.

Defined results: a null text is empty (no spans); every row gives one row,
repeated rows and null ids included; the matches of a rule are leftmost and do
not overlap; offsets are code points, end exclusive; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.automaton import Automaton
from codestrata.llm.common import chunks, column


class Rule(NamedTuple):
    """A match is kept if it has ``least`` characters (its ``group``, if given)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones. No rule may match a line feed.
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9\-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
)
LANE = 256


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        dfa = self.dfa = Automaton([r.pattern for r in rules])
        width = dfa.table.shape[1]
        if (dfa.table[:, dfa.of_byte[10]] != dfa.start).any():
            raise ValueError("a rule matches a line feed")
        self.next = (dfa.table * width).ravel().astype(np.int64)  # states are held as row offsets
        self.start, self.first, self.width = dfa.start * width, dfa.first * width, width
        self.mirrors = [Automaton([r.pattern], anywhere=False, back=True) for r in rules]
        self.dead = [next((s for s in range(len(m.table)) if (m.table[s] == s).all() and not m.accepts[s]), -1) for m in self.mirrors]
        self.steps = [[[int(x) for x in row[m.of_byte]] for row in m.table] for m in self.mirrors]
        self.exact = [re.compile(r.pattern.encode()) for r in rules]

    def ends(self, data: bytes) -> list[np.ndarray]:
        """For each rule, the ends of its longest matches in ``data``."""
        lanes = max(1, -(-len(data) // LANE))
        raw = np.full(lanes * LANE, 10, np.uint8)
        raw[: len(data)] = np.frombuffer(data, np.uint8)
        cls = np.ascontiguousarray(self.dfa.of_byte[raw].reshape(lanes, LANE).T)
        seen = np.empty((LANE, lanes), np.int32)
        state = np.full(lanes, self.start, np.int64)
        for t in range(LANE):
            state += cls[t]
            state = self.next.take(state)
            seen[t] = state
        lane = np.flatnonzero(seen[-1, :-1] != self.start) + 1
        while len(lane):  # walk again from the true state
            state = seen[-1, lane - 1].astype(np.int64)
            for t in range(LANE):
                state = self.next.take(state + cls[t, lane])
                other = state != seen[t, lane]
                lane, state = lane[other], state[other]
                if not len(lane):
                    break
                seen[t, lane] = state
            lane = lane[lane + 1 < lanes] + 1
        at = np.flatnonzero((seen >= self.first).T.ravel())
        bits = self.dfa.accepts[seen[at % LANE, at // LANE] // self.width]
        out = []
        for k in range(len(self.rules)):
            own = at[(bits >> k) & 1 == 1]
            out.append(own[np.append(own[1:] != own[:-1] + 1, True)] + 1 if len(own) else own)
        return out

    def back(self, k: int, data: bytes, end: int, low: int) -> int:
        """Leftmost start of a match of rule k that ends at ``end``, or -1."""
        steps, accepts, dead = self.steps[k], self.mirrors[k].accepts, self.dead[k]
        state, found, at = self.mirrors[k].start, -1, end
        while at > low:
            at -= 1
            state = steps[state][data[at]]
            if state == dead:
                break
            if accepts[state]:
                found = at
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every text, in code points, sorted."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) + 1 for r in raw], np.int64)
        begin = np.cumsum(size) - size
        data = b"\n".join(raw)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, ends in enumerate(self.ends(data)):
            rule, last = self.rules[k], 0
            owners = np.searchsorted(begin, ends, side="left") - 1  # an end is never a text's first byte
            for doc, end in zip(owners.tolist(), ends.tolist(), strict=True):
                low = max(last, int(begin[doc]))
                start = self.back(k, data, end, low)
                if start < 0:
                    continue
                last = end
                if rule.least and (end - start if not rule.group else len(self.exact[k].fullmatch(data, start, end)[rule.group])) < rule.least:
                    continue
                found.setdefault(doc, []).append((start - int(begin[doc]), k, end - int(begin[doc])))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for doc, spans in found.items():
            if len(raw[doc]) != len(texts[doc]):  # bytes to code points
                points = np.concatenate([[0], np.cumsum((np.frombuffer(raw[doc], np.uint8) & 0xC0) != 0x80)])
                spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
            out[doc] = sorted(spans)
        return out


@functools.lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row: the id and ``found``, an array of (kind, start, end)
    by start, then by the order of the rules. No shuffle."""
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows: list = []
            for _, texts in chunks(column(batch, "text").to_pylist()):
                rows += [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in engine.scan(texts)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(rows, pa.list_(kind))], ["id", "found"])

    found = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`find_secrets` rows."""
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    return found.select(
        id_col,
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("found", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
