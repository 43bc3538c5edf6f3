"""Line differences of two texts as hunks (worker-side helper).

Lines that occur once on both sides are anchors; the longest run of anchors in
order on both sides splits the texts, and the parts between are done the same
way. A part without anchors is one change.
"""

from __future__ import annotations

import bisect
import re

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def _anchors(a: list[str], b: list[str], x: int, y: int, u: int, v: int) -> list[tuple[int, int]]:
    """Places of the longest run of lines unique in a[x:y] and in b[u:v]."""
    first: dict[str, int] = {}
    for k in range(x, y):
        first[a[k]] = -1 if a[k] in first else k
    other: dict[str, int] = {}
    for k in range(u, v):
        other[b[k]] = -1 if b[k] in other else k
    pairs = [(k, other.get(line, -1)) for line, k in first.items() if k >= 0 and other.get(line, -1) >= 0]
    ends: list[int] = []  # smallest last place in b of a run of each length
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, at) in enumerate(pairs):
        k = bisect.bisect_left(ends, at)
        if k == len(ends):
            ends.append(at)
            last.append(n)
        else:
            ends[k], last[k] = at, n
        before[n] = last[k - 1] if k else -1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """``(x, y, u, v)``: a[x:y] became b[u:v]; in order, apart from each other."""
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        x, y, u, v = todo.pop()
        while x < y and u < v and a[x] == b[u]:
            x, u = x + 1, u + 1
        while x < y and u < v and a[y - 1] == b[v - 1]:
            y, v = y - 1, v - 1
        if x == y and u == v:
            continue
        met = _anchors(a, b, x, y, u, v) if x < y and u < v else []
        if not met:
            out.append((x, y, u, v))
            continue
        for k, at in met:
            todo.append((x, k, u, at))
            x, u = k + 1, at + 1
        todo.append((x, y, u, v))
    out.sort()
    return out


def hunks(old: str, new: str, context: int = 3) -> list[dict]:
    """Hunks with ``context`` equal lines around changes; their texts hold lines
    with a leading space, minus or plus."""
    a, b = LINE.findall(old), LINE.findall(new)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for group in groups:
        x, y = max(0, group[0][0] - context), min(len(a), group[-1][1] + context)
        u, v = group[0][2] - (group[0][0] - x), group[-1][3] + (y - group[-1][1])
        said, at = [], x
        for p, q, r, s in group:
            said += [" " + line for line in a[at:p]] + ["-" + line for line in a[p:q]] + ["+" + line for line in b[r:s]]
            at = q
        said += [" " + line for line in a[at:y]]
        text = "".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in said)
        out.append({"old_start": x + 1 if y > x else x, "old_lines": y - x, "new_start": u + 1 if v > u else u, "new_lines": v - u, "text": text})
    return out


def span(start: int, lines: int) -> str:
    return str(start) if lines == 1 else f"{start},{lines}"
