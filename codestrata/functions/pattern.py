"""Structural code patterns with metavariables (worker-side helper).

A pattern is Python source where ``$NAME`` stands for one node and
``$$$NAME`` for any number of list elements (arguments, statements,
parameters). The pattern is compiled once (on the driver, then shipped with
the task closure) and unified against every node of each parsed file.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

SINGLE = "__mv_"
MULTI = "__mvm_"
_IGNORED = {"ctx", "lineno", "col_offset", "end_lineno", "end_col_offset", "type_comment", "kind"}
# Optional parts a pattern may leave out and still match: a ``def`` pattern
# without a return annotation or decorators matches annotated/decorated
# functions. Other absent parts (e.g. an assert message) must be absent.
_LENIENT = {"returns", "decorator_list", "type_params", "annotation"}


@dataclass
class Pattern:
    source: str
    root: ast.AST

    @property
    def root_type(self):
        return type(self.root)


def _encode(pattern: str) -> str:
    s = re.sub(r"\$\$\$([A-Za-z_][A-Za-z0-9_]*)", lambda m: MULTI + m.group(1), pattern)
    return re.sub(r"\$([A-Za-z_][A-Za-z0-9_]*)", lambda m: SINGLE + m.group(1), s)


def compile_pattern(pattern: str) -> Pattern | None:
    """Parse a pattern; fragments such as ``except E:`` are completed by
    wrapping them in a ``try``. Returns None for an empty pattern."""
    import textwrap

    if not pattern or not pattern.strip():
        return None
    src = textwrap.dedent(_encode(pattern)).strip("\n")
    try:
        mod = ast.parse(src)
    except SyntaxError:
        try:
            mod = ast.parse("try:\n    pass\n" + src)
            handlers = mod.body[0].handlers
            if not handlers:
                raise SyntaxError("not a handler")
            return Pattern(pattern, handlers[0])
        except SyntaxError as e:
            raise ValueError(f"cannot parse pattern {pattern!r}: {e}") from e
    if len(mod.body) != 1:
        raise ValueError("patterns must be a single statement or expression")
    node = mod.body[0]
    if isinstance(node, ast.Expr):
        return Pattern(pattern, node.value)
    return Pattern(pattern, node)


def _var(node, prefix):
    if isinstance(node, ast.Name) and node.id.startswith(prefix):
        return node.id[len(prefix):]
    if isinstance(node, ast.Expr):
        return _var(node.value, prefix)
    if isinstance(node, ast.arg) and node.arg.startswith(prefix):
        return node.arg[len(prefix):]
    if isinstance(node, ast.alias) and node.name.startswith(prefix):
        return node.name[len(prefix):]
    return None


class _Matcher:
    def __init__(self):
        self.binds: dict[str, object] = {}

    def bind(self, name, value) -> bool:
        if name in self.binds:
            old = self.binds[name]
            a = ast.dump(old) if isinstance(old, ast.AST) else old
            b = ast.dump(value) if isinstance(value, ast.AST) else value
            return a == b
        self.binds[name] = value
        return True

    def node(self, p, t) -> bool:
        v = _var(p, SINGLE)
        if v is not None and isinstance(p, (ast.Name, ast.Expr)) and isinstance(t, ast.AST):
            if isinstance(p, ast.Expr) and not isinstance(t, ast.stmt):
                return False
            return self.bind(v, t.value if isinstance(p, ast.Expr) and isinstance(t, ast.Expr) else t)
        if type(p) is not type(t):
            return False
        multi_args = isinstance(p, ast.arguments) and any(_var(a, MULTI) is not None for a in p.args)
        if multi_args:
            var = next(_var(a, MULTI) for a in p.args if _var(a, MULTI) is not None)
            allargs = list(t.posonlyargs) + list(t.args) + list(t.kwonlyargs) + [a for a in (t.vararg, t.kwarg) if a]
            return self.bind(MULTI + var, allargs)
        call_multi = isinstance(p, ast.Call) and not p.keywords and any(_var(a, MULTI) is not None for a in p.args)
        for field, pv in ast.iter_fields(p):
            if field in _IGNORED:
                continue
            tv = getattr(t, field, None)
            if field in _LENIENT and (pv is None or pv == []):
                continue
            if call_multi and field == "keywords":
                continue
            if isinstance(pv, list):
                extra = list(t.keywords) if (call_multi and field == "args") else []
                if not self.seq(pv, list(tv or []), extra):
                    return False
            elif isinstance(pv, ast.AST):
                if not isinstance(tv, ast.AST) or not self.node(pv, tv):
                    return False
            elif isinstance(pv, str) and pv.startswith(SINGLE):
                if not isinstance(tv, str) or not self.bind(pv[len(SINGLE):], tv):
                    return False
            elif pv != tv:
                return False
        return True

    def seq(self, ps, ts, extra=()) -> bool:
        """Match a list with multi-element wildcards (backtracking)."""
        if not ps:
            return not ts
        head = ps[0]
        mv = _var(head, MULTI)
        if mv is not None:
            for cut in range(len(ts), -1, -1):
                saved = dict(self.binds)
                taken = ts[:cut] + (list(extra) if len(ps) == 1 else [])
                if self.bind(MULTI + mv, taken) and self.seq(ps[1:], ts[cut:]):
                    return True
                self.binds = saved
            return False
        if not ts:
            return False
        saved = dict(self.binds)
        if isinstance(head, ast.AST) and isinstance(ts[0], ast.AST):
            ok = self.node(head, ts[0])
        else:
            ok = head == ts[0]
        if ok and self.seq(ps[1:], ts[1:], extra):
            return True
        self.binds = saved
        return False


# Line ends as the parser sees them.
NEWLINE = re.compile(r"\r\n|\r|\n")


def _segment(text: str, lines: list[str], nodes) -> str | None:
    nodes = [n for n in (nodes if isinstance(nodes, list) else [nodes]) if isinstance(n, ast.AST) and hasattr(n, "lineno")]
    if not nodes:
        return None
    first, last = nodes[0], nodes[-1]
    return _span(lines, first.lineno, first.col_offset, last.end_lineno, last.end_col_offset)


def _span(lines, l1, c1, l2, c2) -> str:
    # ast offsets are UTF-8 byte offsets within a line
    if l1 == l2:
        return lines[l1 - 1].encode()[c1:c2].decode(errors="replace")
    out = [lines[l1 - 1].encode()[c1:].decode(errors="replace")]
    out += lines[l1:l2 - 1]
    out.append(lines[l2 - 1].encode()[:c2].decode(errors="replace"))
    return "\n".join(out)


def find_matches(pattern: Pattern, tree: ast.AST, text: str) -> list[dict]:
    """All matches in document order: text, kind, 1-based start/end line,
    0-based columns, metavariables (name -> source text)."""
    lines = NEWLINE.split(text)
    out = []
    for node in ast.walk(tree):
        if type(node) is not pattern.root_type:
            continue
        m = _Matcher()
        if not m.node(pattern.root, node):
            continue
        mv = {}
        for k, v in m.binds.items():
            if k.startswith(MULTI):
                mv["$$$" + k[len(MULTI):]] = _segment(text, lines, v) or ""
            elif isinstance(v, ast.AST):
                mv["$" + k] = _segment(text, lines, v) or ""
            else:
                mv["$" + k] = str(v)
        out.append(
            {
                "text": _span(lines, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset),
                "kind": type(node).__name__,
                "start_line": node.lineno,
                "start_col": node.col_offset,
                "end_line": node.end_lineno,
                "end_col": node.end_col_offset,
                "metavariables": mv,
            }
        )
    out.sort(key=lambda r: (r["start_line"], r["start_col"], -r["end_line"], -r["end_col"]))
    return out


def substitute(template: str, metavariables: dict) -> str:
    """Fill ``$$$X`` then ``$X`` in a replacement, token-wise (``$A`` does not
    touch ``$AB``)."""
    def multi(m):
        return metavariables.get("$$$" + m.group(1), m.group(0))

    def single(m):
        return metavariables.get("$" + m.group(1), m.group(0))

    s = re.sub(r"\$\$\$([A-Za-z_][A-Za-z0-9_]*)\b", multi, template)
    return re.sub(r"(?<!\$)\$([A-Za-z_][A-Za-z0-9_]*)\b", single, s)


def rewrite(text: str, matches: list[dict], replacement: str) -> tuple[str, list[dict]]:
    """Replace outermost, non-overlapping matches from the bottom up."""
    starts = [0, *(len(text[: m.end()].encode()) for m in NEWLINE.finditer(text))]
    raw = text.encode()
    chosen, last_end = [], -1
    for m in matches:  # document order, outer first at equal start
        s = starts[m["start_line"] - 1] + m["start_col"]
        e = starts[m["end_line"] - 1] + m["end_col"]
        if s >= last_end:
            chosen.append((s, e, m))
            last_end = e
    reps = []
    for s, e, m in reversed(chosen):
        new = substitute(replacement, m["metavariables"])
        raw = raw[:s] + new.encode() + raw[e:]
        reps.append({"line": m["start_line"], "original": m["text"], "replacement": new})
    reps.reverse()
    return raw.decode(errors="replace"), reps
