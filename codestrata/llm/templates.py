"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if %} {% elif %} {% else %} {% endif %}   {% set x = ... %}
    {% for message in messages %} ... {% endfor %}   {# comment #}
    {% generation %} ... {% endgeneration %}

``-`` inside a tag's bars trims the white space beside it. Expressions know
strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']``,
``a if c else b``, or, and, not, comparisons, in, ``+`` and ``~`` (joins
strings), and filters (``x | name(argument)``) out of a fixed table. There are
no calls, no other attributes and no Python objects to reach.

A template sees its messages as a stream: it has one loop over them, at the top
level, whose body depends on the message and ``loop`` (index0, index, first,
last, length) alone. So a conversation can be rendered piece by piece, by any
number of tasks, and gives the same text. ``messages | length`` is known too.

Compilation: source to a syntax tree, constants are folded (expressions,
branches, neighbouring text), names become slots, nodes become closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

_TAG = re.compile(r"""\{(?:%-?(?P<do>(?:"[^"]*"|'[^']*'|[^"'%]|%(?!\}))*?)(?P<dt>-?)%\}|\{-?(?P<say>(?:"[^"]*"|'[^']*'|[^"'}]|\}(?!\}))*?)(?P<st>-?)\}\}|\#(?P<note>.*?)\#\})""", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\](),=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r"}

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class TemplateError(ValueError):
    pass


def escape_control(text: str) -> str:
    """One backslash more between ``<`` and ``|``: no ``<|`` is left, and
    :func:`unescape_control` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape_control(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """A text on one line, with its control strings escaped."""
    return escape_control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_control(text), flags=re.S)


def show(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


FILTERS: dict[str, tuple[Callable, int]] = {
    "control": (lambda x: escape_control(show(x)), 0),
    "line": (lambda x: escape_line(show(x)), 0),
    "trim": (lambda x: show(x).strip(), 0),
    "upper": (lambda x: show(x).upper(), 0),
    "lower": (lambda x: show(x).lower(), 0),
    "length": (lambda x: len(show(x)), 0),
    "default": (lambda x, y: y if x is None else x, 1),
    "replace": (lambda x, a, b: show(x).replace(show(a), show(b)), 2),
}


def _ordered(test: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: type(a) is type(b) and a is not None and test(a, b)


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: show(a) in show(b),
    "+": lambda a, b: a + b if type(a) is int and type(b) is int else show(a) + show(b),
    "~": lambda a, b: show(a) + show(b),
}


# ---------------------------------------------------------------- syntax tree
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple = ()


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Say:
    what: Any


@dataclass(frozen=True)
class Put:
    name: str
    what: Any


@dataclass(frozen=True)
class Branch:
    cases: tuple  # ((test, body), ...); the last test may be Const(True)


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --------------------------------------------------------------------- parser
class _Expression:
    def __init__(self, source: str):
        self.source, self.tokens, self.at, end = source, [], 0, 0
        while source[end:].strip():
            m = _TOKEN.match(source, end)
            if not m:
                raise TemplateError(f"cannot read {source[end:]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "str":
                value = re.sub(r"\\(.)", lambda e: _UNESCAPE.get(e[1], e[1]), value[1:-1], flags=re.S)
            self.tokens.append((kind, value))
            end = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected in {self.source!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name expected in {self.source!r}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much in {self.source!r}")

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Choice(test, value, self.choice() if self.take("else") else Const(None))
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Logic("or", value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Logic("and", value, self.negated())
        return value

    def negated(self):
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            value = Binary(op, value, self.joined())
        return value

    def joined(self):
        value = self.filtered()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            value = Binary(op, value, self.filtered())
        return value

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.peek(")"):
                        self.need(",")
            if name not in FILTERS or FILTERS[name][1] != len(args):
                raise TemplateError(f"no filter {name} with {len(args)} arguments")
            value = Filter(name, value, tuple(args))
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            out = Const(value)
        elif kind == "int":
            out = Const(int(value))
        elif kind == "name" and value not in _KEYWORDS:
            out = Const(_WORDS[value]) if value in _WORDS else Name(value)
        elif value == "(" and kind == "op":
            out = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"{value!r} is not expected in {self.source!r}")
        while True:
            if self.take("."):
                out = Field(out, self.name())
            elif self.take("["):
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "str":
                    raise TemplateError(f"a quoted name expected in {self.source!r}")
                self.at += 1
                self.need("]")
                out = Field(out, value)
            else:
                return out


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) of texts and tags, with the white space trimmed."""
    out: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        out.append(("text", text.rstrip() if source.startswith("-", m.start() + 2) and m["note"] is None else text))
        if m["do"] is not None:
            out.append(("do", m["do"].strip()))
        elif m["say"] is not None:
            out.append(("say", m["say"].strip()))
        trim = "-" in (m["dt"], m["st"])
        at = m.end()
    rest = source[at:]
    out.append(("text", rest.lstrip() if trim else rest))
    for kind, text in out:
        if kind == "text" and ("{%" in text or "{{" in text):
            raise TemplateError(f"a tag is not closed: {text!r}")
    return out


class _Parser:
    def __init__(self, source: str):
        self.pieces, self.at = _pieces(source), 0

    def body(self, ends: tuple[str, ...], depth: int, masked: bool) -> tuple[tuple, str]:
        out: list = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(content))
                continue
            if kind == "say":
                e = _Expression(content)
                out.append(Say(e.choice()))
                e.end()
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(out), content
            out.append(self.tag(word, rest, depth, masked))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def tag(self, word: str, rest: str, depth: int, masked: bool):
        e = _Expression(rest)
        if word == "if":
            cases, test = [], e.choice()
            e.end()
            while True:
                body, end = self.body(("elif", "else", "endif"), depth + 1, masked)
                cases.append((test, body))
                if end == "endif":
                    return Branch(tuple(cases))
                if end == "else":
                    last, end = self.body(("endif",), depth + 1, masked)
                    return Branch((*cases, (Const(True), last)))
                e = _Expression(end.removeprefix("elif"))
                test = e.choice()
                e.end()
        if word == "for":
            name = e.name()
            e.need("in")
            if e.name() != "messages" or depth or name in ("messages", "loop"):
                raise TemplateError("the one loop is over messages, at the top level")
            e.end()
            return Loop(name, self.body(("endfor",), depth + 1, masked)[0])
        if word == "set":
            name = e.name()
            e.need("=")
            what = e.choice()
            e.end()
            if name in ("messages", "loop"):
                raise TemplateError(f"{name} cannot be set")
            return Put(name, what)
        if word == "generation":
            e.end()
            if masked:
                raise TemplateError("generation blocks cannot be nested")
            return Generation(self.body(("endgeneration",), depth + 1, True)[0])
        raise TemplateError(f"no tag {word!r}")


def parse(source: str) -> tuple:
    body, _ = _Parser(source).body((), 0, False)
    if sum(isinstance(x, Loop) for x in body) != 1:
        raise TemplateError("a template has exactly one loop over messages")
    return body


# -------------------------------------------------------------------- folding
def fold(node, known: dict[str, Any]):
    """The node with every part that does not depend on a message computed."""
    f = lambda x: fold(x, known)
    match node:
        case Name(name):
            return Const(known[name]) if name in known else node
        case Field(of, name):
            return Field(f(of), name)
        case Binary(op, a, b):
            a, b = f(a), f(b)
            return Const(BINARY[op](a.value, b.value)) if isinstance(a, Const) and isinstance(b, Const) else Binary(op, a, b)
        case Logic(op, a, b):
            a, b = f(a), f(b)
            if isinstance(a, Const):
                return b if bool(a.value) == (op == "and") else a
            return Logic(op, a, b)
        case Not(x):
            x = f(x)
            return Const(not x.value) if isinstance(x, Const) else Not(x)
        case Choice(test, yes, no):
            test, yes, no = f(test), f(yes), f(no)
            return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
        case Filter(name, x, args):
            x, args = f(x), tuple(map(f, args))
            if isinstance(x, Const) and all(isinstance(a, Const) for a in args):
                return Const(FILTERS[name][0](x.value, *(a.value for a in args)))
            return Filter(name, x, args)
    return node


def fold_body(body: Sequence, known: dict[str, Any]) -> tuple:
    out: list = []
    for node in body:
        match node:
            case Say(what):
                what = fold(what, known)
                new = [Text(show(what.value))] if isinstance(what, Const) else [Say(what)]
            case Put(name, what):
                new = [Put(name, fold(what, known))]
            case Loop(name, inner):
                new = [Loop(name, fold_body(inner, known))]
            case Generation(inner):
                new = [Generation(fold_body(inner, known))]
            case Branch(cases):
                kept = []
                for test, inner in cases:
                    test = fold(test, known)
                    if isinstance(test, Const) and not test.value:
                        continue
                    kept.append((test, fold_body(inner, known)))
                    if isinstance(test, Const):
                        break
                new = list(kept[0][1]) if kept and isinstance(kept[0][0], Const) else [Branch(tuple(kept))] if kept else []
            case _:
                new = [node]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


# ------------------------------------------------------------------- closures
@dataclass
class Rendered:
    """A text in parts, and the spans that a model learns to write."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)


_LOOP = ("index0", "index", "first", "last", "length")


class _Compiler:
    """Slots: 0 the message, 1 its index, 2 the number of messages, then names."""

    def __init__(self) -> None:
        self.slots, self.message, self.inner = 3, "", False

    def value(self, node, names: dict[str, int]) -> Callable[[list], Any]:
        v = lambda x: self.value(x, names)
        match node:
            case Const(value):
                return lambda s: value
            case Filter("length", Name("messages")):
                return lambda s: s[2]
            case Field(Name("loop"), name) if self.inner and name in _LOOP:
                return {
                    "index0": lambda s: s[1],
                    "index": lambda s: s[1] + 1,
                    "first": lambda s: s[1] == 0,
                    "last": lambda s: s[1] == s[2] - 1,
                    "length": lambda s: s[2],
                }[name]
            case Field(Name(name), key) if self.inner and name == self.message and name not in names:
                return lambda s: s[0].get(key)
            case Name(name) if name in names:
                slot = names[name]
                return lambda s: s[slot]
            case Binary(op, a, b):
                do, a, b = BINARY[op], v(a), v(b)
                return lambda s: do(a(s), b(s))
            case Logic("and", a, b):
                a, b = v(a), v(b)
                return lambda s: a(s) and b(s)
            case Logic("or", a, b):
                a, b = v(a), v(b)
                return lambda s: a(s) or b(s)
            case Not(x):
                x = v(x)
                return lambda s: not x(s)
            case Choice(test, yes, no):
                test, yes, no = v(test), v(yes), v(no)
                return lambda s: yes(s) if test(s) else no(s)
            case Filter(name, x, args):
                do, x, args = FILTERS[name][0], v(x), tuple(map(v, args))
                return (lambda s: do(x(s))) if not args else (lambda s: do(x(s), *(a(s) for a in args)))
        raise TemplateError(f"{node} is not known here")

    def body(self, nodes: Sequence, names: dict[str, int]) -> Callable[[list, Rendered], None]:
        steps = [self.step(n, names) for n in nodes]

        def run(s: list, out: Rendered) -> None:
            for step in steps:
                step(s, out)

        return steps[0] if len(steps) == 1 else run

    def step(self, node, names: dict[str, int]) -> Callable[[list, Rendered], None]:
        match node:
            case Text(text):
                size = len(text)

                def put(s: list, out: Rendered) -> None:
                    out.parts.append(text)
                    out.size += size

                return put
            case Say(what):
                value = self.value(what, names)

                def say(s: list, out: Rendered) -> None:
                    text = show(value(s))
                    out.parts.append(text)
                    out.size += len(text)

                return say
            case Put(name, what):
                value = self.value(what, names)
                slot = names.get(name)
                if slot is None:
                    slot = names[name] = self.slots
                    self.slots += 1

                def keep(s: list, out: Rendered) -> None:
                    s[slot] = value(s)

                return keep
            case Branch(cases):
                tests = [(self.value(t, names), self.body(b, names)) for t, b in cases]

                def choose(s: list, out: Rendered) -> None:
                    for test, body in tests:
                        if test(s):
                            return body(s, out)

                return choose
            case Generation(inner):
                body = self.body(inner, names)

                def mark(s: list, out: Rendered) -> None:
                    begin = out.size
                    body(s, out)
                    if out.size > begin:
                        out.spans.append((begin, out.size))

                return mark
        raise TemplateError(f"{node} is not expected here")


class Template:
    """A compiled template. ``constants`` are names with values fixed now."""

    def __init__(self, source: str, constants: dict[str, Any] | None = None):
        self.tree = fold_body(parse(source), dict(constants or {}))
        at = next(k for k, x in enumerate(self.tree) if isinstance(x, Loop))
        loop: Loop = self.tree[at]
        c, names = _Compiler(), {}
        self.before = c.body(self.tree[:at], names)
        outer = c.slots
        c.inner, c.message = True, loop.name
        self.each = c.body(loop.body, inner := dict(names))
        if any(inner[n] < outer and _puts(loop.body, n) for n in names):
            raise TemplateError("a name from outside the loop cannot be set inside it")
        c.inner = False
        self.own = range(outer, c.slots)  # slots of the loop's body
        self.after = c.body(self.tree[at + 1 :], names)
        self.slots = c.slots

    def render(self, messages: Sequence[dict], first: int = 0, total: int | None = None) -> Rendered:
        """The text of ``messages``, which are those from number ``first`` on out
        of ``total``; pieces rendered one by one join to the whole text."""
        total = len(messages) if total is None else total
        slots, out = [None] * self.slots, Rendered()
        slots[2] = total
        head = out if first == 0 else Rendered()
        self.before(slots, head)
        for k, message in enumerate(messages, first):
            slots[0], slots[1] = message, k
            for slot in self.own:
                slots[slot] = None
            self.each(slots, out)
        if first + len(messages) == total:
            self.after(slots, out)
        return out


def _puts(body: Sequence, name: str) -> bool:
    for node in body:
        match node:
            case Put(n, _) if n == name:
                return True
            case Branch(cases) if any(_puts(b, name) for _, b in cases):
                return True
            case Generation(inner) if _puts(inner, name):
                return True
    return False
