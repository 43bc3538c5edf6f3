"""Column-level text helpers shared by the search, lint and accounting operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(text: Column) -> Column:
    """The text without one trailing newline (a final newline ends the last
    line, it does not open an empty one)."""
    return F.when(text.endswith("\n"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)


def line_array(text: Column) -> Column:
    """Lines of a text as ``array<string>``; empty text gives ``[""]``."""
    return F.split(body(F.coalesce(text, F.lit(""))), "\n", -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last suffix of the file name without the dot, as ``PurePath.suffix``:
    a leading dot (dotfile) or a trailing dot gives ``""``."""
    name = basename(path)
    rev = F.locate(".", F.reverse(name))
    pos = F.length(name) - rev + 1  # 1-based position of the last dot
    return F.when((rev > 0) & (pos > 1) & (pos < F.length(name)), name.substr(pos + 1, F.lit(1 << 30))).otherwise(F.lit(""))


def glob_to_regex(glob: str) -> str:
    """Translate a shell glob (``*``, ``?``, ``[...]``, ``{a,b}``) into an
    anchored Java regex over one path component."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = glob.find("]", i + 1)
            if j < 0:
                out.append(re.escape(c))
            else:
                inner = glob[i + 1 : j]
                if inner.startswith("!"):
                    inner = "^" + inner[1:]
                out.append("[" + inner.replace("\\", "\\\\") + "]")
                i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(name: Column, globs) -> Column:
    """True when ``name`` matches one of the globs."""
    globs = [g for g in globs if g]
    if not globs:
        return F.lit(True)
    return name.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def approx_tokens(text: Column) -> Column:
    """About four characters per token: 0 for empty or missing text, else at
    least 1 (``length`` counts code points)."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / 4).cast("long")))


def word_tokens(text: Column) -> Column:
    """About 0.75 words per token over whitespace-separated words."""
    t = F.coalesce(text, F.lit(""))
    # maximal runs of non-whitespace, counted without building an array
    words = F.regexp_count(t, F.lit(r"(?U)\S+"))
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(words / F.lit(0.75)).cast("long")))
