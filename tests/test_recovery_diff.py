import ast
import random

from codestrata.functions import diff as DF
from codestrata.functions.pyast import analyze, recover
from codestrata.operators import extract as X
from codestrata.operators import symbols as S

PARTS = ["x = 1", "def f(:", "    y = (", '"""', "if a:", "    return 1", "foo bar", "}", "class A:", "    def m(self): pass", "    else:", "\tx", "try:", "except E:", "@d", ""]


def test_errors_keep_lines_and_leave_valid_code():
    rng = random.Random(1)
    clean = 0
    for _ in range(400):
        text = "\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))
        found, left = recover(text)
        assert left.count("\n") == text.count("\n") and (found or left == text.replace(chr(13), chr(10)))
        assert all(1 <= e["line"] <= text.count("\n") + 2 for e in found)
        try:
            ast.parse(left)
            clean += 1
        except SyntaxError:
            pass
    assert clean > 380


def test_valid_files_are_not_touched():
    text = "def f():\n    return '''\ndef g(\n'''\n\n\nclass A:\n    x = (1,\n2)\nif f:\n    pass\nelse:\n    pass\n"
    assert recover(text) == ([], text)


def test_every_function_between_errors_is_kept():
    blocks = []
    for k in range(60):
        blocks.append(f"def ok{k}():\n    return {k}\n" if k % 3 else f"def bad{k}()\n    return {k}\n")
    rec = analyze("\n\n".join(blocks), recovered=True)
    assert [f["name"] for f in rec["functions"]] == [f"ok{k}" for k in range(60) if k % 3]
    assert [e["line"] for e in rec["errors"]] == [1 + 4 * k for k in range(60) if not k % 3]
    assert analyze("\n\n".join(blocks))["functions"] == []


def test_syntax_errors_are_rows(files):
    a = X.analyze_files(files([("a.py", "x = = 1\n\n\ndef f():\n    return 1\n\n\ny = = 2\n"), ("b.txt", "x"), ("c.py", "ok = 1\n")]))
    got = sorted((r.path, r.line) for r in X.syntax_errors(a).collect() if r.line)
    assert got == [("a.py", 1), ("a.py", 8)]
    assert [r.message for r in X.syntax_errors(a).where("path = 'b.txt'").collect()] == ["Not a Python file: b.txt"]


def apply(old: str, hunks: list[dict]) -> str:
    """The text that the hunks make of the old one; every line is checked."""
    lines, out, at = DF.LINE.findall(old), [], 0
    for h in hunks:
        start = h["old_start"] - 1 if h["old_lines"] else h["old_start"]
        out += lines[at:start]
        at = start
        said = h["text"].split("\n")[:-1]
        for k, line in enumerate(said):
            if line.startswith("\\"):
                continue
            text = line[1:] + ("" if said[k + 1 : k + 2] == ["\\ No newline at end of file"] else "\n")
            if line[0] in " -":
                assert lines[at] == text
                at += 1
            if line[0] in " +":
                out.append(text)
    return "".join(out + lines[at:])


def test_hunks_make_the_new_text_of_the_old():
    rng = random.Random(2)
    for _ in range(600):
        old = "".join(rng.choice(["a\n", "b\n", "\n", "c d\n", "x\r\n", "e\n"]) for _ in range(rng.randrange(30))) + rng.choice(["", "end"])
        lines = DF.LINE.findall(old)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(lines) + 1)
            lines[k : k + rng.randrange(3)] = rng.choice([[], ["new\n"], ["a\n", "z\n"]])
        new = "".join(line if line.endswith("\n") or k == len(lines) - 1 else line + "\n" for k, line in enumerate(lines))
        hunks = DF.hunks(old, new)
        assert apply(old, hunks) == new and (hunks or old == new)
        assert all(h["old_lines"] == sum(x[0] in " -" for x in h["text"].split("\n")[:-1]) for h in hunks)


def test_moved_and_unique_lines_are_anchors():
    old = "".join(f"line {k}\n" for k in range(200))
    new = old.replace("line 50\n", "").replace("line 120\n", "line 120\nmore\n").replace("line 150\n", "changed\n")
    hunks = DF.hunks(old, new)
    assert [(h["old_start"], h["old_lines"], h["new_lines"]) for h in hunks] == [(48, 7, 6), (119, 6, 7), (148, 7, 7)]


def test_diff_of_a_rename(files):
    f = files([("r.py", "x = 1\ny = x + 2\nprint(x)"), ("other.py", "z = 1\n")])
    r = S.rename(f, S.references(X.analyze_files(f)), "r.x", "value")
    d = S.unified_diff(S.diff_hunks(r)).collect()
    assert len(d) == 1 and d[0].diff == "--- r.py\n+++ r.py\n@@ -1,3 +1,3 @@\n-x = 1\n-y = x + 2\n-print(x)\n\\ No newline at end of file\n+value = 1\n+y = value + 2\n+print(value)\n\\ No newline at end of file\n"
