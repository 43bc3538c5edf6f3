import random

import pytest

from codestrata.operators import classes as C
from codestrata.operators import diagnostics as D
from codestrata.operators import docs as H
from codestrata.operators import extract as X
from codestrata.operators import scopes as SC
from codestrata.operators import symbols as S


def test_orders_equal_those_of_the_interpreter():
    rng = random.Random(3)
    for _ in range(300):
        made: dict[str, type] = {"object": object}
        orders: dict[str, list[str]] = {}
        for k in range(rng.randrange(1, 9)):
            name = f"K{k}"
            bases = rng.sample(sorted(orders), min(len(orders), rng.randrange(4)))
            order, good = C.merge_orders(name, [orders[b] for b in bases])
            try:
                made[name] = type(name, tuple(made[b] for b in bases), {})
            except TypeError:
                assert not good
                continue
            assert good and order == [c.__name__ for c in made[name].__mro__[:-1]]
            orders[name] = order


def test_members_of_a_deep_hierarchy_over_files(files):
    rows = [("m0.py", "class C0:\n    def a(self):\n        pass\n    def b(self):\n        pass\n")]
    rows += [(f"m{k}.py", f"from m{k - 1} import C{k - 1}\nclass C{k}(C{k - 1}):\n    def x{k}(self):\n        return self.a()\n") for k in range(1, 4)]
    rows += [("g.py", "from m3 import C3 as Base\nclass G(Base[int], Unknown, make()):\n    def a(self):\n        'Own a.'\n"), ("e.py", "")]
    a = X.analyze_files(files(rows)).cache()
    got = {r.name: (r.defined_in, r.kind, r.depth) for r in C.class_members(a).where("class_name = 'g.G'").collect()}
    assert got["a"] == ("g.G", "method", 0) and got["b"] == ("m0.C0", "method", 4) and got["x3"] == ("m3.C3", "method", 1) and len(got) == 5
    refs = S.references(a, members=C.class_members(a)).where("full_name = 'm0.C0.a' and kind = 'use'").collect()
    assert sorted(r.path for r in refs) == [f"m{k}.py" for k in range(1, 4)]


def test_class_records_list_inherited_members_with_signatures(files):
    a = X.analyze_files(files([("m.py", "class A:\n    def __init__(self, n=1):\n        pass\n    def go(self, x: int) -> str:\n        '''Go on.'''\n    @staticmethod\n    def st(self):\n        return self.go\n    @property\n    def p(self):\n        pass\nclass B(A):\n    size: int = 1\n    def _no(self):\n        pass\n")])).cache()
    members = C.class_members(a)
    rec = {r.name: r for r in C.with_members(H.api_docs(a), members).where("object_type = 'class'").collect()}["m.B"]
    assert [(m.name, m.signature, m.description, m.defined_in) for m in rec.methods] == [("__init__", "__init__(n) -> None", None, "m.A"), ("go", "go(x: int) -> str", "Go on.", "m.A"), ("st", "st() -> None", None, "m.A")]
    assert [(m.name, m.signature) for m in rec.attributes] == [("size", "int")]
    # a static method's first parameter is no instance
    assert C.member_uses(a, members).count() == 0


def test_uses_resolve_to_the_nearest_scope(files):
    src = (
        "x = 0\n\n\ndef f():\n    x = 1\n\n    def g():\n        return x\n\n    class K:\n        x = 2\n        y = x\n\n        def m(self):\n            return x\n\n    return g, K\n\n\n"
        "def f():\n    return x\n\n\ndef h():\n    global x\n    x = 5\n    return x\n"
    )
    a = X.analyze_files(files([("s.py", src)])).cache()
    got = sorted((r.line, r.resolved, r.resolved_id) for r in SC.uses(a).where("name = 'x'").collect())
    ids = {r.scope_id: (r.scope, r.kind, r.parent_id) for r in SC.scope_rows(a).collect()}
    assert [(line, scope) for line, scope, _ in got] == [(8, "f"), (12, "f.K"), (15, "f"), (21, "<module>"), (27, "<module>")]
    assert ids[0] == ("<module>", "module", None) and sum(scope == "f" for scope, _, _ in ids.values()) == 2
    assert all(ids[i][0] == scope for _, scope, i in got)


@pytest.mark.parametrize(
    "src,undefined",
    [
        ("def f(a):\n    return b\n\n\ndef f(b):\n    return b\n", ["b"]),
        ("class C:\n    @property\n    def x(self):\n        return value\n\n    @x.setter\n    def x(self, value):\n        pass\n", ["value"]),
        ("class C:\n    v = 1\n    w = [v for _ in range(v)]\n", ["v"]),
        ("def a():\n    def b():\n        nonlocal n\n        n = 1\n    n = 0\n    return n\n\n\ndef c():\n    return n\n", ["n"]),
        ("f = lambda k: k\ng = lambda: k\n", ["k"]),
    ],
)
def test_undefined_names_of_like_scopes(files, src, undefined):
    assert [r.name for r in D.undefined_names(X.analyze_files(files([("u.py", src)]))).collect()] == undefined
