"""The combined automaton against the rules run one by one."""

import hashlib
import random
import re

from codestrata.llm import secret_scan as S
from codestrata.llm.automaton import Automaton

PIECES = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "AKIAKIA", "0123456789abcdef", "deadbeef", "é", "\n", "ABCDEFGHIJ123456", "ghp_", "xoxb-", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "abcdefgh", "x", "_", "-", "😀"]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    for k, rule in enumerate(S.RULES[3:], 3):
        found += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
    return sorted(found)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_scan_like_the_regexes():
    texts = [*random_texts(5000, 3), "", "a" * 3000, "token=" + "a" * 5000, "secret=token = abcdefgh", "password==abcdef"]
    assert S.scanner(S.RULES).scan(texts) == [brute(t) for t in texts]


def test_one_text_over_many_lanes():
    text = "".join(random_texts(400, 9))
    assert S.scanner(S.RULES).scan([text, text]) == [brute(text)] * 2


def test_minimal_automaton():
    # (a|b)*abb has the textbook minimum of four states
    dfa = Automaton(["abb"])
    assert dfa.table.shape[0] == 4 and dfa.built >= 4
    assert Automaton(["ab|ab|a(b)"], anywhere=False).table.shape[0] == Automaton(["ab"], anywhere=False).table.shape[0]


def test_query_columns(spark):
    texts = [*random_texts(60, 4), None, ""]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "token=abcdef", "x"), (1, "token=abcdef", "x"), (1, "token=abcdef", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.secret_digest(S.find_secrets(df)).collect()
    kinds = [r.kind for r in S.RULES]
    want = []
    for doc, text, _ in rows:
        spans = brute(text or "")
        joined = lambda own: ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in own)
        base = [s for s in spans if s[1] < 3]
        want.append((doc, *[sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert S.find_secrets(df.where("doc_id = -1")).count() == 0
