import hashlib
import random

import pytest

from codestrata.llm import chat_format
from codestrata.llm.common import materialize
from codestrata.llm.templates import Template, TemplateError, Text, escape_control, escape_line, unescape_control, unescape_line

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "assistant", "a b", "é", "<\\|", "\\n", ">", "\U0001f600", ""]


def noise(rng, n=8):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))


def expected(rows):
    """Brute force: digests of every conversation, from the rows alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        own = [(r[2] or "", r[3] or "") for r in own]
        said = "".join(f"{a}\n{b}\n" for a, b in own)
        learned = "".join(b for a, b in own if a == "assistant")
        size = sum(len("<|im_start|>" + escape_line(a) + "\n" + escape_control(b) + "<|im_end|>\n") for a, b in own)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size)
    return out


def digests(df, **how):
    rows = chat_format.conversation_digests(materialize(chat_format.format_conversations(df, **how), "chat-test")).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        text = noise(rng, 12)
        assert "<|" not in escape_control(text) and unescape_control(escape_control(text)) == text
        line = escape_line(text)
        assert "\n" not in line and "<|" not in line and unescape_line(line) == text


@pytest.mark.parametrize("how", [{}, {"piece_turns": 3}, {"piece_chars": 40}, {"piece_turns": 1}])
def test_conversations_equal_brute_force_whole_and_in_pieces(spark, how):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", noise(rng, 3), None]), rng.choice([noise(rng, 20), None, "x" * 90])) for c in [*range(25), None] for t in range(rng.randrange(1, 12))]
    rows += [(100, t, rng.choice(["user", "assistant"]), noise(rng)) for t in range(400)]
    rng.shuffle(rows)
    assert digests(spark.createDataFrame(rows, SCHEMA).repartition(5), **how) == expected(rows)


def test_pieces_join_to_the_whole_text_and_stay_bounded(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = chat_format.format_conversations(df).collect()
    cut = sorted(chat_format.format_conversations(df, piece_turns=7).collect(), key=lambda r: r.piece)
    assert len(whole) == 1 and len(cut) >= 15 and {r.pieces for r in cut} == {len(cut)}
    assert "".join(r.formatted for r in cut) == whole[0].formatted
    assert [r.formatted[x.start : x.end] for r in cut for x in r.loss] == [t for _, _, role, t in rows if role == "assistant"]


def test_ties_repeated_rows_nulls_clashing_columns_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, None, "user", None), (1, 0, "user", "b")] * 3
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], SCHEMA + ", piece int, id string")
    got = digests(df)
    assert got == digests(df.repartition(3), piece_turns=2)
    order = [("user", "")] * 3 + [("assistant", "z")] * 3 + [("user", "b")] * 9
    assert got[1][:2] == (15, hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in order).encode()).hexdigest())
    assert digests(df.limit(0)) == {}


def test_template_language():
    m = [{"role": "system", "text": " S "}, {"role": "user", "text": "U"}, {"role": "assistant", "text": "A"}]
    t = Template(
        "{# note #}{% set n = messages | length %}{{ bos ~ '!' }}{% for m in messages %}"
        "{% if loop.first and m.role == 'system' %}[{{ m['text'] | trim }}]{% elif m.role in 'user' %}{{ loop.index }}:{{ m.text }}"
        "{% else %}{% generation %}{{ m.text | lower if not loop.first else '' }}{{ eos }}{% endgeneration %}{% endif %}"
        "{% if loop.last %}.{% endif %}{% endfor %}{{ n }}{{ 'x' + 1 }}",
        {"bos": "<s>", "eos": "</s>"},
    )
    out = t.render(m)
    assert out.text == "<s>![S]2:Ua</s>.3x1"
    assert [out.text[a:b] for a, b in out.spans] == ["a</s>"]
    parts = [t.render(m[k : k + 1], k, 3) for k in range(3)]
    assert "".join(p.text for p in parts) == out.text


def test_constants_are_folded():
    t = Template("a{{ 'b' ~ c }}{% if c == 'x' and not false %}yes{% else %}{{ nothing }}{% endif %}{% for m in messages %}{{ m.text }}{% endfor %}{{ ('q' | upper) if c else 'r' }}", {"c": "x"})
    assert [x for x in t.tree if isinstance(x, Text)] == [Text("abxyes"), Text("Q")] and len(t.tree) == 3


def test_set_inside_the_loop_ends_with_the_turn():
    t = Template("{% for m in messages %}{% if m.role == 'a' %}{% set x = m.text %}{% endif %}{{ x | default('-') }}{% endfor %}")
    assert t.render([{"role": "a", "text": "1"}, {"role": "b", "text": "2"}]).text == "1-"


@pytest.mark.parametrize(
    "bad",
    [
        "no loop", "{% for m in messages %}", "{% for m in others %}{% endfor %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}",
        "{% for m in messages %}{{ m.__class__.x }}{% endfor %}", "{% for m in messages %}{{ m.text.upper() }}{% endfor %}", "{{ messages[0] }}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{{ m.text | system }}{% endfor %}", "{{ m.text }}{% for m in messages %}{% endfor %}", "{% set x = 1 %}{% for m in messages %}{% set x = 2 %}{% endfor %}",
        "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}", "{% for m in messages %}{{ 'a {% endfor %}", "{% run %}{% for m in messages %}{% endfor %}",
    ],
)
def test_what_the_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        Template(bad)
