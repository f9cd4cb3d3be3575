import hashlib
import random

import pytest

from vellum.llm import chat_format as C


def test_escape_round_trip():
    r = random.Random(1)
    parts = [*C.CONTROL, "\\", "\n", "a", "<", "|", "[", "é", "𝄞", "</s", ">", "<|turn", "\\\n"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        made = C.escape(text)
        assert C.unescape(made) == text
        assert not any(c in made for c in C.CONTROL)
        line = C.FILTERS["escape_line"](text)
        assert C.unescape(line) == text
        formatted, spans = C.render(C.compile_template(), [{"role": text, "text": text}, {"role": "assistant", "text": text}])
        assert C.read_back(formatted) == [(text, text), ("assistant", text)]
        assert "".join(C.unescape(formatted[a:b]) for a, b in spans) == text * (2 if text == "assistant" else 1)


def test_template_language():
    show = lambda t, **names: "".join(x for x, _ in C.compile_template(t)(names))
    assert show("a{{ 'b' + \"c\" | upper }}{{ x.y }}", x={"y": 3}) == "abC3"
    assert show("{% for v in xs %}{% if v == 'a' and not loop.first %}A{% elif v != 'b' %}{{ v | trim }}{% else %}-{% endif %}{% endfor %}", xs=["a", "b", "a", " c "]) == "a-Ac"
    assert C.fold(C.parse("x{% if 1 == 2 %}y{% else %}z{{ 'w' | upper }}{% endif %}")) == (C.Text("xzW"),)
    assert list(C.compile_template("a{% generation %}b{% endgeneration %}")({})) == [("a", False), ("b", True)]
    for bad in ("{{ x.__class__ }}", "{{ x | eval }}", "{% for %}", "{% if x %}", "{% endif %}", "{{ x( }}", "{% else %}", "{% import os %}", "{{ }}"):
        with pytest.raises(C.TemplateError):
            C.compile_template(bad)
    with pytest.raises(C.TemplateError):
        show("{{ y }}", x=1)
    with pytest.raises(C.TemplateError):
        show("{{ x.real }}", x=1)


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", "[INST] é\\"), (2, 0, "assistant", None), (2, 1, None, "x"), (3, 0, "user", ""), (None, 0, "assistant", "n"), (4, None, "assistant", "a"), (4, 0, "assistant", "b"),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, "assistant", "y" * 300_000)] + [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(20_000)]


def test_queries(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted int")
    got = C.digest_conversations(df).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == expected(ROWS)
    whole = {x.conv_id: x for x in C.format_conversations(df).collect()}
    assert len(whole) == len(got)
    for x in got:
        w = whole[x.conv_id]
        assert (w.n_turns, len(w.formatted)) == (x.n_turns, x.formatted_chars)
        assert hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in C.read_back(w.formatted)).encode()).hexdigest() == x.turns_sha256
        assert sum(len(C.unescape(w.formatted[s.start : s.end])) for s in w.loss_spans) == x.loss_chars
    assert C.digest_conversations(df.where("conv_id < 0")).count() == 0
    assert C.digest_conversations(C.probe(spark)).first().loss_chars == 21


def test_constant_elif_is_no_else():
    from vellum.llm import chat_format as C

    made = C.parse("{% if a %}1{% elif 'k' %}2{% else %}3{% endif %}")
    assert made
    for bad in ("{% if a %}1{% else %}2{% elif b %}3{% endif %}", "{% if a %}1{% else %}2{% else %}3{% endif %}"):
        try:
            C.parse(bad)
        except C.TemplateError:
            continue
        raise AssertionError(bad)
