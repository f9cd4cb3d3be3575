import random
import re

import numpy as np

from vellum.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    marked, at = set(), {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            marked |= {p + k for p in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), n < 10 or 100 * len(marked) > 20 * n


def texts():
    r = random.Random(1)
    words = ["a", "bb", "é", "𝄞", "x%", "|", "<b>", "\x85", "\x1c"]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(r.randrange(60))) for _ in range(300)] + ["same words here now ok " * 50, "x" * 100_000, None, "", "\n\n", "line one\nline one\n line one"]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts())], "doc_id long, text string, kept boolean")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in Q.judge(df, Q.Model()).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts())}
    assert Q.judge(df.where("doc_id < 0"), Q.Model()).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(2)
    model = Q.Model(tuple(r.normal(size=len(Q.FEATURES))), 0.8)
    for _ in range(100):
        x = r.normal(size=(r.integers(1, 8), len(Q.FEATURES)))
        emit = x @ np.array(model.weights)
        value = lambda y, emit=emit: sum(e / 2 if a else -e / 2 for e, a in zip(emit, y, strict=True)) + sum(model.stick / 2 if a == b else -model.stick / 2 for a, b in zip(y, y[1:], strict=False))
        assert model.decode(x) == list(max(itertools.product([True, False], repeat=len(x)), key=value))


def test_learned_model_keeps_prose_and_drops_junk(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiourstlnm") for _ in range(r.randrange(1, 9)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(r.randrange(5, 20))) + "." for _ in range(r.randrange(2, 9)))
    junk = lambda: "\n".join(" | ".join(word() for _ in range(r.randrange(5, 20))) for _ in range(r.randrange(2, 9)))
    rows = [(i, junk() if i % 4 == 0 else prose()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(200)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = {x.doc_id: x.kept for x in Q.judge(docs, model).collect() if not x.base_failed}
    assert all(kept == (i % 4 > 0) for i, kept in got.items() if i >= 200)
    mixed = spark.createDataFrame([(0, prose() + "\n" + prose() + "\na | b | c | d | e")], "doc_id long, text string")
    row = Q.judge(mixed, model).first()
    assert row.kept and 0.5 < row.content_share < 1
    assert Q.fit(docs, labels.where("quality = 1")) == Q.Model()


def test_agreement_equals_enumeration():
    import itertools

    r = np.random.default_rng(4)
    model = Q.Model(tuple(r.normal(size=len(Q.FEATURES))), 0.9)
    lines = Q.Lines(["one two three.\n### | |\nmore words here now!\n12 34", "", "single line"])
    x = lines.x[:4] @ np.array(model.weights)
    weigh = lambda ys: np.exp(sum(e / 2 if y else -e / 2 for e, y in zip(x, ys)) + sum(0.45 if a == b else -0.45 for a, b in zip(ys, ys[1:])))
    every = list(itertools.product((0, 1), repeat=4))
    expected = sum(weigh(ys) * sum(a == b for a, b in zip(ys, ys[1:])) for ys in every) / sum(map(weigh, every))
    same, pairs = model.agreement(lines)
    assert pairs == 3 and abs(same - expected) < 1e-9


def test_transitions_are_learned_and_contradictions_left_out(spark):
    good, bad = "This is a full sentence of words.\n" * 6, "| # | $$ |\n" * 6
    mixed = "This is a full sentence of words.\n| # | $$ |\n" * 4
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)] + [(100 + i, mixed) for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    apart = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    both = Q.fit(docs, spark.createDataFrame(labels + [(100 + i, i % 2) for i in range(40)] + [(0, 1)], "doc_id long, quality int"))
    assert apart.stick > both.stick + 0.5 and both.stick > 0
