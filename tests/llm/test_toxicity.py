import random

import numpy as np

from pyspark.sql import functions as F

from vellum.llm import toxicity as T
from vellum.llm.wordgrid import Grid

LEXICON = [("worthless", False, 2), ("idiot", False, 1), ("scum", False, 0), ("clown", False, 1), ("lowei", True, 0)]


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force():
    r = random.Random(1)
    words = []
    for _ in range(4000):
        w = list(r.choice(LEXICON)[0])
        for _ in range(r.randrange(4)):
            k, c = r.randrange(len(w) + 1), r.choice("aeiowlnxz")
            w[k : k + r.randrange(3)] = [c] * r.randrange(3)
            if len(w) > 3 and r.random() < 0.3:
                w[1], w[2] = w[2], w[1]
        words.append("".join(w) or "x")
    grid = Grid([" ".join(words)], plain=True)
    got = {w: (k, e) for w, k, e in T.Automaton(LEXICON).hits(grid)}
    for i, w in enumerate(words):
        near = [(distance(t, w), k) for k, (t, stem, e) in enumerate(LEXICON) if not stem and distance(t, w) <= e]
        expected = (4, 0) if w.startswith("lowei") else min(near)[::-1] if near else None
        assert got.get(i) == expected, w


def model():
    return T.Model([(*e, 1.0) for e in LEXICON], (-2.0, 3.0, 0.5))


def test_quotation_counts_less_than_abuse():
    quoted, plain, direct, misspelt, leet, none, empty = model().scores(['the word "idiot" is old', "what an idiot here", "you are an idiot", "what an idoit here", "what an 1d10t here", "nothing at all", ""])
    assert none == empty < quoted < misspelt < plain < direct
    assert leet == plain


def table(spark, n=900):
    r = random.Random(2)
    plain = ["".join(r.choice("aeiourstlnm") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "worthless", "clown", "lowei" + r.choice(plain)]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 200_000), (None, "idiot"), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_learns_and_scores_held_out_rows(spark):
    docs, labels = table(spark)
    fitted = T.fit(docs, labels)
    assert {"idiot", "worthless", "clown"} <= {e[0] for e in fitted.entries} and any(e[1] and "lowei".startswith(e[0][:4]) for e in fitted.entries)
    got = T.score(docs, fitted).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).select("tox_score", "toxic").collect()
    assert np.mean([(x.tox_score >= 0.7) == bool(x.toxic) for x in got]) > 0.97
    kept = T.without_toxic(docs, fitted)
    assert kept.columns == docs.columns and 650 < kept.count() < 780
    assert T.score(docs, fitted).count() == docs.count()


def test_misspellings_of_words_that_a_stem_covers(spark):
    forms = ["idiot", "idiots", "idiotic", "idiocy"]
    rows = [(k, f"some plain words {forms[k // 2 % 4] if k % 2 else 'only'} here", k % 2) for k in range(400)]
    entries = T.learn_lexicon(spark.createDataFrame(rows, "row long, text string, y int"))
    assert any(e[1] for e in entries) and {("idiot", 1), ("idiotic", 1)} <= {(e[0], e[2]) for e in entries if not e[1]}
    grid = Grid(["idoit ideot iidiot idiot idiots plain"], plain=True)
    hits = T.Automaton([e[:3] for e in entries]).hits(grid)
    assert sorted((w, edits) for w, _, edits in hits) == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    both = T.Automaton([("idiot", True, 0), ("idiot", False, 1)]).hits(grid)
    assert sorted(both) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0)]


def test_nothing_to_learn_from(spark):
    docs, labels = table(spark, 30)
    fitted = T.fit(docs, labels.where("toxic = 0"))
    assert fitted.entries == [] and {x.tox_score < 0.5 for x in T.score(docs, fitted).collect()} == {True}
    assert T.score(docs.where("doc_id < 0"), fitted).count() == 0


def test_quotations_of_any_length_and_letters_beyond_the_plane():
    model = T.Model([("idiot", False, 0, 1.0), ("\U0001d4f2\U0001d4ed\U0001d4f2\U0001d4f8\U0001d4fd", False, 1, 1.0)])
    far = "thing " * 2000
    texts = [f'he wrote " {far} idiot {far} " so', f"{far} idiot {far}", f'" {far} "\n{far} idiot', f'" {far} idiot', "\U0001d4f2\U0001d4ed\U0001d4f2\U0001d4f8\U0001d4fd you \U0010fffd", ""]
    factors = {doc: f for doc, _, _, f in model.found(texts)[1]}
    assert factors == {0: T.QUOTED, 1: 1.0, 2: 1.0, 3: 1.0, 4: T.ADDRESSED}


def test_forgotten_states_come_back(monkeypatch):
    monkeypatch.setattr(T, "STATES", 5)
    a = T.Automaton(LEXICON)
    texts = ["worthles idiott clwon scum", "lowei idoit", "worthless"]
    whole = [T.Automaton(LEXICON).hits(T.Grid([t], plain=True)) for t in texts]
    assert [a.hits(T.Grid([t], plain=True)) for t in texts] == whole and [a.hits(T.Grid([t], plain=True)) for t in texts] == whole


def test_labels_that_contradict_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(40) for t in ((0, 1) if i % 2 else (1, 1))] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r.y for r in T.training_rows(docs, labels).collect()} == {1}


def test_score_replaces_a_clashing_column(spark):
    docs = spark.createDataFrame([(1, "idiot", "x"), (1, None, None)], "doc_id long, text string, tox_score string")
    got = T.score(docs, T.Model([("idiot", False, 0, 1.0)], (-2.0, 3.0, 0.5)))
    assert got.columns == ["doc_id", "text", "tox_score"] and sorted(r.tox_score > 0.5 for r in got.collect()) == [False, True]
