import random
import re

from vellum.llm import decontaminate as D

WORDS = re.compile(r"[^\W_]+")


def words(text):
    return WORDS.findall((text or "").lower())


def brute(docs, items):
    out = set()
    for i, item in items:
        w = words(item)
        if not w:
            continue
        n = min(5, len(w))
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text in docs:
            x = words(text)
            both = mine & {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            asked = set()
            question, answer = map(words, D.question_answer(item))
            if answer and len(question) >= 8:
                asked = {tuple(question[k : k + 5]) for k in range(len(question) - 4)}
            if len(both) >= 0.8 * len(mine) or asked and asked <= both:
                out.add((d, i, len(mine), len(both)))
    return out


def data():
    r = random.Random(6)
    vocabulary = ["".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randrange(2, 9))) for _ in range(600)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(8, 60)) + "?\n" + text(r.randrange(1, 9)) + ".") for i in range(90)] + [(90, "one two"), (91, ""), (92, None), (93, items_twice := text(30)), (94, items_twice), (95, text(400))]
    docs = []
    for d in range(300):
        parts = [text(r.randrange(0, 300))]
        if d % 3 == 0:
            own = (items[r.randrange(len(items))][1] or "").split(" ")
            for _ in range(r.randrange(4) if len(own) > 9 else 0):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            parts += [" ".join(own).upper() if d % 2 else "«" + ", ".join(own) + "»", text(r.randrange(0, 200))]
        docs.append((d, " ".join(parts)))
    return docs + [(300, None), (301, ""), (302, "one two"), (303, text(20_000) + " " + items[5][1]), (0, docs[0][1])], items


def test_equals_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, bench).collect()
    expected = brute(docs, items)
    assert {(x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in got} == expected and len(expected) > 60
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in docs if d not in {e[0] for e in expected})


def test_slices_and_empty_tables(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame(docs[:60], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(x.doc_id, x.item_id) for x in D.find_leaks(df, bench).collect()}
    monkeypatch.setattr(D, "INDEX_CHARS", 8000)
    assert {(x.doc_id, x.item_id) for x in D.find_leaks(df, bench).collect()} == whole
    assert D.find_leaks(df, bench.where("item_id < 0")).count() == 0
    assert D.find_leaks(df.where("doc_id < 0"), bench).count() == 0


def test_question_answer():
    assert D.question_answer("Who?\nMe.") == ("Who?", "Me.")
    assert D.question_answer("Who is it? It is me.") == ("Who is it?", "It is me.")
    assert D.question_answer(None) == ("", "")


def test_templated_items_and_lone_questions(spark):
    # 50 items that share 26 words and differ in 4 rare ones: any text of the shared words holds 22 of 26 shingles of each
    shared = " ".join(f"word{k}" for k in range(26))
    items = [(i, shared + " " + " ".join(f"rare{i}x{k}" for k in range(4))) for i in range(50)] + [(50, "why is it that the moon never falls down here?\nBecause it always falls around " + "and around " * 9)]
    docs = [(0, "so " + shared.upper() + " then"), (1, "Why is it that the moon never falls down here"), (2, "why is it that the moon falls down"), (3, " ".join(f"word{k}" for k in range(0, 26, 2)))]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in got} == brute(docs, items) and {(x.doc_id, x.item_id) for x in got} == {(0, i) for i in range(50)} | {(1, 50)}


def test_thresholds_are_never_above_a_verified_score():
    r = random.Random(9)
    for _ in range(60):
        base = [f"w{r.randrange(40)}" for _ in range(r.randrange(6, 40))]
        items = [(i, " ".join(w if r.random() < 0.8 else f"v{r.randrange(99)}" for w in base)) for i in range(12)]
        index = D.Index(items)
        texts = []
        for _, item in items:
            w = item.split()
            a = r.randrange(len(w) // 4 + 1)
            texts.append(" ".join(["x"] * 3 + w[a : len(w) - r.randrange(len(w) // 4 + 1)] + ["y"] + w[: r.randrange(len(w))]))
        got = {(i, d, n, k) for i, d, n, k, *_ in index.leaks(texts)}
        assert got == brute(list(enumerate(texts)), items)
