import collections
import random
import re

from vellum.llm import near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(rows, n):
    """Component id of each doc_id by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        near = collections.Counter(e for s in sets[d] for e in holders[s])
        for e, both in near.items():
            if 100 * both >= 80 * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in sets}


def corpus(n=260):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6))) for _ in range(300)] + ["The"] * 40
    rows = []
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.randrange(4, 160))]
        for _ in range(n // 12):
            own = list(words)
            for _ in range(r.randrange(0, max(2, len(own) // 6))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own).upper() if r.random() < 0.3 else "\n ".join(own))
    rows += ["", None, "one", "ONE", "one two", "x" * 100_000, " ".join(vocabulary * 40)] + [rows[0]] * 30
    return list(enumerate(rows))


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    expected = groups(rows, 2)
    for lists, clusters in ((4096, 1536), (8, 16)):  # the second way all groups are searched in pairs of blocks
        monkeypatch.setattr(N, "LIST_BLOCK", lists)
        monkeypatch.setattr(N, "CLUSTER_BLOCK", clusters)
        got = N.near_duplicates(df).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {d: (len(shingles(t, 2)), expected[d], expected[d] == d) for d, t in rows}


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (None, "q r s t u v"), (None, "q r s t u v"), (4, ""), (5, None), (5, None), (6, "a b")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, row_key string").withColumnRenamed("row_key", "lang")
    got = N.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in got.collect()) == [(0, "q r s t u v"), (1, "a b c d e f g h"), (4, ""), (5, ""), (5, ""), (6, "a b")]
    assert N.deduplicated(df.where("doc_id < 0")).count() == 0
