import collections

import corpus_pipeline as P
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dup import groups
from tests.llm.test_secret_scan import base_spans
from vellum.llm import toxicity

DIR = "/root/testdata/sf0.001"


def leaks(text, items):
    w = words(text)
    for item in items:
        i = words(item)
        n = min(5, len(i))
        mine = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
        if mine and len(mine & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) >= 0.8 * len(mine):
            return True
    return False


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {}
    for name, stage in P.STAGES:
        out = P.cut(stage(spark, docs, DIR), name)
        if name == "packing":
            pieces = collections.Counter()
            for r in out.collect():
                pieces[r.doc_id] += r.length
            assert pieces == {r.doc_id: r.doc_tokens for r in out.collect()} and set(pieces) == set(kept)
            break
        assert out.columns == docs.columns
        if name == "toxicity":
            kept = {d: t for (d, t), s in zip(kept.items(), model.scores(list(kept.values())), strict=True) if s < 0.7}
        elif name == "near_duplicates":
            of = groups(list(kept.items()), 5)
            kept = {d: t for d, t in kept.items() if of[d] == d}
        elif name == "decontamination":
            kept = {d: t for d, t in kept.items() if not leaks(t, items)}
        got[name] = {r.doc_id for r in out.collect()}
        if name == "secrets":
            clean = {d: t for d, t in kept.items() if not base_spans(t)}
            assert got[name] <= set(clean) and len(got[name]) >= 0.99 * len(clean)
            kept = {d: kept[d] for d in got[name]}
        assert got[name] == set(kept), name
        docs = out
    assert {r.doc_id for r in P.run(spark, DIR).collect()} == set(kept)
