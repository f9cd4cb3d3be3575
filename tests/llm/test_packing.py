import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vellum.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer():
    r = random.Random(4)
    parts = ["Hello", "it's", "I'LL", "über", "ÀÉ", "don't!", "x1y22", "...", "'", "''s", "été,", "<|endoftext|>", "a" * 300, "日本", "é", " ", "\x1c", "\x85", "İ", "ſ", "\x7f", "½", "×", "_~`"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "\t "]) for _ in range(r.randrange(40))) for _ in range(500)] + ["", " "]
    texts += ["x<|endoftext|>y", "a <|STARTOFTEXT|> b", "wörd " * 30_000, "x" * 200_000]
    words, plain = P.WordIds(PATH), Tokenizer.from_file(PATH)
    assert words.splits
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert words.ids(texts) == expected
    assert words.ids(texts) == expected  # again, with what it remembers
    words.splits = False  # as for a file that splits otherwise
    assert words.ids(texts) == expected


def test_memories_turn_over(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    words, plain = P.WordIds(PATH), Tokenizer.from_file(PATH)
    for t in ["one two three four five", "one six", "seven one two", "one two three four five six"] * 2:
        assert words.ids([t])[0] == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_combinations_by_use_and_for_wide_windows():
    lengths = np.arange(1, 8192)
    found = P.combinations(lengths, np.ones(len(lengths), dtype=int), 8192)
    assert len(found) >= 3000 and (found.sum(axis=1) == 8192).all() and (found[:, 2] == 0).sum() == 4096
    few = P.combinations(np.array([2, 3, 5]), np.array([9, 1, 9]), 10, most=2)
    assert few.tolist() == [[5, 5, 0], [5, 3, 2]]


def test_repeated_rows_spread_over_bins(spark, monkeypatch):
    monkeypatch.setattr(P, "BIN", 16)
    df = spark.range(400).selectExpr("1L AS doc_id", "'one same text' AS text")
    got = P.pack(df, PATH).collect()
    assert len(got) == 400 and len({r.sequence_id >> 32 for r in got}) > 10


def test_plan_is_a_partition_with_little_padding():
    r = random.Random(5)
    lengths = [min(2048, 1 + int(r.expovariate(1 / 600))) for _ in range(6000)]
    found = P.plan(lengths)
    assert sorted(i for s in found for i in s) == list(range(len(lengths)))
    totals = [sum(lengths[i] for i in s) for s in found]
    assert max(totals) <= 2048
    assert sum(2048 - t for t in totals if t & (t - 1)) < 0.005 * sum(totals)
    assert P.plan([]) == [] and P.plan([5]) == [[0]]


def test_solve_is_least_squares():
    columns = [[0, 1], [0, 0, 2], [1, 2]]
    x = P.solve(columns, np.array([7.0, 3.0, 2.0]), 500)
    a = np.array([[1, 2, 0], [1, 0, 1], [0, 1, 1]], dtype=float)
    grad = a.T @ (a @ x - np.array([7.0, 3.0, 2.0]))
    assert (x >= 0).all() and (grad > -0.2).all() and (abs(grad[x > 0.05]) < 0.2).all()


def test_pack(spark):
    texts = ["word " * n for n in (0, 1, 5, 3000, 2047, 2048, 700)] + [None, "same text", "same text", "Ünï £ 日本 é"]
    df = spark.createDataFrame([(i if i < 9 else 8, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = P.pack(df, PATH).collect()
    words = P.WordIds(PATH)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append(x)
    for own in by.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048 and own[0].padding == (0 if at & (at - 1) == 0 else 2048 - at)
    for i, t in enumerate(texts[:8]):
        ids = np.append(np.frombuffer(words.ids([t or ""])[0], dtype="<u4"), np.uint32(1))
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == list(np.cumsum([0] + [x.length for x in own[:-1]])) and sum(x.length for x in own) == len(ids) == own[0].doc_tokens
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].astype("<u4").tobytes()) for x in own)
    assert sum(x.doc_id == 8 for x in got) == 3
    assert P.pack(df.where("doc_id < 0"), PATH).count() == 0
