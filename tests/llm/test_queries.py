import hashlib
import zlib

from tests.llm.test_pii import plain
from tests.llm.test_quality import counts
from tests.llm.test_secret_scan import base_spans
from vellum.llm import pii, queries
from vellum.llm import secret_scan as S

DIR = "/root/testdata/sf0.001"


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, *_ in spans).encode()).hexdigest()


def test_digests_equal_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = queries.op3_pii(spark, DIR).collect()
    assert len(got) == len(texts) and all(r.base_sha256 == digest(plain(texts[r.doc_id]), pii.KINDS) for r in got)
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == len(plain(texts[r.doc_id])) for r in got)
    got = queries.op8_secret_scan(spark, DIR).collect()
    assert len(got) == len(texts) and all(r.base_sha256 == digest(base_spans(texts[r.doc_id]), S.KINDS) for r in got)
    got = queries.op5_quality(spark, DIR).collect()
    assert len(got) == len(texts) and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id]) for r in got)
    got = queries.op6_resharding(spark, DIR).collect()
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and len(got) == len(texts)
