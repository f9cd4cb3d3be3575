"""The queries of this package's operators, opN_<name>, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from vellum.llm import pii, quality, toxicity, url_filter
from vellum.llm.chat_format import digest_conversations, probe
from vellum.llm.decontaminate import find_leaks
from vellum.llm.near_dup import near_duplicates
from vellum.llm.packing import pack
from vellum.llm.resharding import reshard
from vellum.llm.secret_scan import joined, scan_secrets
from vellum.llm.shared import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest_conversations(given.unionByName(probe(spark)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumnRenamed("tox_score", "score")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(docs))
    base = F.filter("pii_spans", lambda x: ~x["added"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by a hash of the text to eight of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)), F.lit(6))
    found = reshard(docs, old, 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_format, op2_toxicity, op3_pii, op4_packing, op5_quality, op6_resharding, op7_url_filter, op8_secret_scan, op9_decontamination, op10_minhash_near_dup)
    return {f.__name__: f for f in found}


#: Words and 2-word shingles as in the contract, exact intersections of all pairs that share a shingle, then reachability.
OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), ' / ')) AS node, sh FROM s),
u AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM n WHERE n > 0 GROUP BY node),
x AS (SELECT rep, n, unnest(sh) AS sh FROM u),
f AS (SELECT sh, count(*) AS df FROM x GROUP BY sh),
p AS (
  SELECT rep, n, sh FROM (SELECT x.rep, x.n, x.sh, row_number() OVER (PARTITION BY x.rep ORDER BY f.df, x.sh) AS r FROM x JOIN f ON f.sh = x.sh)
  WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1
), c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.sh = b.sh AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (
  SELECT c.a, c.b FROM c JOIN u ua ON ua.rep = c.a JOIN u ub ON ub.rep = c.b
  WHERE 100 * len(list_intersect(ua.sh, ub.sh)) >= 80 * (ua.n + ub.n - len(list_intersect(ua.sh, ub.sh)))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM u UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
nodes AS (SELECT node, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(comp.component_id, n.doc_id) AS component_id, coalesce(comp.component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN nodes ON nodes.node = n.node AND n.n > 0 LEFT JOIN comp ON comp.rep = nodes.rep
"""


#: Exact: every item against every document by shared runs of min(5, words of the item) words: 0.8 or more of them, or all of
#: those of a question of 8 words or more, which is what stands before the last line, or else before the last sentence.
OP9 = r"""
WITH bt AS (SELECT row_number() OVER () AS bid, item_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM benchmark),
bq AS (SELECT bid, item_id, t, CASE WHEN regexp_full_match(t, '(?s)(.*\S)\s*\n(.*)') THEN regexp_extract(t, '(?s)^(.*\S)\s*\n(.*)$', 1)
  WHEN regexp_full_match(t, '(?s)(.*[.?!])\s+(.*)') THEN regexp_extract(t, '(?s)^(.*[.?!])\s+(.*)$', 1) END AS q FROM bt),
bw AS (SELECT bid, item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws, regexp_extract_all(lower(coalesce(q, '')), '[\p{L}\p{N}]+') AS qs, regexp_extract_all(lower(CASE WHEN q IS NULL THEN '' ELSE substr(t, length(q) + 1) END), '[\p{L}\p{N}]+') AS ans FROM bq),
b AS (SELECT bid, item_id, least(5, len(ws)) AS n, list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS sh,
  CASE WHEN len(qs) >= 8 AND len(ans) > 0 THEN list_distinct(list_transform(range(1, len(qs) - 3), lambda i: array_to_string(qs[i:i + 4], ' '))) END AS qsh FROM bw WHERE len(ws) > 0),
bs AS (SELECT bid, item_id, n, len(sh) AS n_shingles, len(qsh) AS n_asked, unnest(sh) AS g, qsh FROM b),
dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
dn AS (SELECT rid, doc_id, ws, n FROM dw, (SELECT DISTINCT n FROM bs)),
ds AS (SELECT DISTINCT rid, doc_id, n, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM dn)
SELECT ds.doc_id, bs.item_id, bs.n_shingles, count(*) AS n_shared FROM ds JOIN bs ON bs.g = ds.g AND bs.n = ds.n
GROUP BY ds.rid, ds.doc_id, bs.bid, bs.item_id, bs.n_shingles, bs.n_asked HAVING count(*) >= 0.8 * bs.n_shingles OR count(*) FILTER (list_contains(bs.qsh, ds.g)) = bs.n_asked
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.sql(), "op9_decontamination": OP9, "op10_minhash_near_dup": OP10}
