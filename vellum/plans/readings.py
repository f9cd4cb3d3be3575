"""Queries over whole pages and several readings of them: lines and regions, bands, turns, languages, limiter keys, JSON, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import languages as G
from vellum.functions.dates import parse_free_date
from vellum.operators import layout as L
from vellum.operators import passes as P
from vellum.operators import ratelimit as R
from vellum.operators import redact as X
from vellum.operators import regions as B
from vellum.plans import derive
from vellum.plans.pages import BOX, BOXES_SQL, IOU_SQL


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.group_lines(derive.blocks(spark, sf_dir), "doc_id")
    return found.select("doc_id", "reading_order", "text", F.round("confidence", 6).alias("confidence"), "min_confidence", *BOX, F.array_join("languages", ",").alias("languages"))


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain of a page: boxes to lines, regions of the lines, and the summary of the lines."""
    lines = L.group_lines(derive.blocks(spark, sf_dir), "doc_id")
    regions = L.regions(lines, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions"), F.max("line_count").alias("longest"))
    s = L.page_summary(lines, "doc_id", order="reading_order").join(regions, "doc_id")
    return s.select("doc_id", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")), "words", "low_confidence", "regions", "longest")


def block_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suppress(derive.blocks(spark, sf_dir), "doc_id", threshold=0.3).select("doc_id", "rank", "block_no", "confidence")


def redact_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' own JSON beside sensitive keys and a run, at two depths."""
    e = derive.table(spark, sf_dir, "events").select("event_id", "props")
    run = F.lit("AB12345678<<<<<<<<<<<<<<<<<<<<<<")
    payload = F.concat(F.lit('{"DOB": "1980-01-01", "name": null, "props": '), F.coalesce("props", F.lit("null")), F.lit(', "in": [{"mrz": {"a": 1}, "said": "x '), run, F.lit('"}, 7]}'))
    return e.select("event_id", X.redact_json(payload).alias("masked"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda i, *xs: F.get(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int"))
    lang = pick(k, " ENG", "ara", "German", "de", "Latin ", "", None, "xx")
    model = pick(n, None, "one_model", "en:latin_rec, arabic:ar_rec", "ar: ,german:g")
    asked = F.concat_ws(",", lang, F.lit(" AR"), F.lit(" "), pick(n, "fr", "", "English"))
    c = derive.table(spark, sf_dir, "customer").select("c_custkey", lang.alias("lang"), model.alias("model"), asked.alias("asked"))
    parsed = G.parse_languages(F.col("asked"))
    warnings = F.array_join(P.failed_languages(parsed, F.array(F.lit("arabic"), F.lit("fr"))), ";")
    return c.select("c_custkey", G.resolve_lang(F.col("lang")).alias("engine"), G.normalise_lang(F.col("lang")).alias("api"), G.model_override(F.col("model"), F.col("lang")).alias("model"), F.array_join(parsed, "+").alias("parsed"), warnings.alias("warnings"))


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of a page of 1000 by 700 out of the boxes' numbers."""
    b = derive.spread(derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    q = F.col("l_quantity").cast("int")
    strips = b.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("box_no"), ((F.col("l_partkey") % 5) * 8).cast("int").alias("x"),
        ((F.col("l_suppkey") % 40) * 16 + F.col("l_linenumber")).cast("int").alias("y"), (500 + q * 8).alias("width"), (6 + q).alias("height"), F.lit(1000).alias("image_width"), F.lit(700).alias("image_height"),
    )
    return strips.distinct()


def zone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.zone_bands(_strips(spark, sf_dir), "doc_id")
    return found.select("doc_id", "rank", "x", "y", "width", "height", F.round("score", 9).alias("score"), "source")


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the boxes, given in another order and leaning, in their own."""
    p = lambda i: F.get("polygon", i)
    lean = F.transform(F.array(p(2), p(0), p(3), p(1)), lambda q: F.struct((q["x"] + q["y"] / 8).alias("x"), q["y"].alias("y")))
    g = derive.blocks(spark, sf_dir).select("doc_id", "block_no", B.order_corners(lean).alias("o"))
    return g.select("doc_id", "block_no", *(F.get("o", i)[c].alias(f"{c}{i}") for i in range(4) for c in "xy"))


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn at which an order's lines read best, a line's number modulo 4 standing for the turn."""
    text = F.repeat(F.lit("ab "), F.col("l_quantity").cast("int") % 7)
    # boxes in the order of the table, in which the SQL, on one thread, sums them too
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    b = derive.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4).cast("int").alias("turns"), text.alias("text"), F.col("l_discount").alias("confidence"), place.alias("place"))
    return P.best_orientation(b, "doc_id", order="place").select("doc_id", "turns", F.round("score", 6).alias("score"))


def band_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derive.table(spark, sf_dir, "lineitem")
    b = b.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).cast("int").alias("region"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("attempt"), (F.col("l_suppkey") % 3 > 0).alias("has_text"), (F.col("l_partkey") % 2 == 0).alias("parsed"))
    return P.first_match(b, "doc_id")


def page_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of both languages merged, with what a threshold drops and the mean of the boxes that hold text."""
    b = derive.blocks(spark, sf_dir)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    results = b.groupBy("doc_id", "lang").agg(texts.alias("blocks"), F.count(F.lit(1)).alias("duration_ms"))
    results = results.select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("pass_no"), "lang", "duration_ms", F.when(F.col("lang") == "ar", "second").alias("provider"), "blocks")
    merged = P.merge_results(results, "doc_id").select("doc_id", F.md5(F.array_join("blocks", "|").cast("binary")).alias("blocks_md5"), "lang", "duration_ms", "provider")
    return merged.join(P.confident(b, 0.7, "doc_id"), "doc_id").join(P.block_mean(b, "doc_id").withColumn("mean_confidence", F.round("mean_confidence", 6)), "doc_id")


def limiter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = derive.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("user_id")
    forwarded = F.when(u % 2 == 0, F.concat(F.lit(" 192.0.2."), (u % 9).cast("string"), F.lit(", 10.1.1.1")))
    return e.select("event_id", R.limiter_key(F.when(u % 3 == 0, F.col("event_type")), F.concat(F.lit("10.0.0."), u.cast("string")), forwarded, u % 5 > 0).alias("key"))


def free_dates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date of each whole document."""
    d = derive.spread(derive.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.date_format(parse_free_date(F.col("text"), "expiry", derive.ref()), "yyyy-MM-dd").alias("found"))


QUERIES = (layout_lines, layout_pages, block_nms, redact_props, language_codes, zone_bands, corners, page_turns, band_attempts, page_passes, limiter_keys, free_dates_documents)

_RB = BOXES_SQL.replace("WITH b AS", "WITH RECURSIVE b AS", 1)
_LANGS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS no, CASE WHEN l_linestatus = 'O' THEN 'en' ELSE 'ar' END AS lang FROM lineitem JOIN part ON l_partkey = p_partkey)"
_LINES = _RB + f""", o AS (SELECT b.*, lang, (y0 + y1) / 2 AS cy, y1 - y0 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, x0, block_no) AS n FROM b JOIN {_LANGS} k ON k.l_orderkey = doc_id AND k.no = block_no),
f AS (SELECT doc_id, n, [{{'s': cy, 'k': 1, 'high': h, 'ns': [n]}}] AS groups FROM o WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN spot > 0 THEN list_transform(groups, lambda g, i: CASE WHEN i = spot THEN {{'s': g.s + cy, 'k': g.k + 1, 'high': greatest(g.high, h), 'ns': list_append(g.ns, n)}} ELSE g END) ELSE list_append(groups, {{'s': cy, 'k': 1, 'high': h, 'ns': [n]}}) END
  FROM (SELECT o.doc_id, o.n, o.cy, o.h, f.groups, coalesce(list_position(list_transform(f.groups, lambda g: abs(o.cy - g.s / g.k) <= 0.6 * greatest(g.high, o.h, 1)), true), 0) AS spot FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)),
w AS (SELECT doc_id, unnest(groups) AS g, generate_subscripts(groups, 1) AS made FROM (SELECT doc_id, groups FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)),
m AS (SELECT doc_id, made, unnest(g.ns) AS n FROM w),
x AS (SELECT m.made, o.* FROM m JOIN o ON o.doc_id = m.doc_id AND o.n = m.n),
l AS (SELECT doc_id, made, string_agg(trim(text), ' ' ORDER BY x0, n) AS text, sum(confidence * greatest(length(trim(text)), 1)) / sum(greatest(length(trim(text)), 1)) AS confidence, min(confidence) AS min_confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM x GROUP BY doc_id, made),
ll AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, made) - 1 AS reading_order FROM l)"""
_FIRST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY {}) = 1"

ORACLES = {
    "layout_lines": f"{_LINES} SELECT doc_id, reading_order, text, round(confidence, 6) AS confidence, min_confidence, x0, y0, x1, y1, languages FROM ll",
    "layout_pages": f"""{_LINES}, q AS (SELECT *, lag(x0) OVER v AS px0, lag(x1) OVER v AS px1, lag(y0) OVER v AS py0, lag(y1) OVER v AS py1 FROM ll WINDOW v AS (PARTITION BY doc_id ORDER BY reading_order)),
nr AS (SELECT doc_id, reading_order, CASE WHEN y0 - py1 <= 1.2 * greatest(py1 - py0, y1 - y0, 1) AND least(x1, px1) > greatest(x0, px0) THEN 0 ELSE 1 END AS new FROM q),
rg AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY reading_order) AS r FROM nr),
rc AS (SELECT doc_id, count(*) AS regions, max(c) AS longest FROM (SELECT doc_id, r, count(*) AS c FROM rg GROUP BY doc_id, r) GROUP BY doc_id)
SELECT ll.doc_id, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))) AS BIGINT) AS words, avg(confidence) < 0.55 AND avg(confidence) <> 0 AS low_confidence, any_value(regions) AS regions, any_value(longest) AS longest FROM ll JOIN rc ON rc.doc_id = ll.doc_id GROUP BY ll.doc_id""",
    "block_nms": f"""{_RB}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, block_no) AS n FROM b),
f AS (SELECT doc_id, n, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'no': block_no, 'c': confidence}}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT a.doc_id, a.n, CASE WHEN len(list_filter(f.kept, lambda b: {IOU_SQL} > 0 AND {IOU_SQL} >= 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {IOU_SQL}))) > 0 THEN f.kept ELSE list_append(f.kept, {{'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': a.y1, 'no': a.block_no, 'c': a.confidence}}) END FROM f JOIN o a ON a.doc_id = f.doc_id AND a.n = f.n + 1)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS rank, k.no AS block_no, k.c AS confidence FROM (SELECT doc_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM (SELECT * FROM f {_FIRST.format('doc_id', 'n DESC')}))""",
    "redact_props": """SELECT event_id, '{"DOB": "[REDACTED]", "name": null, "props": ' || props || ', "in": [{"mrz": "[REDACTED]", "said": "x [REDACTED]"}, 7]}' AS masked FROM events""",
    "language_codes": """WITH c AS (SELECT c_custkey, [' ENG', 'ara', 'German', 'de', 'Latin ', '', NULL, 'xx'][c_custkey % 8 + 1] AS lang, [NULL, 'one_model', 'en:latin_rec, arabic:ar_rec', 'ar: ,german:g'][c_nationkey % 4 + 1] AS model, ['fr', '', 'English'][c_nationkey % 3 + 1] AS more FROM customer),
d AS (SELECT *, CASE lang WHEN ' ENG' THEN 'en' WHEN 'ara' THEN 'arabic' WHEN 'German' THEN 'german' WHEN 'de' THEN 'german' WHEN 'Latin ' THEN 'en' WHEN 'xx' THEN 'xx' ELSE 'en' END AS engine, CASE lang WHEN ' ENG' THEN 'en' WHEN 'ara' THEN 'arabic' WHEN 'Latin ' THEN 'en' ELSE lower(trim(lang)) END AS api FROM c),
e AS (SELECT *, list_concat(CASE WHEN coalesce(lang, '') = '' THEN [] ELSE [api] END, ['arabic'], CASE more WHEN 'fr' THEN ['fr'] WHEN 'English' THEN ['en'] ELSE [] END) AS asked FROM d)
SELECT c_custkey, engine, api, CASE WHEN model = 'one_model' THEN model WHEN model LIKE 'en:%' THEN CASE engine WHEN 'en' THEN 'latin_rec' WHEN 'arabic' THEN 'ar_rec' END WHEN model LIKE 'ar:%' THEN CASE engine WHEN 'german' THEN 'g' END END AS model, array_to_string(asked, '+') AS parsed,
  array_to_string(list_transform(list_filter(asked, lambda x: x NOT IN ('arabic', 'fr')), lambda x: 'language ' || chr(39) || x || chr(39) || ' could not be processed'), ';') AS warnings FROM e""",
    "zone_bands": f"""WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS box_no, (l_partkey % 5) * 8 AS x, (l_suppkey % 40) * 16 + l_linenumber AS y, 500 + CAST(trunc(l_quantity) AS INTEGER) * 8 AS w, 6 + CAST(trunc(l_quantity) AS INTEGER) AS h FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, box_no, x, w, h) AS n FROM s WHERE h >= 8 AND w >= 550 AND w / h BETWEEN 3 AND 60),
m AS (SELECT doc_id, n, 0 AS band, x, y, w, h FROM g WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN j THEN band ELSE band + 1 END, CASE WHEN j THEN least(mx, x) ELSE x END, CASE WHEN j THEN least(my, y) ELSE y END, CASE WHEN j THEN greatest(mx + mw, x + w) - least(mx, x) ELSE w END, CASE WHEN j THEN greatest(my + mh, y + h) - least(my, y) ELSE h END
  FROM (SELECT g.*, m.band, m.x AS mx, m.y AS my, m.w AS mw, m.h AS mh, least(m.x + m.w, g.x + g.w) - greatest(m.x, g.x) > 0.6 * least(m.w, g.w) AND g.y - m.y - m.h <= 2.5 * greatest(m.h, g.h) AND g.y - m.y - m.h > -greatest(m.h, g.h) AS j FROM m JOIN g ON g.doc_id = m.doc_id AND g.n = m.n + 1)),
e AS (SELECT *, least(w / 1000, 1) * 0.45 + least(w / h / 20, 1) * 0.2 + greatest(0, (y + h / 2) / 700 - 0.4) * 0.6 AS score, CAST(floor(w * CAST(0.02 AS DOUBLE)) AS INTEGER) AS dx, CAST(floor(h * CAST(0.35 AS DOUBLE)) AS INTEGER) AS dy FROM (SELECT * FROM m {_FIRST.format('doc_id, band', 'n DESC')})),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, band) - 1 AS rank FROM e),
k AS (SELECT doc_id, rank, greatest(0, x - dx) AS x, greatest(0, y - dy) AS y, least(1000, x + w + dx) - greatest(0, x - dx) AS width, least(700, y + h + dy) - greatest(0, y - dy) AS height, round(score, 9) AS score, 'morphology' AS source FROM t WHERE rank < 3),
every AS (SELECT * FROM k UNION ALL SELECT d.doc_id, coalesce(c, 0), 0, 504, 1000, 196, 0.05, 'fallback' FROM (SELECT DISTINCT doc_id FROM s) d LEFT JOIN (SELECT doc_id, count(*) AS c FROM k GROUP BY doc_id) n ON n.doc_id = d.doc_id)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(score AS DOUBLE) AS score, source FROM every""",
    "corners": f"{BOXES_SQL} SELECT doc_id, block_no, x0 + y0 / 8 AS x0, y0, x1 + y0 / 8 AS x1, y0 AS y1, x1 + y1 / 8 AS x2, y1 AS y2, x0 + y1 / 8 AS x3, y1 AS y3 FROM b",
    "page_turns": f"""WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 4 AS INTEGER) AS turns, sum(length(trim(repeat('ab ', CAST(trunc(l_quantity) AS INTEGER) % 7))) * l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT doc_id, turns, round(score, 6) AS score FROM s {_FIRST.format('doc_id', 'CASE WHEN turns = 0 AND score >= 20 THEN 0 ELSE 1 END, score DESC, turns')}""",
    "band_attempts": f"""WITH a AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INTEGER) AS region, l_linenumber * 100000 + l_partkey AS attempt, l_suppkey % 3 > 0 AS has_text, l_partkey % 2 = 0 AS parsed FROM lineitem),
f AS (SELECT * FROM a WHERE has_text {_FIRST.format('doc_id, region', 'attempt')}) SELECT doc_id, region, attempt FROM f WHERE parsed {_FIRST.format('doc_id', 'region')}""",
    "page_passes": f"""{BOXES_SQL}, g AS (SELECT b.*, lang FROM b JOIN {_LANGS} k ON k.l_orderkey = doc_id AND k.no = block_no), n AS (SELECT *, confidence < 0.7 AS low FROM g)
SELECT doc_id, md5(string_agg(text, '|' ORDER BY lang DESC, block_no)) AS blocks_md5, array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang, count(*) AS duration_ms, CASE WHEN count(*) FILTER (lang = 'ar') > 0 THEN 'second' ELSE '' END AS provider, count(*) AS blocks, count(*) FILTER (low) AS dropped,
  CASE WHEN count(*) FILTER (low) > 0 THEN count(*) FILTER (low) || ' block(s) dropped below min_confidence' END AS warning, round(avg(confidence), 6) AS mean_confidence FROM n GROUP BY doc_id""",
    "limiter_keys": "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN left(sha256(event_type), 16) WHEN user_id % 2 = 0 AND user_id % 5 > 0 THEN 'ip:192.0.2.' || (user_id % 9) ELSE 'ip:10.0.0.' || user_id END AS key FROM events",
}
