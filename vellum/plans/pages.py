"""Queries over derived boxes, hits, texts and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.dates import parse_free_date
from vellum.operators import labels as V
from vellum.operators import layout as L
from vellum.operators import ratelimit as R
from vellum.operators import redact as X
from vellum.plans import derive, sql
from vellum.sources import recognised, uploads

BOX = ("x0", "y0", "x1", "y1")


def block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.geometry(derive.blocks(spark, sf_dir))
    moved = F.get(L.remap(F.col("polygon"), F.lit(2.0), F.lit(1.0), F.lit(3.0)), 2)
    return g.select("doc_id", "block_no", *BOX, "width", "height", "cx", "cy", "area", "angle", moved["x"].alias("moved_x"), moved["y"].alias("moved_y"))


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of boxes that count as lines, from the top of the page."""
    from pyspark.sql import Window

    g = L.geometry(derive.blocks(spark, sf_dir))
    lines = g.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("y0", "x0", "block_no")) - 1).alias("reading_order"), "text", "confidence", *BOX)
    out = L.regions(lines, "doc_id")
    return out.select("doc_id", "region_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("confidence", 6).alias("confidence"), "line_count", *BOX)


def layout_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.page_summary(derive.blocks(spark, sf_dir), "doc_id")
    return s.select("doc_id", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most", "readability")), "words", "low_confidence")


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.geometry(derive.blocks(spark, sf_dir)).select("doc_id", "block_no", *BOX)
    a, b = g.alias("a"), g.alias("b")
    value = L.iou({c: F.col(f"a.{c}") for c in BOX}, {c: F.col(f"b.{c}") for c in BOX})
    joined = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.block_no") < F.col("b.block_no")) & (value > 0))
    return joined.select(F.col("a.doc_id").alias("doc_id"), F.col("a.block_no").alias("first"), F.col("b.block_no").alias("second"), F.round(value, 9).alias("iou"))


def _zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of every damage class as boxes: the first line in two halves, the second whole, and a heading above."""
    z = derive.damaged_zones(spark, sf_dir)
    box = lambda n, text, x, y, w: F.struct(F.lit(n).alias("block_no"), text.alias("text"), F.lit(0.9).alias("confidence"), F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + 20), (x, y + 20)))).alias("polygon"), F.lit("en").alias("lang"))
    boxes = F.array(box(1, F.substring("line1", 21, 24), 300, 702, 300), box(2, F.lit("REPUBLIC"), 40, 40, 90), box(3, F.substring("line1", 1, 20), 20, 700, 270), box(4, F.col("line2"), 20, 740, 580))
    return z.select("o_orderkey", F.explode(boxes).alias("b")).select("o_orderkey", "b.*")


def boxes_scan_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.scan_boxes(_zone_boxes(spark, sf_dir), "o_orderkey")
    return found.select("o_orderkey", "mrz_type", "document_number", "surname", "structure_valid", "check_digits_valid", F.round("ocr_confidence", 6).alias("ocr_confidence"))


def _label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a value for each order, by its key modulo 4: beside, below, in one box, or without a value."""
    z = derive.table(spark, sf_dir, "orders").join(derive.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    k = F.col("o_orderkey") % 4
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = lambda n, text, x, y, w: F.struct(F.lit(n).alias("block_no"), text.alias("text"), F.lit(0.9).alias("confidence"), F.array(point(x, y), point(x + w, y), point(x + w, y + 20), point(x, y + 20)).alias("polygon"))
    lit = F.lit
    label = F.when(k == 2, F.concat(lit("Issuing Authority / "), "c_mktsegment")).otherwise("Issuing Authority")
    value = F.when(k < 2, F.col("c_mktsegment")).otherwise("12 JAN 2020")
    boxes = F.array(box(1, label, lit(300), lit(100), lit(120)), box(2, value, F.when(k == 1, 310).otherwise(100), F.when(k == 1, 130).otherwise(101), lit(80)), box(3, lit("Nationality"), lit(300), lit(300), lit(80)))
    return z.select("o_orderkey", F.explode(boxes).alias("b")).select("o_orderkey", "b.*")


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extract(_label_boxes(spark, sf_dir), "o_orderkey")


def labels_without_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing_labels(_label_boxes(spark, sf_dir), "o_orderkey")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id")


def ratelimit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_window(_hits(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), 3, 86_400).select("key", "event_id", "allowed", "retry_after")


def ratelimit_sliding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sliding_log(_hits(spark, sf_dir), 3, 86_400).select("key", "event_id", "allowed", "retry_after")


def redact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = derive.damaged_zones(spark, sf_dir)
    message = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" read "), "line1", F.lit(" / "), F.lower("line2"))
    extras = F.create_map(F.lit("Surname"), F.col("line1"), F.lit("note"), F.col("line2"), F.lit("dob"), F.lit(None).cast("string"))
    masked = X.redact_map(extras)
    return z.select("o_orderkey", X.redact_text(message).alias("message"), masked["Surname"].alias("surname"), masked["note"].alias("note"), masked["dob"].alias("dob"))


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derive.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    a, b = F.lower("c_name"), F.lower("c_mktsegment")
    messy = F.concat(F.lit("  "), "c_name", F.lit("<\t "), "c_mktsegment", F.lit(" "))
    return c.select("c_custkey", T.collapse_ws(messy).alias("collapsed"), T.normalise_passport_number(messy).alias("number"), T.normalise_latin_name(messy).alias("latin"), F.round(T.latin_ratio(messy), 9).alias("latin_ratio"),
                    F.round(T.similarity(a, b), 9).alias("similarity"), F.round(T.overlap_ratio(T.token_set(F.replace(a, F.lit("#"), F.lit(" "))), T.token_set(F.concat(F.lit("customer "), b))), 9).alias("shared"))


def free_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = derive.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate")
    layouts = F.get(F.array(F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit("issued "), F.date_format(d, "d MMM yyyy")), F.date_format(d, "ddMMyyyy"), F.concat(F.date_format(d, "dd.MM.yy"), F.lit(" ok")), F.lit("no date 99/99/2001")), (F.col("o_orderkey") % 6).cast("int"))
    return o.select("o_orderkey", F.date_format(parse_free_date(layouts, "birth", derive.ref()), "yyyy-MM-dd").alias("found"))


def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 1).alias("failures"), F.round(F.sum("value") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("avg_ms"), (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("uptime_s"))


def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = derive.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    head = F.get(F.array(*map(F.lit, ("FFD8FF", "89504E470D0A1A0A", "424D", "49492A00", "4D4D002A", "52494646000000005745425000", "00", ""))), (k % 8).cast("int"))
    body = F.unhex(F.concat(head, F.when(k % 8 == 7, "").otherwise(F.repeat(F.lit("00"), F.when(k % 5 == 0, 10).otherwise(400)))))
    name = F.get(F.array(*map(F.lit, ("a.JPG", "b.png", "c.exe", "", None, "noext"))), (k % 6).cast("int"))
    files = o.select("o_orderkey", body.alias("content"), name.alias("filename"), F.when(k % 7 == 0, 100).otherwise(1000).alias("width"), F.when(k % 11 == 0, 60_000).otherwise(800).alias("height"))
    return uploads.validate(files).select("o_orderkey", "size_bytes", "mime", "error_code")


def recognised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as JSON of either shape, by document, and read again."""
    b = derive.blocks(spark, sf_dir)
    points = F.transform("polygon", lambda p: F.array(p["x"], p["y"]))
    ordered = lambda f: F.transform(F.array_sort(F.collect_list(F.struct("block_no", f.alias("v")))), lambda x: x["v"])
    named = b.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.to_json(F.struct(F.struct(ordered(F.col("text")).alias("rec_texts"), ordered(F.col("confidence")).alias("rec_scores"), ordered(points).alias("rec_polys")).alias("res"))).alias("payload"))
    item = F.concat(F.lit("["), F.to_json(points), F.lit(',["'), "text", F.lit('",'), F.col("confidence").cast("string"), F.lit("]]"))
    nested = b.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.concat(F.lit("[["), F.array_join(ordered(item), ","), F.lit("]]")).alias("payload"))
    both = recognised.read_named(named).unionByName(recognised.read_nested(nested))
    return L.geometry(both).select("doc_id", "block_no", "text", "confidence", *BOX)


QUERIES = (block_geometry, layout_regions, layout_page_summary, iou_pairs, boxes_scan_zone, labelled_fields, labels_without_value, ratelimit_fixed_window, ratelimit_sliding_log, redact_messages, text_normalise, free_dates, engine_stats, upload_validation, recognised_boxes)

BOXES_SQL = """WITH b AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS block_no, p_name AS text, least(round(0.5 + l_discount * 4, 4), 1.0) AS confidence,
    CAST((l_partkey % 20) * 40 AS DOUBLE) AS x0, CAST((l_suppkey % 12) * 18 AS DOUBLE) AS y0, (l_partkey % 20) * 40 + 60 + l_quantity AS x1, CAST((l_suppkey % 12) * 18 + 16 + l_linenumber AS DOUBLE) AS y1
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
IOU_SQL = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"

ORACLES = {
    "block_geometry": f"{BOXES_SQL} SELECT doc_id, block_no, x0, y0, x1, y1, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) * (y1 - y0) AS area, 0.0 AS angle, x1 / 2 + 1 AS moved_x, y1 / 2 + 3 AS moved_y FROM b",
    "layout_regions": f"""{BOXES_SQL}, o AS (SELECT *, row_number() OVER w AS ro, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY y0, x0, block_no)),
n AS (SELECT *, CASE WHEN y0 - py1 <= 1.2 * greatest(py1 - py0, y1 - y0, 1) AND least(x1, px1) > greatest(x0, px0) THEN 0 ELSE 1 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ro) - 1 AS region_no FROM n)
SELECT doc_id, CAST(region_no AS INTEGER) AS region_no, md5(string_agg(text, chr(10) ORDER BY ro)) AS text_md5, round(avg(confidence), 6) AS confidence, count(*) AS line_count, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY doc_id, region_no""",
    "layout_page_summary": f"{BOXES_SQL} SELECT doc_id, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(sum(length(trim(text)) * confidence), 6) AS readability, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))) AS BIGINT) AS words, avg(confidence) < 0.55 AND avg(confidence) <> 0 AS low_confidence FROM b GROUP BY doc_id",
    "iou_pairs": f"{BOXES_SQL}, p AS (SELECT a.doc_id, a.block_no AS first, b.block_no AS second, {IOU_SQL} AS common, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS sizes FROM b a JOIN b ON a.doc_id = b.doc_id AND a.block_no < b.block_no) SELECT doc_id, first, second, round(common / (sizes - common), 9) AS iou FROM p WHERE common > 0",
    "boxes_scan_zone": f"{sql.TD3} SELECT o_orderkey, 'TD3' AS mrz_type, document_number, surname, structure_valid, check_digits_valid, 0.9 AS ocr_confidence FROM d",
    "labelled_fields": "SELECT o_orderkey, 'issuing_authority' AS field, c_mktsegment AS value, 0.9 AS confidence, CASE WHEN o_orderkey % 4 = 2 THEN 'merged' ELSE 'adjacent' END AS source FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 < 3",
    "labels_without_value": "SELECT o_orderkey, 'issuing_authority' AS field FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 3",
    "ratelimit_fixed_window": "SELECT user_id AS key, event_id, row_number() OVER w <= 3 AS allowed, CASE WHEN row_number() OVER w <= 3 THEN 0 ELSE 86400 END AS retry_after FROM events WINDOW w AS (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id)",
    "ratelimit_sliding_log": """WITH RECURSIVE h AS (SELECT user_id AS key, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT key, event_id, n, true AS allowed, [t] AS log, t FROM h WHERE n = 1
  UNION ALL SELECT h.key, h.event_id, h.n, len(list_filter(s.log, lambda x: x >= h.t - 86400)) < 3, CASE WHEN len(list_filter(s.log, lambda x: x >= h.t - 86400)) < 3 THEN list_append(list_filter(s.log, lambda x: x >= h.t - 86400), h.t) ELSE list_filter(s.log, lambda x: x >= h.t - 86400) END, h.t
  FROM s JOIN h ON h.key = s.key AND h.n = s.n + 1) SELECT key, event_id, allowed, CASE WHEN allowed THEN 0 ELSE greatest(1, CAST(trunc(86400 - (t - log[1])) AS INTEGER) + 1) END AS retry_after FROM s""",
    "redact_messages": f"WITH {sql.FIELDS}, {sql.encoded(chr(39) + 'TD3' + chr(39))}, {sql.DAMAGED} SELECT o_orderkey, 'order ' || o_orderkey || ' read ' || regexp_replace(l1, '[A-Z0-9<]{{25,}}', '[REDACTED]', 'g') || ' / ' || regexp_replace(lower(l2), '[A-Z0-9<]{{25,}}', '[REDACTED]', 'g') AS message, '[REDACTED]' AS surname, '[REDACTED]' AS note, CAST(NULL AS VARCHAR) AS dob FROM z".replace("{{25,}}", "{25,}"),
    "text_normalise": """WITH m AS (SELECT *, '  ' || c_name || '<' || chr(9) || ' ' || c_mktsegment || ' ' AS messy, lower(c_name) AS a, lower(c_mktsegment) AS b FROM customer),
n AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(replace(a, '#', ' '), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS ta, list_distinct(string_split('customer ' || b, ' ')) AS tb FROM m)
SELECT c_custkey, trim(regexp_replace(messy, '\\s+', ' ', 'g')) AS collapsed, regexp_replace(upper(messy), '[^A-Z0-9]', '', 'g') AS number, trim(regexp_replace(regexp_replace(replace(upper(messy), '<', ' '), '[^A-Z'' -]', ' ', 'g'), '\\s+', ' ', 'g')) AS latin,
  round(length(regexp_replace(messy, '[^A-Za-z]', '', 'g')) / length(regexp_replace(messy, '\\s', '', 'g')), 9) AS latin_ratio, round(CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity,
  round(len(list_intersect(ta, tb)) / greatest(len(ta), len(tb)), 9) AS shared FROM n""",
    "free_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 4 THEN CASE WHEN year(o_orderdate) % 100 > 31 THEN '00' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(try_strptime('19' || strftime(o_orderdate, '%y-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders",
    "engine_stats": "SELECT event_type, count(*) AS requests, count(*) FILTER (value < 1) AS failures, round(sum(value) / greatest(count(*), 1), 6) AS avg_ms, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS uptime_s FROM events GROUP BY event_type",
    "upload_validation": """WITH f AS (SELECT o_orderkey, o_orderkey % 8 AS k, ['a.JPG', 'b.png', 'c.exe', '', NULL, 'noext'][o_orderkey % 6 + 1] AS name, CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 1000 END AS w, CASE WHEN o_orderkey % 11 = 0 THEN 60000 ELSE 800 END AS h FROM orders),
g AS (SELECT *, CASE WHEN k = 7 THEN 0 ELSE [3, 8, 2, 4, 4, 13, 1][k + 1] + CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 400 END END AS size_bytes, ['image/jpeg', 'image/png', 'image/bmp', 'image/tiff', 'image/tiff', 'image/webp', NULL, NULL][k + 1] AS mime FROM f)
SELECT o_orderkey, size_bytes, mime, CASE WHEN size_bytes = 0 THEN 'INVALID_IMAGE' WHEN size_bytes < 256 THEN 'IMAGE_TOO_SMALL' WHEN name = 'c.exe' THEN 'UNSUPPORTED_FORMAT' WHEN mime IS NULL THEN 'UNSUPPORTED_FORMAT' WHEN w * h > 50000000 THEN 'IMAGE_TOO_LARGE' WHEN least(w, h) < 320 THEN 'IMAGE_TOO_SMALL' END AS error_code FROM g""",
    "recognised_boxes": f"{BOXES_SQL} SELECT doc_id, block_no, trim(text) AS text, confidence, x0, y0, x1, y1 FROM b",
}
