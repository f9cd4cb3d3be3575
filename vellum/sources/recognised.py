"""Recogniser output: JSON of two shapes into the boxes table, and boxes and documents out as JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, dt_polys array<array<array<double>>>"
_POINT = "struct<x:double,y:double>"


def _polygon(points: Column) -> Column:
    """Points as structs; none if anything about them is amiss."""
    made = F.transform(points, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return F.when(F.coalesce(F.forall(points, lambda p: F.size(p) >= 2), F.lit(False)), made).otherwise(F.array().cast(f"array<{_POINT}>"))


def read_named(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """payload: an object with rec_texts, rec_scores and rec_polys (or dt_polys), perhaps under `res`. Adds a row for each
    non-blank text: block_no, text, confidence (0 if missing) and polygon; payload goes."""
    both = F.from_json(F.col(payload), f"{_LIST}, res struct<{', '.join(x.replace(' ', ':', 1) for x in _LIST.split(', '))}>")
    out = raw.withColumn("_p", both).withColumn("_p", F.when(F.col("_p.res").isNotNull(), F.col("_p.res")).otherwise(F.struct("_p.rec_texts", "_p.rec_scores", "_p.rec_polys", "_p.dt_polys")))
    polygons = F.coalesce("_p.rec_polys", "_p.dt_polys")
    row = lambda t, i: F.struct(i.alias("i"), F.trim(t).alias("text"), F.coalesce(F.get("_p.rec_scores", i), F.lit(0.0)).alias("confidence"), _polygon(F.get(polygons, i)).alias("polygon"))
    rows = F.filter(F.transform("_p.rec_texts", row), lambda r: r["text"] != "")
    keep = [c for c in raw.columns if c != payload]
    return out.select(*keep, F.posexplode(rows).alias("block_no", "r")).select(*keep, (F.col("block_no") + 1).alias("block_no"), "r.text", "r.confidence", "r.polygon")


def read_nested(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """payload: [[[polygon, [text, score]], ...]]; a bare string for the pair, or a score that is no number, has confidence 0."""
    items = F.flatten(F.from_json(F.col(payload), "array<array<array<string>>>"))
    pair = lambda x: F.get(x, 1)
    text = lambda x: F.trim(F.when(F.startswith(pair(x), F.lit("[")), F.coalesce(F.get_json_object(pair(x), "$[0]"), F.lit(""))).otherwise(pair(x)))
    score = lambda x: F.coalesce(F.when(F.startswith(pair(x), F.lit("[")), F.get_json_object(pair(x), "$[1]")).try_cast("double"), F.lit(0.0))
    row = lambda x: F.struct(text(x).alias("text"), score(x).alias("confidence"), _polygon(F.from_json(F.get(x, 0), "array<array<double>>")).alias("polygon"))
    rows = F.filter(F.transform(items, row), lambda r: r["text"] != "")
    keep = [c for c in raw.columns if c != payload]
    return raw.select(*keep, F.posexplode(rows).alias("block_no", "r")).select(*keep, (F.col("block_no") + 1).alias("block_no"), "r.text", "r.confidence", "r.polygon")


def lines_json(lines: DataFrame, *keys: str) -> DataFrame:
    """layout.group_lines()' rows as JSON, one text a line: confidences to 4 places, geometry to 1; nulls are left out."""
    box = F.struct(*(F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return lines.select(*keys, "reading_order", F.to_json(F.struct("text", F.round("confidence", 4).alias("confidence"), "languages", box.alias("bbox"))).alias("json"))


def document_json(documents: DataFrame, *keys: str, raw: bool = False) -> DataFrame:
    """documents.with_document()' rows as JSON; the zone's own lines only when asked for."""
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], F.struct(f["value"].alias("value"), f["valid"].alias("valid"), F.round(f["confidence"], 4).alias("confidence")))))
    more = [F.filter(F.array("line1", "line2", "line3"), lambda x: x.isNotNull()).alias("lines")] if raw else []
    return documents.select(*keys, F.to_json(F.struct("mrz_type", "structure_valid", "check_digits_valid", F.round("document_confidence", 4).alias("confidence"), "errors", "warnings", "corrections", fields.alias("fields"), *more)).alias("json"))
