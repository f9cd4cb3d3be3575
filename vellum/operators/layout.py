"""Page layout over positioned boxes: geometry, lines, reading order, regions, suppression of overlapping boxes, and zones
read out of boxes.

A boxes table has keys (of a document), block_no (the input order), text, confidence, polygon (array of x, y) and lang.
Greedy clustering depends on order, so it is a fold over a document's sorted boxes (a page's worth), not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import charset as C
from vellum.functions.checksum import let
from vellum.operators.scan import parse_candidates

LINE, GAP, OVERLAP, LEAST_SCORE = 0.6, 1.2, 0.6, 0.72 * 0.6


def geometry(blocks: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1 (0 without a polygon), width, height, cx, cy, area, angle and has_polygon."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    n = F.coalesce(F.size("polygon"), F.lit(0))
    side = lambda v, f: F.when(n > 0, f(v)).otherwise(0.0)
    out = blocks.withColumns({"x0": side(xs, F.array_min), "y0": side(ys, F.array_min), "x1": side(xs, F.array_max), "y1": side(ys, F.array_max), "has_polygon": n > 0})
    a, b = F.get("polygon", 0), F.get("polygon", 1)
    return out.withColumns(
        {
            "width": F.col("x1") - F.col("x0"),
            "height": F.col("y1") - F.col("y0"),
            "cx": (F.col("x0") + F.col("x1")) / 2,
            "cy": (F.col("y0") + F.col("y1")) / 2,
            "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")),
            "angle": F.when(n > 1, F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))).otherwise(0.0),
        }
    )


def remap(polygon: Column, scale: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] / scale + dx).alias("x"), (p["y"] / scale + dy).alias("y")))


def blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") == ""


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def confident(blocks: DataFrame, least: float) -> DataFrame:
    """Boxes of at least that confidence; any threshold is brought into 0 to 1, and 0 keeps all."""
    least = max(0.0, min(1.0, least))
    return blocks.where(F.col("confidence") >= least) if least else blocks


def right_to_left(text: Column) -> Column:
    """More than half of the letters are of a script that runs so."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.coalesce(F.length(F.regexp_replace(text, r"[^֐-ࣿיִ-﷿&&\p{L}]|\P{L}", "")) / F.nullif(letters, F.lit(0)) > 0.5, F.lit(False))


_BOX = ("cy", "x0", "block_no", "height", "y0", "x1", "y1", "text", "confidence", "lang")


def _pages(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a document: boxes, its non-blank ones in order of (cy, x0). If any has a polygon, those without are left out."""
    usable = geometry(blocks.where(~blank(F.col("text"))))
    boxes = F.array_sort(F.collect_list(F.struct(*_BOX)))
    located = F.array_sort(F.collect_list(F.when(F.col("has_polygon"), F.struct(*_BOX))))
    return usable.groupBy(*keys).agg(boxes.alias("all"), located.alias("located")).select(*keys, F.when(F.size("located") > 0, F.col("located")).otherwise(F.array_sort("all", lambda a, b: a["block_no"] - b["block_no"])).alias("boxes"), (F.size("located") > 0).alias("placed"))


def _fold(boxes: Column, placed: Column, fits, update, new, kind: str) -> Column:
    """Groups in the order of their creation; each box joins the first that it fits."""

    def step(groups: Column, b: Column) -> Column:
        first = F.when(placed, F.array_position(F.transform(groups, lambda g: fits(g, b)), True)).otherwise(0)
        return let(first, lambda at: F.when(at > 0, F.transform(groups, lambda g, i: F.when(i == at - 1, update(g, b)).otherwise(g))).otherwise(F.array_append(groups, new(b))))

    return F.aggregate(boxes, F.array().cast(f"array<{kind}>"), step)


def group_lines(blocks: DataFrame, *keys: str) -> DataFrame:
    """Lines in reading order: keys, reading_order from 0, text, confidence (weighted by length), min_confidence, languages,
    x0, y0, x1, y1 and blocks (numbers, in the order of the line)."""
    pages = _pages(blocks, keys)
    box = pages.schema["boxes"].dataType.elementType.simpleString()
    kind = f"struct<sum:double,n:int,high:double,boxes:array<{box}>>"
    group = lambda s, n, h, b: F.struct(s.alias("sum"), n.cast("int").alias("n"), h.alias("high"), b.alias("boxes"))
    lines = _fold(
        F.col("boxes"),
        F.col("placed"),
        lambda g, b: F.abs(b["cy"] - g["sum"] / g["n"]) <= LINE * F.greatest(g["high"], b["height"], F.lit(1.0)),
        lambda g, b: group(g["sum"] + b["cy"], g["n"] + 1, F.greatest(g["high"], b["height"]), F.array_append(g["boxes"], b)),
        lambda b: group(b["cy"], F.lit(1), b["height"], F.array(b)),
        kind,
    )
    found = pages.select(*keys, F.posexplode(lines).alias("made", "g")).select(*keys, "made", "g.boxes")
    joined = F.array_join(F.transform("boxes", lambda b: b["text"]), "")
    place = lambda b, i: F.struct(F.when(F.col("_rtl"), -b["x0"]).otherwise(b["x0"]).alias("k"), i.alias("i"), b.alias("b"))
    weight = lambda b: F.greatest(F.length(stripped(b["text"])), F.lit(1)).cast("double")
    total = lambda f: F.aggregate("boxes", F.lit(0.0), lambda s, b: s + f(b))
    # summed in the order in which boxes join a line, as the SQL does: another order can differ in the last digit
    sure = total(lambda b: b["confidence"] * weight(b)) / total(weight)
    found = found.withColumns({"_rtl": right_to_left(joined), "_sure": sure}).withColumn("boxes", F.transform(F.array_sort(F.transform("boxes", place)), lambda x: x["b"]))
    each = lambda f: F.transform("boxes", lambda b: b[f])
    found = found.select(
        *keys,
        "made",
        stripped(F.array_join(F.transform("boxes", lambda b: stripped(b["text"])), " ")).alias("text"),
        F.col("_sure").alias("confidence"),
        F.array_min(each("confidence")).alias("min_confidence"),
        F.array_sort(F.array_distinct(F.filter(each("lang"), lambda x: x.isNotNull() & (x != "")))).alias("languages"),
        F.array_min(each("x0")).alias("x0"),
        F.array_min(each("y0")).alias("y0"),
        F.array_max(each("x1")).alias("x1"),
        F.array_max(each("y1")).alias("y1"),
        each("block_no").alias("blocks"),
    )
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "made")) - 1
    return found.withColumn("reading_order", order).drop("made")


def number_regions(lines: DataFrame, *keys: str) -> DataFrame:
    """lines: keys, reading_order, x0, y0, x1, y1. Adds region_no from 0: a line continues the region of the one before if it
    stands close under it and they overlap across."""
    w = Window.partitionBy(*keys).orderBy("reading_order")
    before = {c: F.lag(c).over(w) for c in ("x0", "y0", "x1", "y1")}
    out = lines.withColumns({f"_{c}": v for c, v in before.items()})
    high = F.greatest(F.col("_y1") - F.col("_y0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    joins = (F.col("y0") - F.col("_y1") <= GAP * high) & (F.least("x1", "_x1") - F.greatest("x0", "_x0") > 0)
    out = out.withColumn("_new", F.when(joins, 0).otherwise(1))
    return out.withColumn("region_no", (F.sum("_new").over(w) - 1).cast("int")).drop("_x0", "_y0", "_x1", "_y1", "_new")


def regions(lines: DataFrame, *keys: str) -> DataFrame:
    """group_lines()' result as regions: keys, region_no, text, confidence, line_count and the bounding box."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return number_regions(lines, *keys).groupBy(*keys, "region_no").agg(F.array_join(texts, "\n").alias("text"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("line_count"), *box)


def page_summary(lines: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Of each document: mean, min and max of the lines' confidences, words, readability and whether confidence is low. With
    order, a column, the mean is summed in that order, so that its last digit doesn't hang on how rows are dealt."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    mean = F.avg("confidence")
    if order:
        told = F.array_sort(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct(order, "confidence"))))
        mean = F.aggregate(told, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.nullif(F.count("confidence"), F.lit(0))
    out = lines.groupBy(*keys).agg(mean.alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.sum(words).alias("words"), F.sum(F.length(stripped(F.col("text"))) * F.col("confidence")).alias("readability"))
    return out.withColumn("low_confidence", (F.col("mean") < 0.55) & (F.col("mean") != 0))


def iou(a, b) -> Column:
    """Of two things with x0, y0, x1, y1: intersection over union, 0 where they don't meet."""
    w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    size = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    union = size(a) + size(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def suppress(blocks: DataFrame, *keys: str, threshold: float = OVERLAP) -> DataFrame:
    """Boxes that remain, the most confident first, with rank from 0: one that overlaps a kept box too much goes; boxes
    without a polygon stay."""
    fields = ("block_no", "text", "confidence", "lang", "polygon", "x0", "y0", "x1", "y1", "has_polygon")
    pages = geometry(blocks).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("less"), *fields))).alias("boxes"))
    kind = pages.schema["boxes"].dataType.simpleString()

    def step(kept: Column, b: Column) -> Column:
        return F.when(b["has_polygon"] & F.exists(kept, lambda k: k["has_polygon"] & (iou(k, b) >= threshold)), kept).otherwise(F.array_append(kept, b))

    kept = F.aggregate("boxes", F.array().cast(kind), step)
    return pages.select(*keys, F.posexplode(kept).alias("rank", "b")).select(*keys, "rank", *(F.col(f"b.{f}").alias(f) for f in fields[:5]))


def scan_boxes(blocks: DataFrame, *keys: str) -> DataFrame:
    """The best zone parse out of boxes: lines by their last box, texts joined without spaces, then as in scan.scan_text()
    with candidates tried by confidence and then from the bottom of the page."""
    pages = _pages(blocks, keys)
    box = pages.schema["boxes"].dataType.elementType.simpleString()
    lines = _fold(
        F.col("boxes"),
        F.col("placed"),
        lambda g, b: F.abs(b["cy"] - F.element_at(g["boxes"], -1)["cy"]) <= LINE * F.greatest(F.element_at(g["boxes"], -1)["height"], b["height"], F.lit(1.0)),
        lambda g, b: F.struct(F.array_append(g["boxes"], b).alias("boxes")),
        lambda b: F.struct(F.array(b).alias("boxes")),
        f"struct<boxes:array<{box}>>",
    )

    def line(g: Column, made: Column) -> Column:
        own = F.transform(F.array_sort(F.transform(g["boxes"], lambda b, i: F.struct(b["x0"].alias("k"), i.alias("i"), b.alias("b")))), lambda x: x["b"])
        joined = C.normalize_line(F.array_join(F.transform(own, lambda b: b["text"]), ""))
        cy = F.transform(g["boxes"], lambda b: b["cy"])
        mean = F.aggregate(cy, F.lit(0.0), lambda s, x: s + x) / F.size(cy)
        return let(joined, lambda text: F.struct(F.array_min(cy).alias("top"), made.alias("made"), text.alias("line"), C.line_score(text).alias("score"), mean.alias("y"), F.transform(g["boxes"], lambda b: b["confidence"]).alias("sure")))

    found = pages.select(*keys, F.array_sort(F.transform(lines, line)).alias("lines"))
    n = lambda r: F.length(r["line"])
    row = lambda i, seq, r, text, y: F.struct(i.alias("idx"), seq.alias("seq"), text.alias("line"), r["score"].alias("score"), y.alias("y"), r["sure"].alias("sure"))
    good = F.filter(F.transform("lines", lambda r, i: row(i, F.lit(0), r, r["line"], r["y"])), lambda r: (r["score"] >= LEAST_SCORE) & (n(r) >= 24))
    found = found.select(*keys, good.alias("good"))
    width = lambda r: F.when(n(r).between(87, 89), 44).when(n(r).between(71, 73), 36)
    halves = F.flatten(F.transform(F.filter("good", lambda r: width(r).isNotNull()), lambda r: F.array(row(r["idx"], F.lit(1), r, F.substring(r["line"], F.lit(1), width(r)), r["y"]), row(r["idx"] + 1, F.lit(1), r, F.substring(r["line"], width(r) + 1, n(r)), r["y"] + 1))))
    found = found.select(*keys, F.array_sort(F.concat("good", halves)).alias("rows")).where(F.size("rows") > 1)
    near = lambda i: F.coalesce((i > 0) & (F.get("rows", i)["idx"] - F.get("rows", F.greatest(i - 1, F.lit(0)))["idx"] <= 1), F.lit(False))
    ends = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: ~near(i + 1))

    def tail(i: Column, k: int) -> Column:
        own = F.slice(F.col("rows"), F.greatest(i - k + 2, F.lit(1)), F.lit(k))
        sure = F.flatten(F.transform(own, lambda r: r["sure"]))
        score = F.aggregate(own, F.lit(0.0), lambda s, r: s + r["score"]) / k
        return F.struct((-score).alias("less"), (-F.array_max(F.transform(own, lambda r: r["y"]))).alias("up"), F.transform(own, lambda r: r["line"]).alias("lines"), (F.aggregate(sure, F.lit(0.0), lambda s, x: s + x) / F.size(sure)).alias("ocr_confidence"))

    two = lambda i: F.when(near(i), tail(i, 2))
    three = lambda i: F.when(near(i) & near(i - 1), tail(i, 3))
    groups = F.filter(F.flatten(F.transform(ends, lambda i: F.array(three(i), two(i)))), lambda g: g.isNotNull())
    ordered = F.array_sort(F.transform(groups, lambda g, i: F.struct(g["less"].alias("less"), g["up"].alias("up"), i.alias("i"), g["lines"].alias("lines"), g["ocr_confidence"].alias("ocr_confidence"))))
    candidates = found.select(*keys, F.posexplode(ordered).alias("cand_no", "c")).select(*keys, "cand_no", "c.lines", "c.ocr_confidence")
    return parse_candidates(candidates, *keys)
