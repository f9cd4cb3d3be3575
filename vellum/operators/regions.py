"""Bands of a page where a zone may be, out of the boxes of its dark strips; corners in order; angles. No pixels are read here.

A strips table has keys (of a page), box_no, x, y, width and height, and image_width and image_height of the page, in pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bounds of a strip (share of the page's width, height, sides), of strips that are one band, and of the margin around it.
LEAST_SHARE, LEAST_HEIGHT, ASPECT = 0.55, 8, (3.0, 60.0)
GAP, ACROSS = 2.5, 0.6
PAD_X, PAD_Y, FOOT, FOOT_SCORE = 0.02, 0.35, 0.72, 0.05
_BOX = "struct<x:int,y:int,width:int,height:int>"


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for n, c in zip(("x", "y", "width", "height"), (x, y, width, height), strict=True)))


def merge_stacked(strips: DataFrame, *keys: str) -> DataFrame:
    """Strips that stand close under one another and overlap across, as one band each: keys, band_no, x, y, width, height and
    the page's size. What a band has grown to is what the next strip is held against, so a page's strips are folded in order."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "box_no", "x", "width", "height")))
    pages = strips.groupBy(*keys).agg(ordered.alias("strips"), F.max("image_width").alias("image_width"), F.max("image_height").alias("image_height"))

    def step(bands: Column, b: Column) -> Column:
        a = F.element_at(bands, -1)
        across = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
        gap, high = b["y"] - a["y"] - a["height"], F.greatest(a["height"], b["height"])
        joins = (F.size(bands) > 0) & (across > ACROSS * F.least(a["width"], b["width"])) & (gap <= GAP * high) & (gap > -high)
        x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
        both = _box(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)
        return F.when(joins, F.array_append(F.slice(bands, F.lit(1), F.greatest(F.size(bands) - 1, F.lit(0))), both)).otherwise(F.array_append(bands, _box(b["x"], b["y"], b["width"], b["height"])))

    # element_at(-1) of an empty array is null, so the first strip begins the first band
    bands = F.aggregate("strips", F.array().cast(f"array<{_BOX}>"), lambda s, b: F.when(F.size(s) == 0, F.array(_box(b["x"], b["y"], b["width"], b["height"]))).otherwise(step(s, b)))
    return pages.select(*keys, "image_width", "image_height", F.posexplode(bands).alias("band_no", "b")).select(*keys, "band_no", "b.*", "image_width", "image_height")


def band_score(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Wide, flat and low on the page is what a zone is."""
    share, aspect, middle = width / image_width, width / height, (y + height / 2.0) / image_height
    return F.least(share, F.lit(1.0)) * 0.45 + F.least(aspect / 20.0, F.lit(1.0)) * 0.2 + F.greatest(F.lit(0.0), middle - 0.4) * 0.6


def expanded(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """The box with its margin, inside the page."""
    dx, dy = F.floor(width * PAD_X), F.floor(height * PAD_Y)
    x0, y0 = F.greatest(F.lit(0), x - dx), F.greatest(F.lit(0), y - dy)
    return _box(x0, y0, F.least(image_width, x + width + dx) - x0, F.least(image_height, y + height + dy) - y0)


def zone_bands(strips: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """The best `most` bands of each page that has strips, then its foot as a last resort: keys, rank from 0, x, y, width,
    height, score and source."""
    size = (F.col("image_width"), F.col("image_height"))
    good = strips.where((F.col("height") >= LEAST_HEIGHT) & (F.col("width") >= LEAST_SHARE * F.col("image_width")) & (F.col("width") / F.col("height")).between(*ASPECT))
    own = [F.col(c) for c in ("x", "y", "width", "height")]
    scored = merge_stacked(good, *keys).select(*keys, "band_no", band_score(*own, *size).alias("score"), expanded(*own, *size).alias("b"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "band_no"))
    best = scored.withColumn("rank", nth - 1).where(F.col("rank") < most).select(*keys, "rank", "b.*", "score", F.lit("morphology").alias("source"))
    pages = strips.groupBy(*keys).agg(F.max("image_width").alias("image_width"), F.max("image_height").alias("image_height"))
    counts = best.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    top = F.floor(F.col("image_height") * FOOT)
    foot = pages.join(counts, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("rank"), F.lit(0).alias("x"), top.cast("int").alias("y"), F.col("image_width").cast("int").alias("width"), (F.col("image_height") - top).cast("int").alias("height"), F.lit(FOOT_SCORE).alias("score"), F.lit("fallback").alias("source"))
    return best.unionByName(foot)


def order_corners(points: Column) -> Column:
    """Four points (x, y) as top left, top right, bottom right, bottom left: the least and greatest of the sum and of the
    difference of their coordinates; of equal ones the first."""
    def least(by) -> Column:
        return F.get(F.array_sort(F.transform(points, lambda p, i: F.struct(by(p).alias("k"), i.alias("i"), p.alias("p")))), 0)["p"]

    return F.array(least(lambda p: p["x"] + p["y"]), least(lambda p: p["y"] - p["x"]), least(lambda p: -(p["x"] + p["y"])), least(lambda p: p["x"] - p["y"]))


def skew(angles: DataFrame, *keys: str, most: float = 15.0) -> DataFrame:
    """angles: keys, angle in degrees of each line found. The page's skew is their median, 0 under a quarter of a degree or of
    fewer than three usable lines."""
    usable = F.when(F.abs("angle") <= most, F.col("angle"))
    middle = F.median(usable)
    return angles.groupBy(*keys).agg(F.when((F.count(usable) >= 3) & (F.abs(middle) >= 0.25), middle).otherwise(0.0).alias("skew"))
