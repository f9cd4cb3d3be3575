"""Several readings of one page: languages, orientations and attempts, and what is kept of them.

A passes table has keys (of a page), pass_no, lang and the boxes of that reading, one row a box, or one row without text for a
reading that found nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.layout import blank, stripped

#: A page that reads better than this is not turned.
READABLE = 20.0


def failed_languages(requested: Column, succeeded: Column) -> Column:
    """A warning for each requested language that isn't among those that succeeded; one asked for twice warns twice."""
    left = F.filter(requested, lambda x: ~F.array_contains(succeeded, x))
    return F.transform(left, lambda x: F.concat(F.lit("language '"), x, F.lit("' could not be processed")))


def merge_results(results: DataFrame, *keys: str) -> DataFrame:
    """results: keys, pass_no, lang, duration_ms, provider, blocks (array). One row for each key: blocks in order of the passes,
    the languages sorted and joined, durations summed, and the first provider that is named."""
    rows = F.array_sort(F.collect_list(F.struct("pass_no", "blocks", "provider")))
    langs = F.array_join(F.array_sort(F.collect_set(F.nullif(F.coalesce("lang", F.lit("")), F.lit("")))), ",")
    named = F.get(F.filter(F.transform("_rows", lambda r: F.coalesce(r["provider"], F.lit(""))), lambda p: p != ""), 0)
    out = results.groupBy(*keys).agg(rows.alias("_rows"), langs.alias("lang"), F.sum("duration_ms").alias("duration_ms"))
    return out.select(*keys, F.flatten(F.transform("_rows", lambda r: r["blocks"])).alias("blocks"), "lang", "duration_ms", F.coalesce(named, F.lit("")).alias("provider"))


def block_mean(blocks: DataFrame, *keys: str) -> DataFrame:
    """Mean confidence of the boxes that hold text, 0 without any."""
    return blocks.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~blank(F.col("text")), F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))


def confident(blocks: DataFrame, least: float, *keys: str) -> DataFrame:
    """Of each page: the number of boxes that a threshold above 0 drops, and the warning about it (null for none)."""
    least = max(0.0, min(1.0, least))
    dropped = F.count_if(F.coalesce(F.col("confidence") < least, F.lit(False))) if least else F.lit(0).cast("long")
    out = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), dropped.alias("dropped"))
    return out.withColumn("warning", F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" block(s) dropped below min_confidence"))))


def best_orientation(passes: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """passes: keys, turns (0 to 3 quarter turns), text, confidence. The turn that reads best and its score: the upright one if
    that is readable, else the first of those with the highest score. With order, a column, each score is summed in that order,
    so that turns whose scores agree but for the last digit aren't chosen by how rows are dealt."""
    own = F.length(stripped(F.col("text"))) * F.col("confidence")
    total = F.coalesce(F.sum(own), F.lit(0.0))
    if order:
        told = F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct(F.col(order).alias("o"), own.alias("s")))))
        total = F.aggregate(told, F.lit(0.0), lambda s, x: s + x["s"])
    scores = passes.groupBy(*keys, "turns").agg(total.alias("score"))
    upright = F.max(F.when(F.col("turns") == 0, F.col("score"))).over(Window.partitionBy(*keys))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when((F.col("turns") == 0) & (F.col("_upright") >= READABLE), 0).otherwise(1), F.desc("score"), "turns"))
    return scores.withColumn("_upright", upright).withColumn("_nth", nth).where("_nth = 1").select(*keys, "turns", "score")


def first_match(attempts: DataFrame, *keys: str) -> DataFrame:
    """attempts: keys, region (rank), attempt (order of languages), has_text, parsed. The first region and attempt that parses,
    in that order; in a region, an attempt that reads something ends it, parsed or not."""
    reads = F.row_number().over(Window.partitionBy(*keys, "region").orderBy("attempt"))
    told = attempts.where(F.coalesce(F.col("has_text"), F.lit(False))).withColumn("_read", reads).where("_read = 1 and parsed")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("region"))
    return told.withColumn("_nth", nth).where("_nth = 1").select(*keys, "region", "attempt")
