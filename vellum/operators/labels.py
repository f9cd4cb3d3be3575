"""Labelled fields of a page: the label's box, and the value in it, beside it or below it, in Latin or Arabic script.

A boxes table has keys, block_no, text, confidence and polygon. Labels join boxes of the same document only; where they
stand is a residual condition of that join, and what is kept of the candidates is one window per document and field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import split_scripts
from vellum.operators.layout import geometry


@dataclass(frozen=True)
class Spec:
    name: str
    labels: tuple[str, ...]
    script: str  # arabic or latin
    max_chars: int = 80


# The fields, their labels, and labels of other fields.
SPECS = (
    Spec("name_ar", ("الاسم",), "arabic"),
    Spec("issuing_authority_ar", ("مكان الاصدار", "جهه الاصدار"), "arabic", 40),
    Spec("issuing_authority", ("issuingauthority", "issuing authority", "place of issue", "مكان الاصدار", "جهه الاصدار"), "latin", 40),
)
OTHER_LABELS = ("تاريخ الميلاد", "تاريخ الاصدار", "تاريخ الانتهاء", "الجنسيه", "الجنس", "رقم الجواز", "جواز سفر", "date of birth", "date of issue", "date of expiry", "nationality", "passport no", "country code")
ALL_LABELS = tuple(x for s in SPECS for x in s.labels) + OTHER_LABELS
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
ARABIC, LATIN = "[؀-ۿݐ-ݿ]", "[A-Za-z]"


def normalise_arabic(text: Column) -> Column:
    """For matching only: marks go, forms of alef, yeh and teh fall together."""
    out = F.translate(F.regexp_replace(text, "[ً-ْـ]", ""), "أإآٱىة", "اااايه")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def key(text: Column) -> Column:
    return F.lower(normalise_arabic(F.coalesce(text, F.lit(""))))


def fuzzy_prefix(own: Column, label: str) -> Column:
    """An Arabic label of five letters or more with one letter misread, and a word's end after it."""
    if len(label) < 5 or not "؀" <= label[0] <= "ۿ":
        return F.lit(False)
    n = len(label)
    return (F.length(own) >= n) & ((F.length(own) == n) | (F.substring(own, n + 1, 1) == " ")) & (F.levenshtein(F.substring(own, 1, n), F.lit(label)) <= 1)


def label_remainder(text: Column, spec: Spec) -> Column:
    """What stands after the label that a text begins with, as it was read; null if it begins with none."""
    own, out = key(text), F.lit(None).cast("string")
    for label in sorted(spec.labels, key=len):  # the longest is asked first
        ends = F.sequence(F.lit(1), F.greatest(F.least(F.length(text), F.lit(2 * len(label) + 16)), F.lit(1)))
        head = lambda e: key(F.substring(text, F.lit(1), e))  # noqa: B023, E731
        rest = lambda ends: F.coalesce(F.substring(text, F.get(ends, 0) + 1, F.length(text)), F.lit(""))
        exact, near = F.filter(ends, lambda e: head(e) == label), F.filter(ends, lambda e: F.length(head(e)) >= len(label))  # noqa: B023
        out = F.when(F.startswith(own, F.lit(label)), rest(exact)).when(fuzzy_prefix(own, label), rest(near)).otherwise(out)
    return out


def clean(remainder: Column, spec: Spec) -> Column:
    """Without separators, without single letters in front, and only of the field's script."""
    value = F.btrim(remainder, F.lit(" :/\\-|.,"))
    value = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    value = F.regexp_replace(value, r"^(?:\S(?: |$))+", "")
    latin, arabic = split_scripts(value)
    return latin if spec.script == "latin" else arabic


def plausible(value: Column, spec: Spec) -> Column:
    tokens = F.filter(F.split(value, r"\s+"), lambda t: t != "")
    own = key(value)
    no_label = F.lit(True)
    for label in ALL_LABELS:
        no_label = no_label & ~own.contains(label)
    ok = (value != "") & (F.length(value) <= spec.max_chars) & ~value.rlike(r"\p{Nd}") & no_label & (F.size(tokens) > 0)
    ok = ok & F.forall(tokens, lambda t: F.length(F.btrim(t, F.lit(".,'-"))) >= 2)
    if spec.script == "arabic":
        return ok & value.rlike(ARABIC) & (F.length(F.regexp_replace(value, r"(?U)\s", "")) >= 3)
    return ok & value.rlike(LATIN) & ~F.exists(tokens, lambda t: F.btrim(F.lower(t), F.lit(".")).isin(*MONTHS)) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 3)


def overlaps(a, b) -> tuple[Column, Column]:
    """(down, across): what two boxes share, by the lower and by the narrower of them."""
    def one(low: str, high: str) -> Column:
        least = F.least(a[high] - a[low], b[high] - b[low])
        return F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0)) / F.when(least == 0, 1.0).otherwise(least)

    return one("y0", "y1"), one("x0", "x1")


def _labels(blocks: DataFrame) -> DataFrame:
    """A row for each box that begins with a label of a field."""
    hits = [F.struct(F.lit(i).alias("spec"), F.lit(s.name).alias("field"), label_remainder(F.col("text"), s).alias("rest")) for i, s in enumerate(SPECS)]
    return blocks.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h["rest"].isNotNull()))).select("*", "_hit.*").drop("_hit")


def _values(spec: Column, text: Column) -> tuple[Column, Column]:
    """(value, is it plausible) of a text for the field with that number."""
    value = ok = F.lit(None)
    for i, s in enumerate(SPECS):
        own = clean(text, s)
        value, ok = F.when(spec == i, own).otherwise(value), F.when(spec == i, plausible(own, s)).otherwise(ok)
    return value, ok


def candidates(labels: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """Boxes beside (kind 0) or below (kind 1) each label, with their gap."""
    a, b = labels.alias("a"), blocks.alias("b")
    left, right = {c: F.col(f"a.{c}") for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")}
    down, across = overlaps(left, right)
    gap = right["y0"] - left["y1"]
    beside = (down > 0.5) & (right["x1"] <= left["x1"])
    below = (down <= 0.5) & (gap >= 0) & (gap <= 2.0 * F.greatest(left["y1"] - left["y0"], F.lit(1.0))) & (across > 0.25)
    same = F.col("a.block_no") != F.col("b.block_no")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (beside | below)).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.spec").alias("spec"), F.col("a.field").alias("field"), F.col("a.block_no").alias("label_no"), F.col("b.block_no").alias("block_no"), F.col("b.text").alias("text"),
                                                     F.col("b.confidence").alias("confidence"), F.when(beside, 0).otherwise(1).alias("kind"), F.when(beside, F.abs(left["x0"] - right["x1"])).otherwise(gap).alias("gap"))


def extract(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, field, value, confidence, source (merged: in the label's box; adjacent): of each field, from the first label that
    has a plausible value, its own box before the nearest other."""
    boxes = geometry(blocks).select(*keys, "block_no", "text", "confidence", "x0", "y0", "x1", "y1")
    labels = _labels(boxes)
    value, ok = _values(F.col("spec"), F.col("rest"))
    merged = labels.select(*keys, "spec", "field", F.col("block_no").alias("label_no"), F.lit(-1).alias("kind"), F.lit(0.0).alias("gap"), "block_no", value.alias("value"), "confidence", ok.alias("ok"))
    value, ok = _values(F.col("spec"), F.col("text"))
    near = candidates(labels, boxes, *keys).select(*keys, "spec", "field", "label_no", "kind", "gap", "block_no", value.alias("value"), "confidence", ok.alias("ok"))
    first = Window.partitionBy(*keys, "spec").orderBy("label_no", "kind", "gap", "block_no")
    found = merged.unionByName(near).where("ok").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return found.select(*keys, "field", "value", "confidence", F.when(F.col("kind") < 0, "merged").otherwise("adjacent").alias("source"))


def missing_labels(blocks: DataFrame, *keys: str) -> DataFrame:
    """Fields whose label is on the page but whose value wasn't found."""
    return _labels(geometry(blocks)).select(*keys, "field").distinct().join(extract(blocks, *keys), [*keys, "field"], "left_anti")


def fill_gaps(found: DataFrame, recovered: DataFrame, *keys: str, least: float = 0.80) -> DataFrame:
    """found, and what a second reading recovered with enough confidence of fields that are missing."""
    more = recovered.where(F.col("confidence") >= least).join(found.select(*keys, "field"), [*keys, "field"], "left_anti")
    return found.unionByName(more)
