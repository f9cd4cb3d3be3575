"""Normalisation of names, numbers and free text, and measures of scripts and likeness."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.charset import ARABIC_DIGITS, EXTENDED_DIGITS, by_character, unmarked

# Classes of characters.
ARABIC_LETTERS = "ء-غف-يٮ-ۓ"
ARABIC_MARKS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭـ"


def normalise_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + EXTENDED_DIGITS, "0123456789" * 2)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n]]", "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def has_arabic(text: Column) -> Column:
    return text.rlike(f"[{ARABIC_LETTERS}]")


def _share(text: Column, drop: str) -> Column:
    own = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    return F.when(F.length(own) > 0, F.length(F.regexp_replace(own, drop, "")) / F.length(own)).otherwise(0.0)


def arabic_ratio(text: Column) -> Column:
    return _share(text, f"[^{ARABIC_LETTERS}]")


def latin_ratio(text: Column) -> Column:
    return _share(text, "[^A-Za-z]")


#: Letters that a mark after them makes another letter; marks of another class may stand between, of the same one not.
_COMPOSED = {"آ": "آ", "أ": "أ", "ؤ": "ؤ", "إ": "إ", "ئ": "ئ", "ۀ": "ۀ", "ۂ": "ۂ", "ۓ": "ۓ"}


def _composed(text: Column) -> Column:
    """The Arabic letters of text with the marks that belong to them."""
    marks = [c for c in map(chr, (*range(0x300, 0x370), *range(0x600, 0x700), *range(0x8D0, 0x900))) if unicodedata.combining(c)]
    out = text
    for two, one in _COMPOSED.items():
        letter, mark = unicodedata.normalize("NFD", two)
        between = "".join(c for c in marks if unicodedata.combining(c) != unicodedata.combining(mark))
        out = F.regexp_replace(out, f"{letter}([{between}]*){mark}", f"{one}$1")
    return F.when(text.rlike("[\u0653-\u0655]"), out).otherwise(text)


def _long_enough(text: Column) -> Column:
    return F.when(F.length(F.replace(text, F.lit(" "), F.lit(""))) >= 2, text)


def normalise_arabic_name(text: Column) -> Column:
    """Without marks, punctuation and other scripts; the forms of letters stay. Null if nothing Arabic is left."""
    out = F.regexp_replace(strip_control(_composed(text)), f"[{ARABIC_MARKS}]", "")
    out = collapse_ws(F.regexp_replace(out, f"[^{ARABIC_LETTERS}\\s]", " "))
    return _long_enough(F.when(has_arabic(out), out))


def fold_arabic(text: Column) -> Column:
    """For comparison only."""
    return F.replace(F.translate(F.coalesce(normalise_arabic_name(text), F.lit("")), "أإآةىؤئ", "اااهيوي"), F.lit(" "), F.lit(""))


def normalise_latin_name(text: Column) -> Column:
    out = by_character(text, unmarked)
    return _long_enough(collapse_ws(F.regexp_replace(F.replace(F.upper(out), F.lit("<"), F.lit(" ")), "[^A-Za-z' -]", " ")))


def normalise_passport_number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(normalise_digits(text)), "[^A-Z0-9]", ""), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(collapse_ws(F.coalesce(text, F.lit(""))), " "), lambda t: t != ""))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the larger of two sets that both have."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def split_scripts(text: Column) -> tuple[Column, Column]:
    """(Latin words, Arabic words) of a text in both scripts."""
    latin = F.array_join(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z'\-.]*)"), 1), " ")
    arabic = collapse_ws(F.array_join(F.regexp_extract_all(text, F.lit("([؀-ۿݐ-ݿ\\s]+)"), 1), ""))
    return latin, arabic
