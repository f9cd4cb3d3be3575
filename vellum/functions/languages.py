"""Names of languages and of models, and lists in settings."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a language is called by callers, and by the engine.
ALIASES = {
    "en": "en", "eng": "en", "english": "en", "latin": "en", "ar": "arabic", "ara": "arabic", "arabic": "arabic",
    "fr": "fr", "de": "german", "es": "es", "ru": "ru", "ch": "ch", "chinese": "ch", "japan": "japan", "korean": "korean",
}
API_ALIASES = {k: v for k, v in ALIASES.items() if v in ("en", "arabic")}


def _looked_up(own: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), own), own)


def _bare(lang: Column) -> Column:
    return F.lower(F.regexp_replace(lang, r"(?U)^\s+|\s+$", ""))


def resolve_lang(lang: Column) -> Column:
    """The engine's name of a language; none given is English, a blank one stays blank."""
    return _looked_up(_bare(F.when(F.coalesce(lang, F.lit("")) == "", "en").otherwise(lang)), ALIASES)


def normalise_lang(lang: Column) -> Column:
    """The name that requests are taken by, which knows two languages."""
    return _looked_up(_bare(lang), API_ALIASES)


def model_override(value: Column, lang: Column) -> Column:
    """A bare model name is for every language; of `lang:model,...` the first pair for this one counts. Null where none does."""
    own = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    name = lambda p: F.substring_index(p, ":", 1)
    model = lambda p: F.nullif(F.trim(F.substring(p, F.length(name(p)) + 2, F.length(p))), F.lit(""))
    pairs = F.transform(F.filter(F.split(own, ","), lambda p: resolve_lang(name(p)) == resolve_lang(lang)), lambda p: F.struct(model(p).alias("m")))
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(~own.contains(":"), own).otherwise(F.get(pairs, 0)["m"])


def parse_languages(raw: Column) -> Column:
    """A comma-separated request as an array; null if nothing is left."""
    parts = F.transform(F.filter(F.split(raw, ","), lambda p: F.trim(p) != ""), normalise_lang)
    return F.when(F.size(parts) > 0, parts)


def parse_list(value):
    """A setting on the driver: a list, its JSON, or `a,b,c`."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if text.startswith("["):
        try:
            return json.loads(text)
        except ValueError:
            text = text.strip("[]")
    return [x.strip() for x in text.split(",") if x.strip()]
