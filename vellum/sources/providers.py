"""Recognisers and zone parsers behind names, and the fan-out of pages over languages.

A recogniser is a Python object that each worker makes once; recognise() runs it over a table of images in Arrow batches. The
scripted one gives the boxes it was told, for tests and dry runs.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<text:string,confidence:double,polygon:array<struct<x:double,y:double>>,lang:string>"


class Provider(ABC):
    """What reads an image in one language: boxes as dicts of text, confidence and polygon."""

    name = "base"

    @abstractmethod
    def languages(self) -> Sequence[str]: ...

    @abstractmethod
    def recognise(self, image: bytes, lang: str) -> list[dict]: ...

    def info(self) -> dict:
        return {"provider": self.name, "languages": list(self.languages())}

    def close(self) -> None:
        """Let go of what the object holds."""


class Scripted(Provider):
    name = "stub"

    def __init__(self, boxes: dict[str, list[dict]] | None = None):
        self.boxes = dict(boxes or {})

    def languages(self) -> Sequence[str]:
        return ["en", "arabic"]

    def recognise(self, image: bytes, lang: str) -> list[dict]:
        return [b | {"lang": lang} for b in self.boxes.get(lang, [])]


class Registry:
    """Factories by name, whatever its case."""

    def __init__(self, kind: str):
        self.kind, self.made = kind, {}

    def register(self, name: str, factory: Callable) -> None:
        self.made[name.strip().lower()] = factory

    def names(self) -> list[str]:
        return sorted(self.made)

    def create(self, name: str):
        own = (name or "").strip().lower()
        if own not in self.made:
            raise ValueError(f"unknown {self.kind} {own!r}; known: {', '.join(self.names())}")
        return self.made[own]()


providers, parsers = Registry("provider"), Registry("parser")
providers.register("stub", Scripted)


def _zone_parser():
    from vellum.operators import scan

    return scan


for _name in ("icao9303", "icao"):
    parsers.register(_name, _zone_parser)


def recognise(images: DataFrame, factory: Callable[[], Provider], languages: Sequence[str], key: str = "doc_id") -> DataFrame:
    """images: key and content. A row for each image and language: key, pass_no, lang, provider, blocks, and error where that
    language failed (its blocks are then none, and other languages go on)."""
    rows = images.select(key, "content", F.posexplode(F.array(*map(F.lit, languages))).alias("pass_no", "lang"))
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        made = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("polygon", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("lang", pa.string())]))
        try:
            for batch in batches:
                blocks, errors = [], []
                for content, lang in zip(batch.column("content").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    try:
                        blocks.append(provider.recognise(content, lang))
                        errors.append(None)
                    except Exception as e:  # whatever a recogniser raises is that language's failure
                        blocks.append([])
                        errors.append(str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("pass_no"), batch.column("lang"), pa.array([provider.name] * batch.num_rows), pa.array(blocks, made), pa.array(errors, pa.string())], [key, "pass_no", "lang", "provider", "blocks", "error"])
        finally:
            provider.close()

    return rows.mapInArrow(run, f"{key} {kind}, pass_no int, lang string, provider string, blocks array<{BLOCK}>, error string")
