"""Uploads kept by day, and log records as scrubbed JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.redact import redact_map, redact_text

# Extensions by kind.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp"}


def stored(uploads: DataFrame, received: Column) -> DataFrame:
    """uploads with mime: adds day (UTC) and ref, a random name with the kind's extension. write() keeps them under day folders."""
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    ref = F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.coalesce(F.try_element_at(kinds, F.col("mime")), F.lit(".bin")))
    return uploads.withColumns({"day": F.date_format(received, "yyyy-MM-dd"), "ref": ref})


def write(uploads: DataFrame, path: str, received: Column, enabled: bool = False) -> None:
    """Keep uploads by day; nothing is kept unless that is asked for."""
    if enabled:
        stored(uploads, received).write.mode("append").partitionBy("day").parquet(path)


def log_lines(records: DataFrame, service: str, version: str, env: str) -> DataFrame:
    """records: at (timestamp), level, logger, message, request_id, extras (map). One JSON text a row: messages and extras are
    scrubbed, what is null is left out."""
    fields = F.to_json(
        F.struct(
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"), "level", "logger", redact_text(F.col("message")).alias("message"),
            F.lit(service).alias("service"), F.lit(version).alias("version"), F.lit(env).alias("env"), F.nullif("request_id", F.lit("")).alias("request_id"),
        )
    )
    extras = F.to_json(redact_map(F.coalesce("extras", F.create_map().cast("map<string,string>"))), {"ignoreNullFields": "false"})
    both = F.when(extras == "{}", fields).otherwise(F.concat(F.substring(fields, F.lit(1), F.length(fields) - 1), F.lit(","), F.substring(extras, F.lit(2), F.length(extras))))
    return records.select("*", both.alias("json"))
