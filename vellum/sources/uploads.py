"""Uploaded files, as read by Spark's binaryFile source: kind by signature, and the first reason to refuse one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST, SMALLEST, MOST_PIXELS, LEAST_SIDE = 10 * 1024 * 1024, 256, 50_000_000, 320
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
#: Fixed signatures, in the order in which they are tried.
SIGNATURES = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))


def read_uploads(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """doc_id, filename, size_bytes and content of the files under a path that Spark can read. The content of files beyond
    `largest` is not read (the source skips it by the listing) but they keep their row, with null content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    small = files.where(F.col("length") <= largest).select(F.col("path").alias("doc_id"), name, F.col("length").alias("size_bytes"), "content")
    large = files.where(F.col("length") > largest).select(F.col("path").alias("doc_id"), name, F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def sniff(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for signature, kind in reversed(SIGNATURES):
        out = F.when(F.startswith(head, F.lit(signature)), kind).otherwise(out)
    return out


def extension_allowed(filename: Column) -> Column:
    """No name and no extension pass."""
    own = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[^./]*)$", 1))
    return (own == "") | own.isin(*EXTENSIONS)


def validate(uploads: DataFrame) -> DataFrame:
    """uploads: filename, content, width, height (null while undecoded), and size_bytes where content may be left unread. Adds
    size_bytes, mime and error_code (null: accepted)."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    size = F.coalesce("size_bytes", size) if "size_bytes" in uploads.columns else size
    out = uploads.withColumns({"size_bytes": size, "mime": sniff(F.col("content"))})
    error = (
        F.when(F.col("size_bytes") == 0, "INVALID_IMAGE")
        .when(F.col("size_bytes") > LARGEST, "IMAGE_TOO_LARGE")
        .when(F.col("size_bytes") < SMALLEST, "IMAGE_TOO_SMALL")
        .when(~extension_allowed(F.col("filename")), "UNSUPPORTED_FORMAT")
        .when(F.col("mime").isNull(), "UNSUPPORTED_FORMAT")
        .when(F.col("width").cast("long") * F.col("height") > MOST_PIXELS, "IMAGE_TOO_LARGE")
        .when(F.least("width", "height") < LEAST_SIDE, "IMAGE_TOO_SMALL")
    )
    return out.withColumn("error_code", error)
