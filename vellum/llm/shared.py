"""What the operators of this package share: lineage cuts, code shipping, word rules and Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the operators' contracts: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII upper case to lower case, all else left alone.
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

_SHIPPED, _BATCH = "_vellum_shipped", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per session, so that Python workers can import it."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")  # rows of whole texts are large; the default batch of them fills a worker
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    to = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum_code.zip")
    with zipfile.ZipFile(to, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, base))
    sc.addPyFile(to)
    setattr(sc, _SHIPPED, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-checkpoints-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str = "stage", files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that survives lost executors. files: at most so
    many, for what is known to be small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a cut() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._vellum_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text that a Python worker takes at once: so many bytes, or one row, and so many rows.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 256


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text."""
    texts = batch.column(column) if column in batch.schema.names else None
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if texts is not None and pa.types.is_string(texts.type) else [0] * batch.num_rows
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > SLICE_BYTES or i - at == SLICE_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema, text: str = "text") -> DataFrame:
    """mapInArrow over pieces of bounded text (of the column so called), which bounds a worker's memory whatever the lengths.

    make() runs once per task and returns the function applied to every piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for piece in slices(batch, text):
                out = apply(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: inside a lambda, an expression is evaluated again at each mention."""
    return F.get(F.transform(F.array(value), body), 0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]

