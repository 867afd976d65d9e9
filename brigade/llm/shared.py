"""Places shared by driver and executors, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees.

    Only in local mode, where all run on this machine, is a folder made if none is named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='brigade-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


_watched: list[list[str]] = []


@contextmanager
def folders():
    """The list of the shared folders named while it is open."""
    _watched.append(made := [])
    try:
        yield made
    finally:
        _watched[:] = [m for m in _watched if m is not made]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete shared folders that nothing reads any more."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, name: str, by: str | None = None, codec: str = "snappy", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.
    ``tidy``: what the write has shuffled is deleted when it's done."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    before = spark.conf.get(_CLEANUP)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        writer.option("compression", codec).parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder with a number for each row, and the number's column, whose
    name no other column has. Decisions on rows can be taken by it where keys are null or repeated."""
    name = "row"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return stash(df.withColumn(name, F.monotonically_increasing_id()), "numbered", codec="zstd"), name


def tagged(df: DataFrame, text: str, key: str) -> DataFrame:
    """Only the key and the text; null texts become empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def byte_batches(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20):
    """Cut a record batch into slices of about ``most`` bytes of text, never through a row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    total, start = 0, 0
    for i, n in enumerate(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += int(n)
    yield batch.slice(start)


def filesystem(uri: str):
    """(pyarrow file system, path) for a folder named by a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, *parts) -> None:
    """Write a whole file under another name, then rename it: a repeated task leaves the same file."""
    fs_, path = filesystem(uri)
    fs_.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    with fs_.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    fs_.move(temp, path)
