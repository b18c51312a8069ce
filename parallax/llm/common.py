"""Shared helpers of the training-data operators: table reads, Arrow mapping over whole texts, and stages in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .word_index import byte_slices

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(n)


def hash_share(*columns: str) -> Column:
    """A number from 0 to 1 that depends on the columns' values alone, evenly spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / float(1 << 32)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of the warehouse only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what staged() has written for df, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/stage-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark removes the shuffle files of each of a query's steps when the step ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """mapInArrow where make() builds a worker's state once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def attach(df: DataFrame, columns: list[str], text_col: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str, limit: int = 4_000_000, beside: str | None = None) -> DataFrame:
    """(row, *fields): row is a struct of `columns`, so that no names can clash, and the fields are what make()(texts) gives for a slice
    of about `limit` bytes of texts; with `beside`, the name of a column, make()(texts, its values as strings). make() builds a worker's state once per task. Spark bounds a batch by its bytes
    (spark.sql.execution.arrow.maxBytesPerBatch)."""
    names = ["row", *StructType.fromDDL(fields).names]
    row = F.struct(*[named(c) for c in columns] or [F.lit(1)]).alias("row")
    at = columns.index(text_col) if text_col in columns and df.schema[text_col].dataType == StringType() else None
    # A text that is carried along anyway goes to the task once.
    more = [named(beside).cast("string").alias("beside")] if beside else []
    rows = df.select(row, *more) if at is not None else df.select(row, *more, named(text_col).cast("string").alias("text"))
    before = len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        pool = pa.default_memory_pool()  # keeps what is freed, unless it is asked for it
        for batch in batches:
            texts = batch.column(1 + before) if at is None else batch.column(0).field(at)
            for a, b in byte_slices(texts, limit):
                others = [c.slice(a, b - a) for c in batch.columns[1 : 1 + before]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *step(texts.slice(a, b - a), *others)], names)
            pool.release_unused()

    return rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL(fields).fields]))


def unpacked(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of found.row and the fields beside it; a column of row that has the name of a field (in any case) gives way to it."""
    fields = [c for c in found.columns if c != "row"]
    taken = {c.lower() for c in fields}
    return found.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken], *fields)
