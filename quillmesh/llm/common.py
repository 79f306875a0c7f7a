"""Shared plumbing of the training-data operators: shared-folder tables and text constants."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters [\x20\x09-\x0D] as a Java character class and as a plain string.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (local tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a re-computation, and values
    such as generated row ids stay the same for every reader.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmesh_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_quillmesh_path", None)
    if path is None:
        return
    delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def text_slices(batch, columns: list[str], rows: int = 256) -> Iterator[tuple]:
    """Small slices of an Arrow batch as Python lists, so that few long texts are held at once."""
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        yield tuple(part.column(c).to_pylist() for c in columns)


def with_row_id(df: DataFrame) -> DataFrame:
    """A row id that is only stable once the frame has been materialised."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def word_count(text) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text column (null: 0), by counting word starts."""
    starts = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "w")
    return F.length(F.regexp_replace(starts, WS_CLASS, "")).cast("long")
