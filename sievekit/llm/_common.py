"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.session import ensure_checkpoint_dir


#: Spark's own switch that drops a statement's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the session's checkpoint folder and read it
    back: lineage is cut on storage every executor sees, and later readers get
    column pruning.  The shuffle files of the write are not needed again and go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table ``stash`` wrote, once all that was made from it is written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def text_of(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from columns by name, cast to ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for f in schema for c in [columns[f.name]]], schema=schema)


def local_rows(df: DataFrame, at_most: int) -> list:
    """Collect a table whose size a parameter of the operator bounds; a larger
    one is an error of the caller, never cut."""
    got = df.limit(at_most + 1).collect()
    if len(got) > at_most:
        raise ValueError(f"more than {at_most} rows where a parameter bounds them")
    return got


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
