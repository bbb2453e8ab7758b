"""Structured Streaming use of the stateless text operators.

The reference has no streams; every §2.B scalar operator is a column
expression, so it runs unchanged on a streaming DataFrame.  This module wires
them into a file-source → file-sink stream with an exactly-once checkpoint in
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions import text as TX


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Mention cleaning, word tokens and token count on a (streaming) frame."""
    return (stream.withColumn("clean", TX.clean_mentions(text_col))
            .withColumn("tokens", TX.tokens_basic("clean"))
            .withColumn("n_tokens", F.size("tokens")))


def run_clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     schema: T.StructType | str, text_col: str = "text") -> None:
    """Process every file present in ``source_dir`` (``availableNow``) into a
    parquet sink; the checkpoint makes restarts exactly-once."""
    s = spark.readStream.schema(schema).parquet(source_dir)
    q = (clean_stream(s, text_col).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
