"""Words looked up in a dictionary inside Arrow batches.

Tokens are hashed in the JVM and reach Python as one list of 64-bit numbers a
row; a part of the dictionary is a sorted array of hashes with its values, and a
row's tokens are found by binary search where the row stands.  No token is
shuffled and no row is regrouped.  A dictionary of any size is looked up in
parts of ``PART_ROWS`` entries, one pass of the column each; only a part is ever
in the driver or a task.

Words are told apart by ``xxhash64``: entries of a dictionary that share a hash
are an error, a foreign token that shares one with an entry (one in 2^64 per
entry) would be taken for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 2_000_000


def lookup(df: DataFrame, tokens: Column, dictionary: DataFrame, word_col: str, value_col: str, out_col: str,
           part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``out_col``: for each token its value in ``dictionary`` (distinct words; int, long or double values),
    null where it has none; null for null tokens."""
    entries = dictionary.select(F.xxhash64(F.col(word_col).cast("string")).alias("h"), F.col(value_col).alias("v")).where("h is not null")
    kind = entries.schema["v"].dataType
    n, distinct = entries.agg(F.count("*"), F.countDistinct("h")).first()
    if n != distinct:
        raise ValueError("words of the dictionary repeat or share a hash")
    out = df.withColumn("_hashes", F.transform(tokens, lambda t: F.xxhash64(t.cast("string")))) \
        .withColumn(out_col, F.lit(None).cast(T.ArrayType(kind)))
    parts = max(1, -(-n // part_rows))
    for k in range(parts):
        part = entries if parts == 1 else entries.where(F.pmod("h", F.lit(parts)) == k)
        out = _found(out, part, out_col)
    return out.drop("_hashes")


def _found(df: DataFrame, part: DataFrame, out_col: str) -> DataFrame:
    got = part.toArrow()        # about ``part_rows`` entries
    h = got.column("h").to_numpy()
    order = np.argsort(h)
    value = got.column("v").combine_chunks().take(pa.array(order))
    handle = df.sparkSession.sparkContext.broadcast((h[order], value.to_numpy(zero_copy_only=False)))
    kind = value.type

    def run(batches):
        known, values = handle.value
        for b in batches:
            lists = b.column("_hashes")
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            mine = lists.flatten().to_numpy(zero_copy_only=False)
            before = b.column(out_col)
            old = before.flatten() if before.null_count < len(before) else pa.nulls(len(mine), kind)
            at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = known[at] == mine if len(known) else np.zeros(len(mine), dtype=bool)
            new = pa.array(values[at] if len(known) else np.zeros(len(mine)), mask=~hit).cast(kind)
            merged = new if old.null_count == len(old) else pa.compute.coalesce(new, old)
            size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(off, mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False)), merged)
            yield pa.RecordBatch.from_arrays([found if c == out_col else b.column(c) for c in b.schema.names], names=b.schema.names)
    return df.mapInArrow(run, df.schema)
