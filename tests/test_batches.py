"""What one task reads and what a Python worker is handed stay bounded."""

import pyarrow as pa

from sievekit.session import BATCH_BYTES, BATCH_CONF, bound_batches
from sievekit.sources import quoted as Q


def test_batches_are_bounded_by_bytes(spark):
    """Before, 2,000 rows of 100 kB came as one batch of 200 MB."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat(char(65 + id % 26), 100000) as t")
    assert spark.conf.get(BATCH_CONF) == str(BATCH_BYTES)
    got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 2000 * 100_000 and max(got) < 4 * BATCH_BYTES


def test_a_bound_of_the_session_stays(spark):
    spark.conf.set(BATCH_CONF, "123456")
    try:
        bound_batches(spark)
        assert spark.conf.get(BATCH_CONF) == "123456"
    finally:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def test_records_of_a_batch_come_in_slices():
    """A batch of long lines is put together piece by piece, quoted newlines across pieces intact."""
    n, wide = 40, Q.SLICE_BYTES // 4
    lines = [f'{i},"{"x" * wide}' if i % 2 == 0 else f'{"y" * 10}"' for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * n, "start": pa.array([0] * n, pa.int64()), "value": lines})
    out = list(Q._records({("f", 0): 0})(iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) < 4 * Q.SLICE_BYTES
    records = [r for b in out for r in b.column("record").to_pylist()]
    assert records == ["\n".join(lines[i:i + 2]) for i in range(0, n, 2)]
    assert [s for b in out for s in b.column("seq").to_pylist()] == list(range(n // 2))


def test_positions_are_written_by_many_tasks(spark, tmp_path):
    """Files of id ranges: no task writes, or reads, the whole table."""
    from pyspark.sql import functions as F
    from sievekit.plans.registry import QUERIES
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit('a "q"\nb '), F.col("id").cast("string")).alias("text"),
                                       F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["load_examples_by_position"](spark, str(tmp_path))
        rows = {r.uid: (r.text, r.label) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows == {str(i): (f'a "q"\nb {i}', i % 2) for i in range(3000)}
    import glob
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    newest = max(glob.glob(f"{base}/tables/positions_csv-*"), key=lambda p: len(glob.glob(p + "/*.csv")))
    assert len(glob.glob(newest + "/*.csv")) > 1
