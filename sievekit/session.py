"""Session helpers.

The library never builds its own SparkSession inside an operator: every
operator takes DataFrames and returns DataFrames.  ``local_session`` exists for
tests, the bench and the driver smoke check only.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins (broadcast when a side turns
# out small), coalesces small shuffle partitions and splits skewed join
# partitions.  Arrow is on for every pandas exchange.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Bytes of rows in one Arrow batch, about.  Spark's own bound is 10,000 rows whatever their size, so that what a Python
#: worker holds would grow with long texts.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of about ``BATCH_BYTES``, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "sievekit") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no ports beyond Spark's own)."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    ship_code(spark)
    return spark


def ship_code(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application: Spark sends the
    zip to every executor, so functions run whatever folder a job starts in."""
    sc = spark.sparkContext
    if getattr(sc, "_sievekit_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="sievekit-code-")) / "sievekit.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._sievekit_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent *and* the session runs in local mode (tests,
    bench) is a fresh scratch folder set.  On a cluster an unset directory is an
    error: a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running lineage-cutting operators")
    path = tempfile.mkdtemp(prefix="sievekit-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
