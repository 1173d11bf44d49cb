"""Cutting lineage through the folder that the whole cluster shares, and bounding what goes to Python at once."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of texts that are sent to a Python worker at once; Spark's default of 10,000 long texts fills buffers on both sides.
BATCH_ROWS = 1024
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT_ROWS = "10000"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it from there.

    The folder is the one in spark.checkpoint.dir; only a local session without
    that setting, as in tests, gets a temporary one.  A cluster needs the setting.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def cut_and_clear(df: DataFrame) -> DataFrame:
    """`cut`, after which shuffle files that nothing can read any more go from the disk.

    Spark deletes them once the driver's JVM has collected the plans that made
    them.  A driver with memory to spare puts that off for many steps, whose
    files then add up.
    """
    spark = df.sparkSession
    out = cut(df)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def bound_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows at once, unless the session has a number of its own."""
    if spark.conf.get(_ROWS, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
