"""Cutting lineage where a plan would otherwise stand in another one many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write `df` to the folder of spark.checkpoint.dir, which all executors share, and read it from there.

    Only a session of one machine without that setting, as in tests, gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not folder and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
