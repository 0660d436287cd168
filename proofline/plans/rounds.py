"""Iterations over tables: each round's result is checkpointed, so plans stay small and a lost executor costs one round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed and kept in the folder that the cluster names in ``spark.checkpoint.dir``; a session on one machine may do without the setting."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()
