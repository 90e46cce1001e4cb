"""Durable intermediates in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where nothing is set and Spark runs on one machine."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not shared:
        if known.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="quillstream-")
    if known.isEmpty():
        sc.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
