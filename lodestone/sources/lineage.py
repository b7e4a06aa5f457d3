"""Cutting the lineage of tables that grow out of themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the folder that the cluster names in spark.checkpoint.dir: later plans start from its files,
    which every executor can read, so the loss of one costs nothing of what came before, and know how large they are. (An eager
    checkpoint() computes its last stage twice.) Where no folder is named, as in tests, one of our own, but only on a local
    master."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
