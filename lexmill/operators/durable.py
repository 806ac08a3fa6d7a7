"""Intermediate states that outlive the executors that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse.

    A warehouse in a machine's own file system is shared only where all tasks run on that machine; elsewhere it is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (base.startswith("file:") or "://" not in base) and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
