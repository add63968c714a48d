"""Tables that outlive an executor: Parquet in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..core.durable import own_folder


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; one of our own only where it names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or own_folder(spark.sparkContext.master)


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back: what follows neither recomputes nor depends on it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
