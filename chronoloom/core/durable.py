"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def own_folder(master: str) -> str:
    """A folder for sessions that name none: only where all tasks run on this machine."""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="chronoloom-")
    raise ValueError("name a folder that all machines share in spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in spark.checkpoint.dir.

    A cluster session without one is refused: a folder of this machine would be missing on
    others. Set spark.cleaner.referenceTracking.cleanCheckpoints to have unused cuts deleted.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(context.master))
    return df.checkpoint(eager=True)
