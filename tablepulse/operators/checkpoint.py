"""Results that several parts of a plan read: worked out once, and written where a lost executor does no harm."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut. Without such a folder: on one machine (a local
    master) a temporary one is set, on a cluster ``df`` stays as it is and is worked out where it is read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            return df
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tablepulse-"))
    return df.checkpoint()
