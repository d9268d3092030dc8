"""Cutting the lineage of iterative plans in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names (``spark.checkpoint.dir``) and read back.

    Lost executors then cost no recomputation of what came before. Where no folder is named, a local master (tests) gets a temporary one;
    a cluster gets an error, as its machines share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="stopwise-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let go of what finished steps left on executors' disks.

    Spark removes the shuffle files of a step once the driver no longer knows it, which it sees only when its memory is collected; long
    chains of small steps would otherwise pile their files up.
    """
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
