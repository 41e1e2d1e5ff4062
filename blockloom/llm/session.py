"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back; a lost executor loses none of it.

    The folder is spark.checkpoint.dir of the session; only where that is unset and the master
    is local, as in tests, a temporary one is made.  The shuffles behind df are let go.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    out = df.checkpoint(eager=True)
    let_go(df)
    return out


def let_go(df: DataFrame) -> None:
    """Deletes the shuffle files of df's own plan, whose result is already written or fetched.

    An action on df itself would need them; a frame built on df plans anew and shuffles anew.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return
    context = df.sparkSession.sparkContext._jsc.sc()
    cleaner = context.cleaner()
    if cleaner.isEmpty():  # switched off by spark.cleaner.referenceTracking
        return
    for k in list(plan.context().shuffleIds().keys()):
        cleaner.get().doCleanupShuffle(k, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
