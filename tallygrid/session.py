"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallygrid", master: str | None = None, partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    ``partitions`` is only for small local runs; on a cluster leave it unset
    and let adaptive execution merge or split shuffle partitions by size.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if driver_memory:  # only counts before the JVM starts
        b = b.config("spark.driver.memory", driver_memory)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores.

    A small file often is one split, so that one core would do all the work.
    Moving it is cheap. Inputs above ``SMALL_INPUT`` bytes (by the optimizer's
    estimate) have splits enough and stay where they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if n > 1 and size <= SMALL_INPUT else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, made known to Spark.

    A private folder is made only on a local master where the setting is
    absent; on a cluster a missing setting is an error, because a machine-local
    folder is lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="tallygrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
