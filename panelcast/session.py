"""Spark session and checkpoint helpers."""

from __future__ import annotations

import os
import pickle
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Partitions of a spread frame: at least so many, and more for more than so many rows in each.
SPREAD_PARTITIONS, SPREAD_ROWS = 16, 250_000


def build_session(master: str | None = None, app: str = "panelcast",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and the UI off.

    On a cluster pass master=None and let spark-submit decide; the shuffle
    partition count then comes from the cluster config (AQE coalesces).
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEMORY", "8g"))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's spark.checkpoint.dir; only set one when it is unset (tests)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        # local runs and tests only: a private scratch folder
        d = tempfile.mkdtemp(prefix="panelcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession, value):
    """Broadcast of a value that may hold objects of this package; `received` gives it back inside a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped):
    return pickle.loads(shipped.value)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Persist a frame that an iterative job (optimiser, search) will re-read.

    Rows go to partitions by a hash of their values and are sorted in them, so that what is
    seeded per partition (bagging) does not depend on the number of cores or on the input's
    files.  The number of partitions is the parameter, or the setting
    panelcast.spread.partitions, or follows from the number of rows (one more, column-pruned, pass).
    """
    from pyspark import StorageLevel
    from pyspark.sql import functions as F
    from pyspark.sql.types import UserDefinedType
    n = int(partitions or df.sparkSession.conf.get("panelcast.spread.partitions", "0"))
    if not n:
        n = max(SPREAD_PARTITIONS, -(-df.count() // SPREAD_ROWS))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, UserDefinedType)]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    return df.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
