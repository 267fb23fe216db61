"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

#: A run of ASCII white space / a word, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def rows_in_slices(batches, step: int = 512) -> Iterator:
    """Arrow record batches in slices of at most `step` rows (bounds Python memory)."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def smallest_per_class(rows: DataFrame, by: str, order: str, limit: int, salts: int = 16) -> DataFrame:
    """The `limit` rows of smallest `order` of each class, in two levels so that no class meets in one task.

    Spark keeps only `limit` rows a task before each shuffle (row_number with a limit).
    """
    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    first = Window.partitionBy(by, salt).orderBy(order)
    last = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit).drop("_k")
    return rows.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= limit).drop("_k")


def ship(spark: SparkSession, model):
    """Broadcast of a fitted model; `received` gives it back inside a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shipped):
    return pickle.loads(shipped.value)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
