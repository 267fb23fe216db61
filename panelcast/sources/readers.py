"""Panel ingest.

Stata files are decoded by a bulk ingest job: ``binaryFile`` lists the
files, each task decodes its files with pandas in bounded chunks and
yields Arrow batches in the declared schema (mapInPandas).  The steady
state is the Parquet copy written by ``ingest_to_parquet``.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows decoded per batch inside a task (bounds task memory for big files).
STATA_CHUNK_ROWS = 100_000


def _schema(spark: SparkSession, schema) -> StructType:
    if isinstance(schema, StructType):
        return schema
    return spark.createDataFrame([], schema).schema


def read_stata(spark: SparkSession, path: str, schema, glob: str = "*.dta") -> DataFrame:
    """Stata .dta files under ``path`` as a DataFrame with ``schema``.

    Only the schema's columns are kept (projection at decode time); a
    missing column fails the task with the file name.
    """
    st = _schema(spark, schema)
    names = [f.name for f in st.fields]

    def decode(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with pd.read_stata(io.BytesIO(bytes(content)), chunksize=STATA_CHUNK_ROWS,
                                   convert_categoricals=False) as reader:
                    for chunk in reader:
                        missing = [c for c in names if c not in chunk.columns]
                        if missing:
                            raise ValueError(f"{p}: missing columns {missing}")
                        yield chunk[names]

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInPandas(decode, st)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header; the declared columns by name, cast to their types (no inference pass).

    The file may hold other columns and another order; a missing column fails.
    """
    raw = spark.read.option("header", True).csv(path)
    fields = _schema(spark, schema).fields
    missing = [f.name for f in fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def read_whitespace(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """S3: headerless whitespace-delimited text; names and types assigned by position."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).filter(F.length(F.trim(F.col("value"))) > 0)
    return lines.select(*[parts.getItem(i).cast(t).alias(n) for i, (n, t) in enumerate(columns)])


def ingest_to_parquet(df: DataFrame, out: str, partition_by: list[str] | None = None) -> None:
    """Write the decoded panel once as Parquet (optionally partitioned by period)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)


def load_study(spark: SparkSession, study, base_dir: str, schema=None) -> DataFrame:
    """Read one study's panel: its own columns, without the sentinel's and null rows.

    ``schema`` (DDL or StructType) is required for Stata and CSV input; the
    whitespace format takes names from the study and doubles for values.
    Keys and covariates that the study names are kept; rows with a null in one of
    them are dropped, as the studies do.
    """
    from panelcast.operators.clean import drop_sentinel
    path = f"{base_dir.rstrip('/')}/{study.path}"
    if study.fmt == "whitespace":
        df = read_whitespace(spark, path, [(c, "double") for c in study.columns])
    elif study.fmt == "csv":
        df = read_csv(spark, path, schema)
    else:
        df = read_stata(spark, path, schema, glob=study.path.rsplit("/", 1)[-1])
    if study.sentinel:
        df = drop_sentinel(df, *study.sentinel)
    keys = [study.unit, study.period, study.item, study.cluster, *study.spec().categorical]
    wanted = [c for c in dict.fromkeys([study.label, *study.covariates, *filter(None, keys)])
              if c in df.columns and c not in study.drop_from_x]
    missing = [c for c in (study.label, *study.covariates) if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*wanted).na.drop()
