"""Cut lineage: a result written once to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import workspace as ws


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table that survives lost executors."""
    spark = df.sparkSession
    path = ws.fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """What a decision about a row is attached to: its id, or for rows without one their text."""
    return F.coalesce(
        F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))),
    )


def release(df: DataFrame) -> None:
    """Let Spark drop shuffle files of jobs that are over; it does so when the driver collects garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()
