"""Stored tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import workspace as ws


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


#: Bytes of a row group in files that streams read: a file is divided at row groups only.
ROW_GROUP = 4 << 20


def sliced_stream(spark: SparkSession, root: str, name: str, order: str, slices: int) -> DataFrame:
    """The same rows as a stream that delivers them in `slices` micro-batches, by ranges of `order`.

    They are written once to the shared folder, a slice as one file for each core, every file a second
    younger than the one before, which is the order a file source reads them in.
    """
    rows = table(spark, root, name)
    path = ws.fresh_folder(spark, f"stream-{name}")
    width = spark.sparkContext.defaultParallelism
    rows.repartitionByRange(slices * width, order).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    for file in ws.child_names(spark, path):
        if file.startswith("part-"):
            ws.set_age(spark, f"{path}/{file}", int(file.split("-")[1]))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", width).parquet(path)
