"""Values laid out for lookups by key.

Rows lie in `parts` folders by a hash of the key, sorted by key inside each, with a Parquet bloom filter on the
key. A get computes the folders of its keys, so the scan lists those alone; the keys are in the
filter too, which skips row groups by their range and bloom filter. Keys that come in a table meet the
values folder by folder: the part is a join key, so Spark prunes folders by the parts that occur, and the
values are never shuffled by the key of a table that wants few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KeyValue:
    """A table at `path` with one row per key; `schema` without the part."""

    path: str
    key: str
    schema: T.StructType
    parts: int = 64

    def part(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.parts)).cast("int")

    def write(self, values: DataFrame) -> None:
        """Lay the values out. A part is one sorted run of files, written by as many tasks as it needs."""
        laid = values.select(*self.schema.names).withColumn("part", self.part())
        laid = laid.repartitionByRange("part", self.key).sortWithinPartitions("part", self.key)
        laid.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("part").parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])
        return spark.read.schema(stored).parquet(self.path)

    def get(self, spark: SparkSession, keys: list) -> DataFrame:
        """The rows of the given keys; a key that is not there gives no row."""
        kind = self.schema[self.key].dataType
        asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], T.StructType([T.StructField(self.key, kind)]))
        parts = sorted({r.p for r in asked.select(self.part().alias("p")).collect()})
        found = self.rows(spark).where(F.col("part").isin(parts) & F.col(self.key).isin(keys) if keys else F.lit(False))
        return found.drop("part")

    def lookup(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The rows of the keys in a table's column of that name."""
        wanted = keys.select(self.key).distinct().withColumn("part", self.part())
        return self.rows(spark).join(wanted, ["part", self.key], "left_semi").drop("part")
