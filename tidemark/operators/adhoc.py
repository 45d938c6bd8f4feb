"""Ad-hoc SQL with named parameters over registered tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL over the given tables. Values go in as :name parameters, tables as {name}.
    An error in the query is raised, never turned into an empty result."""
    return spark.sql(sql, args=params or {}, **tables)
