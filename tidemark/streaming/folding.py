"""Views over micro-batches that do not read all of them.

A view reduces rows to one per key by a merge that may be applied again to its own results: the newest row,
a sum. Batches are folded into a base, `base=N`, that stands for all batches up to N, every `every` batches;
readers take the newest base and the batches after it, never more than `every` of them. A base is
written aside and published by one rename, and what it stands for stays where it is until `drop_folded`
takes it away, so a reader that listed the folders before sees the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark import workspace as ws
from tidemark.streaming.sinks import publish_batch

Merge = Callable[[DataFrame], DataFrame]


def _numbers(spark: SparkSession, table: str, kind: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in ws.child_names(spark, table) if n.startswith(f"{kind}="))


@dataclass(frozen=True)
class Folded:
    """A table of batches with a merge; `every`: batches between two bases."""

    merge: Merge
    every: int = 16

    def folders(self, spark: SparkSession, table: str) -> list[str]:
        """What a reader has to read: a base, if there is one, and the batches after it."""
        bases = _numbers(spark, table, "base")
        newest = bases[-1] if bases else -1
        tail = [n for n in _numbers(spark, table, "batch_id") if n > newest]
        return [f"{table}/base={newest}"] * bool(bases) + [f"{table}/batch_id={n}" for n in tail]

    def rows(self, spark: SparkSession, table: str) -> DataFrame:
        """One row per key over all batches."""
        found = self.folders(spark, table)
        if not found:
            raise FileNotFoundError(f"nothing published in {table}")
        return self.merge(spark.read.parquet(*found))

    def add(self, batch: DataFrame, table: str, batch_id: int) -> bool:
        """Publish a merged batch, and a base when it is time; False if the batch was published before."""
        added = publish_batch(self.merge(batch), table, batch_id)
        spark = batch.sparkSession
        # Also after a repeated batch: a job that died between the two goes on with the base.
        if len(self.folders(spark, table)) > self.every:
            self.fold(spark, table)
        return added

    def fold(self, spark: SparkSession, table: str) -> None:
        """Write the base of all batches so far."""
        number = _numbers(spark, table, "batch_id")[-1]
        staged = f"{table}/_staging/base-{uuid.uuid4().hex}"
        self.rows(spark, table).write.parquet(staged)
        if not ws.publish(spark, staged, f"{table}/base={number}"):
            ws.drop_folder(spark, staged)

    def drop_folded(self, spark: SparkSession, table: str) -> int:
        """Remove bases and batches that the newest base stands for, but the newest batch, which tells a
        repeated batch from a new one; how many. For when no reader is at work on them."""
        bases, batches = _numbers(spark, table, "base"), _numbers(spark, table, "batch_id")
        old = [f"{table}/base={n}" for n in bases[:-1]]
        old += [f"{table}/batch_id={n}" for n in batches[:-1] if bases and n <= bases[-1]]
        return sum(ws.drop_folder(spark, path) for path in old)
