"""Two-step aggregates that are the same on a table and on a stream.

`partial` groups by the output keys plus one value of a counted column. It is an ordinary
aggregate: on a table it combines map-side before the shuffle, on a stream it keeps one small
state row per value instead of one huge set per window, and a window that holds a third of the
data is spread over its values. `finish` merges these rows into the result. On a stream the
first step runs under a watermark in append mode, which hands over all rows of a closed window
together, and the second step runs on each such batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Rollup:
    """An aggregate as partial + finish; calling it on a table runs both.

    `carry(new, earlier)` completes columns of new rows that depend on rows finished before, and
    `remember(rows)` keeps of them what later ones will depend on.
    """

    partial: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    carry: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    remember: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.finish(self.partial(df))


@dataclass(frozen=True)
class Measure:
    """A mergeable number: how it is computed over rows and how two of them merge."""

    column: Column
    merge: str = "sum"


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter typed events (event time `ts`).

    On a stream the condition is tied to `ts`, which keeps it above the watermark: rows it
    drops still move event time forward, so windows of rare events close on time.
    """
    if df.isStreaming:
        return df.where(F.when(F.col("ts").isNotNull(), condition).otherwise(F.lit(False)))
    return df.where(condition)


def rows() -> Measure:
    return Measure(F.lit(1).cast("long"))


def rows_where(condition: Column) -> Measure:
    return Measure(F.when(condition, 1).otherwise(0).cast("long"))


def tally(
    df: DataFrame, keys: list[Column | str], measures: dict[str, Measure], dims: dict[str, Column]
) -> DataFrame:
    """Keys x (dim, val) with `n` rows each; the first dim also carries the measures.

    With a single dim no row is multiplied. NULL values are kept for the first dim only,
    because they carry measures; they are never counted as a value.
    """
    names = list(dims)
    first = names[0]
    if len(names) == 1:
        grouped = df.withColumns({"dim": F.lit(first), "val": dims[first].cast("string")})
        carried = {m: s.column for m, s in measures.items()}
    else:
        entries = F.array(
            *[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("val")) for d, c in dims.items()]
        )
        grouped = (
            df.withColumn("_e", F.explode(entries))
            .withColumns({"dim": F.col("_e.dim"), "val": F.col("_e.val")})
            .where((F.col("dim") == first) | F.col("val").isNotNull())
        )
        carried = {m: F.when(F.col("dim") == first, s.column) for m, s in measures.items()}
    return grouped.groupBy(*keys, "dim", "val").agg(
        F.count(F.lit(1)).alias("n"),
        *[_MERGE[measures[m].merge](c).alias(m) for m, c in carried.items()],
    )


def merge_measures(measures: dict[str, Measure]) -> list[Column]:
    return [_MERGE[s.merge](m).alias(m) for m, s in measures.items()]


def distinct_values(dim: str) -> Column:
    """Number of different values of a dim, from tally rows."""
    return F.count(F.when(F.col("dim") == dim, F.col("val")))


def value_counts(dim: str) -> Column:
    """value -> rows, sorted by value, from tally rows. The map is the output row itself; the
    dims used for it (event types, error names) have few values."""
    entry = F.when((F.col("dim") == dim) & F.col("val").isNotNull(), F.struct("val", "n"))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def top_values(tallied: DataFrame, keys: list[str], dim: str, k: int, name: str) -> DataFrame:
    """Per key the k values with most rows (ties: smaller value first), as an array of structs.

    The rank filter is applied before the shuffle as well, so a hot window sends at most k
    rows per task.
    """
    rank = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("val"))
    return (
        tallied.where((F.col("dim") == dim) & F.col("val").isNotNull())
        .select(*keys, "val", "n")
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "val", "n"))).alias("_top"))
        .select(
            *keys,
            F.transform("_top", lambda e: F.struct(e["val"].alias("value"), e["n"].alias("n"))).alias(name),
        )
    )


def split_window(df: DataFrame) -> DataFrame:
    """The window struct `w` as window_start, window_end."""
    rest = [c for c in df.columns if c != "w"]
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)
