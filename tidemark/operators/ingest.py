"""Ingest requests: split valid from invalid, unfold batches, count outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ingest import batch_reject_reasons, enrich, reject_reasons
from tidemark.schemas import INGEST_BATCH
from tidemark.sources.wire import parse_once


def validate(requests: DataFrame) -> DataFrame:
    """All requests with `reject_reasons`; an empty array means accepted."""
    return requests.withColumn("reject_reasons", reject_reasons())


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reject_reasons") == 0).drop("reject_reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reject_reasons") > 0)


def single_events(requests: DataFrame, received_at: Column, id_columns: list[str]) -> DataFrame:
    """Accepted single requests, enriched."""
    return enrich(accepted(validate(requests)), received_at, "api", id_columns)


def parse_batches(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON batch requests -> batch_id, events, batch_reject_reasons. A missing batch id is made
    from the content of the request."""
    parsed = parse_once(lines.drop("batch_id", "events"), value, INGEST_BATCH, {})
    made = F.concat(F.lit("batch_"), F.substring(F.sha2(F.col(value), 256), 1, 32))
    return parsed.select(
        *[c for c in parsed.columns if c not in (value, "batch_id", "events")],
        F.coalesce("batch_id", made).alias("batch_id"),
        "events",
        batch_reject_reasons(F.col("events")).alias("batch_reject_reasons"),
    )


def unfold_batches(batches: DataFrame) -> DataFrame:
    """One row per event of an accepted batch, with its index. A request is taken or refused as
    a whole, which the arrays decide without a shuffle."""
    legal = batches.where(F.size("batch_reject_reasons") == 0).drop("batch_reject_reasons")
    rest = [c for c in legal.columns if c != "events"]
    return legal.select(*rest, F.posexplode("events").alias("batch_index", "e")).select(
        *rest, "batch_index", "e.*"
    )


def refused_batches(batches: DataFrame) -> DataFrame:
    return batches.where(F.size("batch_reject_reasons") > 0)


def batch_events(batches: DataFrame, received_at: Column) -> DataFrame:
    """Enriched events of the accepted batches."""
    return enrich(unfold_batches(batches), received_at, "batch_api", ["batch_id", "batch_index"])


def batch_outcomes(sent: DataFrame, ok: Column) -> DataFrame:
    """Processed and failed events of every batch, from a per-row flag."""
    return sent.groupBy("batch_id").agg(
        F.count_if(ok).alias("processed_count"), F.count_if(~ok).alias("failed_count")
    )
