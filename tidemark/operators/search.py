"""Event search: any query word in type, name, properties or URL, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates two words.
SEPARATORS = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def property_text(properties: Column) -> Column:
    """The values of a flat JSON object as one text."""
    return F.concat_ws(" ", F.map_values(F.from_json(properties, "map<string,string>")))


def search_index(events: DataFrame) -> DataFrame:
    """The searchable form: one row per event id (the newest wins), its words, its month.

    Tokens are cut once, when a row is indexed; `month` is the partition column.
    """
    order = F.struct("ts", *[c for c in ("event_type", "event_name", "url") if c in events.columns])
    newest = events.groupBy("event_id").agg(F.max_by(F.struct(*events.columns), order).alias("e")).select("e.*")
    return with_words(newest)


def with_words(events: DataFrame) -> DataFrame:
    """Every row with its words and its month."""
    text = F.concat_ws(" ", "event_type", "event_name", property_text(F.col("properties")), "url")
    return events.withColumn("words", F.array_distinct(words(text))).withColumn(
        "month", F.date_format("ts", "yyyy-MM")
    )


def query_words(q: str) -> Column:
    return words(F.lit(q))


def search(index: DataFrame, q: str) -> DataFrame:
    """All hits: a scan with a filter, no shuffle."""
    return index.where(F.arrays_overlap("words", query_words(q)))


def search_page(hits: DataFrame, size: int = 10, start: int = 0) -> DataFrame:
    """One page of hits, newest first. Each task keeps at most start + size rows."""
    return hits.orderBy(F.col("ts").desc(), F.col("event_id")).offset(start).limit(size)


def search_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total"))


def index_count(indexed: DataFrame) -> DataFrame:
    """Rows per monthly partition."""
    return indexed.groupBy("month").agg(F.count(F.lit(1)).alias("events"))
