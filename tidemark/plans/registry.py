"""The query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare
from tidemark.sources.derive import clickstream, order_events
from tidemark.sources.tables import sliced_stream, table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name with the SQL that must give the same rows."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(lambda spark, root: run(prepare(spark), root), sql)
        return run

    return add


def orders(spark: SparkSession, root: str) -> DataFrame:
    return order_events(table(spark, root, "orders"))


def clicks(spark: SparkSession, root: str) -> DataFrame:
    return clickstream(table(spark, root, "events"))


def visits(spark: SparkSession, root: str) -> DataFrame:
    """The click stream without the page columns."""
    return clickstream(table(spark, root, "events"), pages=False)


def clicks_stream(spark: SparkSession, root: str) -> DataFrame:
    """The click stream in four micro-batches, in the order of event time."""
    return clickstream(sliced_stream(spark, root, "events", "ts", 4))


def text(ts: str | Column) -> Column:
    """A window bound as text, equal in every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def micros(ts: str | Column) -> Column:
    """An event time as an exact number."""
    return F.unix_micros(ts)


def pairs(map_column: str) -> Column:
    """A sorted map as text: a:1,b:2."""
    entries = F.map_entries(map_column)
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","
    )


# Fixed SQL: the order-event log and the click stream, as in sources.derive.
ORDERS_SQL = """
b AS (SELECT o_orderkey k, o_custkey u, CAST(o_totalprice AS DECIMAL(18,2)) a FROM orders),
x AS (
  SELECT concat('c-', CAST(k AS VARCHAR)) event_id, CAST(k AS VARCHAR) order_id,
         'order_created' event_type, a amount, u user_id, 2*k i, k FROM b
  UNION ALL
  SELECT concat('x-', CAST(k AS VARCHAR)), CAST(k AS VARCHAR), 'order_cancelled', a, u, 2*(k+50)+1, k
  FROM b WHERE k % 10 < 3),
oe AS (SELECT event_id, order_id, event_type, amount, user_id, i AS emission,
         1700000000000 + i + (i*7919) % 1000 AS event_time_ms, CAST(k % 4 AS INT) AS partition_id, k FROM x)
"""

T_SQL = """
wm AS (SELECT min(m) - 1000 AS t FROM (SELECT max(event_time_ms) m FROM oe GROUP BY partition_id))
"""

CLICKS_SQL = """
k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
c0 AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, user_id,
    concat(CAST(user_id AS VARCHAR), '-', strftime(ts, '%Y-%m-%d')) AS session_id,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
      WHEN 'signup' THEN 'checkout' ELSE event_type END AS event_type,
    CASE WHEN k % 3 <> 0 THEN concat('e', CAST(k % 5 AS VARCHAR)) END AS event_name, k,
    CASE k % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0'
      WHEN 1 THEN 'Mozilla/5.0 (Linux; Android 13; Tablet) Chrome/119.0'
      WHEN 2 THEN 'Mozilla/5.0 (iPad; CPU OS 17_0) Safari/604.1'
      WHEN 3 THEN 'Mozilla/5.0 (X11; Linux) Firefox/121.0'
      WHEN 4 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edge/120.0' END AS user_agent,
    CASE WHEN k % 2 = 0 THEN concat('/product/', CAST(k AS VARCHAR))
      ELSE concat('/page/', CAST(k AS VARCHAR)) END AS url,
    nullif(substr('USDEFRJPBR', CAST(2*(user_id % 6)+1 AS INT), 2), '') AS country,
    ts, strftime(ts, '%Y-%m-%d') AS date_partition, value
  FROM k0),
clicks AS (
  SELECT *, CASE WHEN country IS NOT NULL THEN concat(country, '-', CAST(user_id % 5 AS VARCHAR)) END AS city
  FROM c0)
"""


def orders_sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ORDERS_SQL, T_SQL, *ctes]) + "\n" + select


def clicks_sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CLICKS_SQL, *ctes]) + "\n" + select
