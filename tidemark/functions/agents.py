"""Device and browser from a user-agent string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, tested in this order: the first rule with a match wins, so an
# Android tablet is "mobile" and an agent naming both chrome and edge is "chrome".
DEVICE_MARKS = {
    "mobile": ("mobile", "android", "iphone"),
    "tablet": ("tablet", "ipad"),
}
BROWSER_MARKS = ("chrome", "firefox", "safari", "edge")


def device_type(user_agent: Column) -> Column:
    """mobile / tablet / desktop; NULL when there is no user agent."""
    ua = F.lower(user_agent)
    out = F.when(user_agent.isNull(), F.lit(None).cast("string"))
    for device, marks in DEVICE_MARKS.items():
        out = out.when(reduce(Column.__or__, [ua.contains(m) for m in marks]), device)
    return out.otherwise("desktop")


def browser(user_agent: Column) -> Column:
    ua = F.lower(user_agent)
    out = F.when(user_agent.isNull(), F.lit(None).cast("string"))
    for name in BROWSER_MARKS:
        out = out.when(ua.contains(name), name)
    return out.otherwise("other")


def active_device_type(user_agent: Column) -> Column:
    """As device_type, but an unknown agent counts as desktop."""
    return F.coalesce(device_type(user_agent), F.lit("desktop"))
