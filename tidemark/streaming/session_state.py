"""Whole session records on a stream: different URLs and the page sequence, without lists in state.

Two chained steps over the state table of streaming.keyed. The first reduces a micro-batch to slots
(facts that merge) and to different (session, page) rows; the second puts slots in order per user,
next to the session a user has open, and decides which sessions are over. State holds one row of facts
for each open session and one row for each different page in it, so a session with any number of
pages is rows, never a list, and a closing session counts its rows.

A page's place in the sequence is known when it arrives: it is written once, as a row of output, and
only the count of pages so far stays in state. A session is named by its user and the time of its first
event when it was opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import sessions as s
from tidemark.sources.offsets import bucket, with_position
from tidemark.streaming.keyed import Job, Write

_PLACE = "ts:timestamp,event_id:string"
_FACTS = (
    f"first:struct<{_PLACE},session_id:string>,end_time:timestamp,event_count:bigint,page_view_count:bigint,"
    f"countries:array<string>,landing:struct<{_PLACE},page:string>,exit:struct<{_PLACE},page:string>,"
    f"agent:struct<{_PLACE},user_agent:string>"
)
_FACT_NAMES = ("first", "end_time", "event_count", "page_view_count", "countries", "landing", "exit", "agent")
#: A row with facts for an open session, and a row with a page for each different page in it.
STATE = f"user_id long, last_activity timestamp, opened timestamp, facts struct<{_FACTS}>, pages_seen long, page string"


def session_job(gap: str = s.GAP) -> Job:
    """Output `sessions`: records of sessions that are over, with `opened`; `pages`: (user_id, opened, position,
    page, ts, event_id) of every page view as it comes."""
    limit = s.gap_micros(gap)
    part_us = s.MINUTE_US if limit % s.MINUTE_US == 0 else limit
    slot = s._slot(gap)
    far_back = F.lit(-(1 << 62))

    def step(rows: DataFrame, state: DataFrame, watermark: int, write: Write) -> DataFrame:
        events = s._user_events(rows)
        held = state.where("facts IS NOT NULL")
        slots = events.withColumn("slot", slot).groupBy("user_id", "slot").agg(*s._facts())
        slots = slots.unionByName(held.select("user_id", far_back.alias("slot"), "facts.*", "opened", "pages_seen"), allowMissingColumns=True)

        # The newest end so far decides, so a late event neither breaks a session nor shortens it.
        before = Window.partitionBy("user_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        silence = F.unix_micros("first.ts") - F.unix_micros(F.max("end_time").over(before))
        along = Window.partitionBy("user_id").orderBy("slot")
        slots = slots.withColumn("_broken", F.when(silence > limit, 1).otherwise(0))
        slots = write("slots", slots.withColumn("session_no", F.sum("_broken").over(along)).drop("_broken"))

        whole = slots.groupBy("user_id", "session_no").agg(
            *s._merged_facts(), F.min("opened").alias("opened"), F.coalesce(F.max("pages_seen"), F.lit(0)).alias("pages_seen")
        )
        whole = whole.withColumn("opened", F.coalesce("opened", "first.ts"))
        later = Window.partitionBy("user_id").orderBy("session_no")
        over = F.lead("session_no").over(later).isNotNull() | (F.unix_micros("end_time") + limit < watermark)

        placed = slots.where(F.col("slot") != far_back).select("user_id", "slot", "session_no")
        views = events.where("page IS NOT NULL").withColumn("slot", slot).join(placed, ["user_id", "slot"])
        different = views.select("user_id", "session_no", "page", F.lit(1).alias("new"))
        known = state.where("page IS NOT NULL").select("user_id", F.lit(0).cast("long").alias("session_no"), "page", F.lit(0).alias("new"))
        different = different.unionByName(known).groupBy("user_id", "session_no", "page").agg(F.sum("new").alias("new"))
        different = write("different", different)
        urls = different.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("unique_urls_count"), F.sum("new").alias("_views"))
        whole = whole.withColumn("over", over).join(urls, ["user_id", "session_no"], "left")
        whole = write("open", whole.fillna(0, ["unique_urls_count", "_views"]))

        cut = bucket(F.unix_micros("ts"), part_us)
        order = [F.col("ts"), F.col("event_id")]
        numbered = with_position(views.select("user_id", "session_no", "page", "ts", "event_id"), ["user_id", "session_no"], order, cut)
        write(
            "pages",
            numbered.join(whole.select("user_id", "session_no", "opened", "pages_seen"), ["user_id", "session_no"]).select(
                "user_id", "opened", (F.col("position") + F.col("pages_seen")).alias("position"), "page", "ts", "event_id"
            ),
        )
        ended = whole.where("over")
        write("sessions", s._derived(ended))

        live = whole.where("NOT over")
        facts = F.struct(*_FACT_NAMES).alias("facts")
        kept = live.select(
            "user_id", F.col("end_time").alias("last_activity"), "opened", facts, (F.col("pages_seen") + F.col("_views")).alias("pages_seen"), F.lit(None).cast("string").alias("page")
        )
        pages = different.join(live.select("user_id", "session_no", "end_time", "opened"), ["user_id", "session_no"])
        pages = pages.select("user_id", F.col("end_time").alias("last_activity"), "opened", "page")
        return kept.unionByName(pages, allowMissingColumns=True)

    return Job(STATE, "last_activity", limit, step)
