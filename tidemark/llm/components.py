"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import settled


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest node reachable, for every node of the edges (a, b).

    Each round links a node to the smallest of its neighbours' labels and then follows labels one
    step, so long chains shrink by half; rounds end when no label changes. Edges that meet in one
    node are combined before the shuffle, and the rows of a hot label are split by the joins.
    """
    both = settled(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("a").alias("b"), "label").hint("merge"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        # A root takes the smallest label any of its members has met.
        met = settled(
            labels.join(near.hint("merge"), "a").select("a", "label", F.least("label", "near").alias("least")), "met"
        )
        roots = settled(met.groupBy(F.col("label").alias("root")).agg(F.min("least").alias("up")), "roots")
        hooked = settled(
            met.join(roots.hint("merge"), F.col("label") == F.col("root")).select("a", "label", F.least("least", "up").alias("new")),
            "hooked",
        )
        jump = hooked.select(F.col("a").alias("new"), F.col("new").alias("next"))
        after = settled(
            hooked.join(jump.hint("merge"), "new", "left").select(
                "a", "label", F.least("new", F.coalesce("next", "new")).alias("after")
            ),
            "labels",
        )
        if after.where("label <> after").isEmpty():
            return after.select(F.col("a").alias("doc_id"), F.col("after").alias("component_id"))
        labels = after.select("a", F.col("after").alias("label"))
