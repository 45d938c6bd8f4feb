"""A stored search index: postings of words, and the documents they lead to.

A batch of events becomes one folder, batch_id=N, published by one rename:

- `docs/month=M`: the events, sorted by id, so a page of ids reads few row groups;
- `postings/month=M`: (word, event_id, ts) for each word of each event, sorted by word;
- `ids/part=K`: the ids of the batch, by a hash of the id;
- `replaced`: (event_id, version) of earlier batches that the batch indexes again.

The version of a row is its batch. A search reads the postings of its words alone, whose values are in
the filter, so files and row groups without them are skipped; it drops replaced versions, finds the page
among these narrow rows, and only then reads the page's documents. Full rows are never shuffled.
`compact` merges batches into one when there are many; readers then start from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import workspace as ws
from tidemark.operators.search import query_words, search_index, with_words
from tidemark.streaming.sinks import publish_staged, published, staged

PARTS = 64
_IDS = "event_id string, version long, part int"


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches to read: the newest compacted one and those after it."""
    found = sorted(int(n.split("=")[1]) for n in ws.child_names(spark, root) if n.startswith("batch_id="))
    bases = sorted(int(n.split("=")[1]) for n in ws.child_names(spark, root) if n.startswith("base="))
    after = bases[-1] if bases else -1
    return [-1 - after] * bool(bases) + [n for n in found if n > after]


def _path(root: str, batch: int) -> str:
    return f"{root}/batch_id={batch}" if batch >= 0 else f"{root}/base={-1 - batch}"


def _read(spark: SparkSession, root: str, name: str, schema: str | T.StructType) -> DataFrame:
    """One kind of files of all batches to read; `version` is the batch a row was indexed in."""
    paths = [f"{_path(root, b)}/{name}" for b in _batches(spark, root)]
    found = None
    for path in paths:
        if ws.exists(spark, path):  # each path with its own partition folders below it
            one = spark.read.schema(schema).parquet(path)
            found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def _write(docs: DataFrame, path: str) -> None:
    """Documents, postings and ids of rows with `version`, `words` and `month`."""
    plain = docs.drop("words")
    plain.repartitionByRange("month", "event_id").sortWithinPartitions("month", "event_id").write.partitionBy("month").parquet(f"{path}/docs")
    postings = docs.select(F.explode("words").alias("word"), "event_id", "ts", "version", "month")
    postings = postings.repartitionByRange("month", "word", "event_id").sortWithinPartitions("month", "word", "event_id")
    postings.write.partitionBy("month").parquet(f"{path}/postings")
    part = F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int").alias("part")
    docs.select("event_id", "version", part).repartition("part").write.partitionBy("part").parquet(f"{path}/ids")


def index_batch(events: DataFrame, root: str, batch_id: int) -> bool:
    """Index a batch; an id indexed before is replaced. False if the batch was published before."""
    spark = events.sparkSession
    if published(spark, root, batch_id):
        return False
    path = f"{root}/_staging/{batch_id}-{uuid.uuid4().hex}"
    indexed = search_index(events.where("event_id IS NOT NULL")).withColumn("version", F.lit(int(batch_id)).cast("long"))
    with staged(indexed, root, batch_id) as docs:
        _write(docs, path)
        own = spark.read.schema(_IDS).parquet(f"{path}/ids")
        parts = [r.part for r in own.select("part").distinct().collect()]  # PARTS at most
        known = _read(spark, root, "ids", _IDS).where(F.col("part").isin(parts)).select("event_id", "version")
        known.join(own.select("event_id"), "event_id", "left_semi").write.parquet(f"{path}/replaced")
        return publish_staged(spark, path, root, batch_id)


def _dead(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "replaced", "event_id string, version long").distinct()


def hits(spark: SparkSession, root: str, q: str) -> DataFrame:
    """(event_id, version, ts, month) of every event that holds a word of `q`, once."""
    words = spark.range(1).select(query_words(q).alias("w")).head().w
    postings = _read(spark, root, "postings", "word string, event_id string, ts timestamp, version long, month string")
    found = postings.where(F.col("word").isin(words) if words else F.lit(False)).drop("word")
    if len(words) > 1:
        found = found.distinct()
    return found.join(_dead(spark, root), ["event_id", "version"], "left_anti").select("event_id", "version", "ts", "month")


def total(spark: SparkSession, root: str, q: str) -> DataFrame:
    return hits(spark, root, q).agg(F.count(F.lit(1)).alias("total"))


def documents(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Every indexed event as it was indexed last; `schema` is that of the events."""
    stored = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("month", T.StringType())])
    return _read(spark, root, "docs", stored).join(_dead(spark, root), ["event_id", "version"], "left_anti").select(*stored.names)


def page(spark: SparkSession, root: str, q: str, schema: T.StructType, size: int = 10, start: int = 0) -> DataFrame:
    """One page of whole events, newest first. The `size` ids of the page are looked up by value."""
    order = [F.col("ts").desc(), F.col("event_id")]
    keys = hits(spark, root, q).orderBy(*order).offset(start).limit(size).collect()
    stored = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("month", T.StringType())])
    wanted = (
        F.col("month").isin(sorted({k.month for k in keys}))
        & F.col("event_id").isin([k.event_id for k in keys])
        & F.struct("event_id", "version").isin([F.struct(F.lit(k.event_id), F.lit(k.version).cast("long")) for k in keys])
    )
    docs = _read(spark, root, "docs", stored).where(wanted if keys else F.lit(False))
    return docs.select(*schema.names).orderBy(*order)


def compact(spark: SparkSession, root: str, schema: T.StructType) -> int | None:
    """Merge all batches so far into one folder without replaced rows; None if there is nothing to merge.

    Versions stay, so a reader of the old folders and one of the new see the same. Readers that have
    listed the old folders go on with them; these are left in place.
    """
    batches = _batches(spark, root)
    if len(batches) < 2:
        return None
    path = f"{root}/_staging/base-{uuid.uuid4().hex}"
    # One row per id already, so words are cut row by row; written once, for _write reads its rows several times.
    with staged(with_words(documents(spark, root, schema)), root, max(batches)) as docs:
        _write(docs, path)
    return max(batches) if ws.publish(spark, path, f"{root}/base={max(batches)}") else None
