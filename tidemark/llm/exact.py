"""Exact copies of texts by an extendible-hash index on shared files, in DataFrame operations alone.

A text's key is the 64-bit hash of its normalised form. The index is built in three passes:

1. `keys`: key and digest of every row, narrow. Distinct keys are counted by their leading bits.
2. `directory`: buckets start as the ranges of the first bits. While a bucket holds more than
   `capacity` keys it is split at the next bit; the directory doubles, and buckets that did not split
   are pointed to by several of its slots. Every round looks only at the keys of overfull buckets.
   Texts that share a whole key cannot be parted by more bits: they count once and are chained.
3. `entries`: each first range is the key range of one owner. Rows go to their owner with their text,
   which is the only time that texts are shuffled; the owner compares bytes, since the normalised
   text itself is the grouping key, and makes one entry per different text. Keys of more than one
   `HOT_KEYS`-th of all rows or of all bytes (so at most twice `HOT_KEYS` of them) are combined before
   the shuffle instead, so a text that a third of all rows hold reaches its owner once per task that
   read it, and the copies of no other text fill an owner's task.

Entries are written bucket by bucket, those of one key chained in the order of their smallest doc_id.
Every row then finds its entry by key and digest, both read from tables, which lets Spark split the
partitions of a hot key.

Defined cases: null counts as an empty text, and empty texts are copies of each other, but not of
blank ones; texts of any length are one value in one row, as they came. Rows without doc_id are
copies like others; they stay only where no row of the group has a doc_id. Rows that repeat the
smallest doc_id of their group are all `kept`, as they cannot be told apart; `keep_first` leaves one
of them. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import settled

#: Different keys in a bucket before it is split, unless more buckets are needed to keep all tasks busy.
CAPACITY = 1024
#: Keys with more than this part of all rows or bytes are combined before they are shuffled.
HOT_KEYS = 4096


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def prefix(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key (1 to 63)."""
    return F.shiftrightunsigned(key, 64 - depth)


@dataclass(frozen=True)
class Index:
    """The tables of an index. `first_depth` bits name an owner, `depth` bits a slot of the directory."""

    keys: DataFrame
    directory: DataFrame
    entries: DataFrame
    first_depth: int
    depth: int


def grow(distinct: DataFrame, first_depth: int, capacity: int) -> tuple[DataFrame, int]:
    """(slots, bucket, local_depth, n_keys) and the global depth; `distinct` holds each key once.

    `bucket` is the first of the slots that point to it, so buckets ascend with their keys.
    """
    depth = first_depth
    level = settled(distinct.groupBy(prefix(F.col("key"), depth).alias("bits")).agg(F.count(F.lit(1)).alias("n_keys")), "exact-level")
    levels = [(level, depth)]
    while depth < 63 and not level.where(F.col("n_keys") > capacity).isEmpty():
        full = level.where(F.col("n_keys") > capacity).select(F.col("bits").alias("_full"))
        inside = distinct.join(full, prefix(F.col("key"), depth) == F.col("_full"), "left_semi")
        depth += 1
        level = settled(inside.groupBy(prefix(F.col("key"), depth).alias("bits")).agg(F.count(F.lit(1)).alias("n_keys")), "exact-level")
        levels.append((level, depth))
    buckets = None
    for at, d in levels:
        done = at if d == depth else at.where(F.col("n_keys") <= capacity)
        step = 1 << (depth - d)
        done = done.select(
            F.sequence(F.col("bits") * step, F.col("bits") * step + (step - 1)).alias("slots"),
            (F.col("bits") * step).alias("bucket"),
            F.lit(d).alias("local_depth"),
            "n_keys",
        )
        buckets = done if buckets is None else buckets.union(done)
    return buckets, depth


def build(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> Index:
    """The index of all rows of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    docs = docs.withColumn("key", key(F.col("body")))
    keys = settled(docs.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("n_bytes")), "exact-keys")

    counted = settled(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")), "exact-counted")
    total = counted.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(total["keys"] / capacity, 4 * tasks)
    first_depth = min(max(math.floor(math.log2(wanted)), 1), 40)
    buckets, depth = grow(counted.select("key"), first_depth, capacity)
    directory = settled(buckets.select(F.explode("slots").alias("slot"), "bucket", "local_depth", "n_keys"), "exact-directory")

    large = (F.col("n") > (total["rows"] or 0) / HOT_KEYS) | (F.col("bytes") > (total["bytes"] or 0) / HOT_KEYS)
    hot = F.broadcast(counted.where(large & (F.col("n") > 1)).select("key"))  # at most 2 * HOT_KEYS rows
    facts = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    owner = prefix(F.col("key"), first_depth).alias("owner")
    rare = docs.join(hot, "key", "left_anti").select("*", owner).repartition("owner").groupBy("owner", "key", "body").agg(*facts)
    common = docs.join(hot, "key", "left_semi").select("*", owner).groupBy("owner", "key", "body").agg(*facts)
    columns = ["owner", "key", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("n_bytes"), "keep_id", "group_size"]
    entries = settled(rare.select(columns).unionByName(common.select(columns)), "exact-texts")

    chain = Window.partitionBy("owner", "bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "digest")
    placed = entries.withColumn("slot", prefix(F.col("key"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    placed = placed.repartition("owner").withColumn("chain", F.row_number().over(chain) - 1)
    entries = settled(placed.sortWithinPartitions("bucket", "key", "chain"), "exact-index")
    return Index(keys, directory, entries, first_depth, depth)


def copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`."""
    index = build(docs, **options)
    found = index.entries.select("key", "digest", "keep_id", "group_size")
    return index.keys.join(found.hint("merge"), ["key", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one per different text, that of its smallest doc_id."""
    stay = copies(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # whatever the columns are called
    marked = docs.select(row, F.sha2(normalised(F.col("text")), 256).alias("digest"), F.col("doc_id").cast("long").alias("id"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
