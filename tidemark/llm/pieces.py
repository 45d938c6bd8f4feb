"""Windows that occur in more than one place, in three steps that never compare all with all.

1. Every window of `width` units (bytes or words) names an anchor inside it by content alone: the
   place of the least hash of a few units. Consecutive windows with one anchor form a piece. Equal
   windows have equal anchors, so only pieces whose anchor hash occurs in more than one place (or
   document) can hold repeated windows; all others end here, after one aggregation of hashes.
2. Equal pieces are one: they are counted by hash, and only anchors with several different pieces
   need their text at all. Those pieces, once each, go to shards by anchor hash. A shard is bounded
   by `SHARD_BYTES`: an anchor with more text than that is dealt over several shards by piece
   hash, and each two of these shards are compared in a task of their own.
3. What a shard finds out (ranges of repeated windows in a piece) is joined with the places where
   the piece occurs, and gives spans by document.

A hot anchor's rows meet an aggregate's one row in sort-merge joins whose sides are both read from
tables, which is the form whose skewed partitions Spark splits.

The method of a caller enters in step 1 (units, hashes) and in the comparison of shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import flat, give_back, slices
from tidemark.llm.store import release, settled

SHARD_BYTES = 1 << 20
#: Windows whose anchors and hashes are held at a time, however long a text is.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
#: A scrambled value for each byte.
BYTES = w.mix(np.arange(1, 257, dtype=np.uint64) * w.GOLDEN)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every run of values [start, end), from differences of one running sum."""
    if values.dtype == np.uint8:
        values = BYTES[values]
    up, down = _powers(1 << max(19, len(values).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return w.mix((sums[ends] - sums[starts]) * down[starts] + w.mix((ends - starts).astype(np.uint64) * w.GOLDEN))


@dataclass(frozen=True)
class Method:
    """What differs between callers. `units` gives (values to hash, row offsets into the units)."""

    name: str
    width: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    marks: Callable[[np.ndarray], np.ndarray]
    text: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    compare: Callable[[list[bytes], np.ndarray, list[bytes] | None, np.ndarray | None], list[list[int]]]
    other_document: bool
    unit_bytes: float
    keep_places: bool
    #: With `other_document`: windows of any other document count, not of smaller ones only.
    either_way: bool = False


def pieces_of(values: np.ndarray, first: np.ndarray, method: Method, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, piece, start, n) of every piece, a block of windows at a time.

    `first` holds the offsets of the rows. A piece that reaches the end of its block is left to the next
    block, which begins where that piece does; it is never longer than a window.
    """
    width, a = method.width, 0
    block = max(block, 2 * width)
    while a + width <= len(values):
        part = values[a : a + block + width - 1]
        marks = method.marks(part)
        at = w.anchors(marks, width - method.gram + 1)
        place = np.arange(a, a + len(at))
        row = np.searchsorted(first, place, "right") - 1
        valid = place + width <= first[row + 1]
        same = (at[1:] == at[:-1]) & (row[1:] == row[:-1])
        new, last = valid.copy(), valid.copy()
        new[1:] &= ~(same & valid[:-1])
        last[:-1] &= ~(same & valid[1:])
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        done = a + len(at)
        if done + width <= len(values) and len(ends) and ends[-1] == len(at):
            done = a + int(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            row = row[starts]
            hashes = run_hashes(part, starts, ends + width - 1)
            yield row, marks[at[starts]], hashes, starts + a - first[row], ends - starts
        a = done


def places(docs: DataFrame, method: Method) -> DataFrame:
    """(doc_id, anchor, piece, start, n): the first window and number of windows of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            values, first = method.units(data, offsets)
            for row, anchor, piece, start, n in pieces_of(values, first, method):
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(piece.view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["doc_id", "anchor", "piece", "start", "n"],
                )
        give_back()

    return docs.mapInArrow(run, "doc_id long, anchor long, piece long, start int, n int")


def texts(docs: DataFrame, wanted: DataFrame, method: Method) -> DataFrame:
    """The text of the wanted pieces: (parts, anchor, piece, doc_id, body)."""
    lists_of = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("parts", "anchor", "piece", "start", "n")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i in range(batch.num_rows):
                x = batch.column(2).slice(i, 1).flatten()
                cols = [x.field(k) for k in range(5)]
                start, n = cols[3].to_numpy(), cols[4].to_numpy()
                body = data[offsets[i] : offsets[i + 1]]
                found = method.text(body, start, start + n + method.width - 1)
                ids = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(n), np.int64)))
                yield pa.record_batch([*cols[:3], ids, pa.array(found, pa.binary())], ["parts", "anchor", "piece", "doc_id", "body"])

    return (
        docs.join(lists_of, "doc_id")
        .select("doc_id", F.col("text").cast("binary"), "x")
        .mapInArrow(run, "parts int, anchor long, piece long, doc_id long, body binary")
    )


def ranges(found: DataFrame, method: Method, shards: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(anchor, piece, windows): ranges of repeated windows, flat pairs of first and end, per piece.

    `parts` 1: the anchor shares a shard with others. More: it has that many shards of its own,
    and each pair of them is a task.
    """
    part = F.pmod("piece", "parts").cast("int")
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    paired = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(
            F.least(k, part).alias("i"), F.greatest(k, part).alias("j"), F.when(part > k, 1).otherwise(0).alias("side")
        ),
    )
    dealt = found.withColumn("t", F.explode(F.when(F.col("parts") == 1, alone).otherwise(paired))).select(
        F.when(F.col("parts") == 1, F.pmod("anchor", F.lit(shards))).otherwise(F.col("anchor")).alias("shard"),
        (F.col("parts") > 1).alias("own"),
        "t.i",
        "t.j",
        "t.side",
        "anchor",
        "piece",
        "doc_id",
        "body",
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("side").combine_chunks()
        side, ids = group["side"].to_numpy(), group["doc_id"].to_numpy()
        bodies = group["body"].to_pylist()
        if group["i"][0] == group["j"][0]:
            out = method.compare(bodies, ids, None, None)
        else:
            split = int((side == 0).sum())
            out = method.compare(bodies[:split], ids[:split], bodies[split:], ids[split:])
        if sum(map(len, bodies)) > shard_bytes // 4:
            give_back(collect=False)
        hit = [k for k, x in enumerate(out) if len(x)]
        found = group.select(["anchor", "piece"]).take(pa.array(hit, pa.int64()))
        return found.append_column("windows", pa.array([out[k] for k in hit], pa.list_(pa.int32())))

    return (
        dealt.groupBy("shard", "own", "i", "j")
        .applyInArrow(run, "anchor long, piece long, windows array<int>")
        .groupBy("anchor", "piece")
        .agg(F.flatten(F.collect_list("windows")).alias("windows"))
    )


def spans(docs: DataFrame, method: Method, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, spans): flat pairs of first unit and end of the repeated windows' runs; rows without any are left out."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    at = places(docs, method)
    if method.keep_places:
        at = settled(at, f"{method.name}-places")
    if method.other_document:
        shared = at.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    else:
        shared = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("a")).where("a > 1")
    shared = settled(shared.select("anchor"), f"{method.name}-anchors")
    at = settled(at.join(shared.hint("merge"), "anchor"), f"{method.name}-shared")
    release(at)

    place = F.struct("doc_id", "start", "n")
    facts = [F.count(F.lit(1)).alias("times"), F.min(place).alias("first")]
    size = (F.col("first.n") + method.width) * method.unit_bytes
    if method.either_way:  # a piece of several documents is compared as one of the first and one of the last
        facts.append(F.max(place).alias("last"))
        several = F.col("first.doc_id") < F.col("last.doc_id")
        size = size * F.when(several, 2).otherwise(1)
    pieces = settled(at.groupBy("anchor", "piece").agg(*facts), f"{method.name}-pieces")
    rivals = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("rivals"), F.sum(size).alias("bytes")).where("rivals > 1")
    rivals = settled(rivals, f"{method.name}-rivals")
    compared = pieces
    if method.either_way:
        held = F.when(several, F.array("first", "last")).otherwise(F.array("first"))
        compared = pieces.select("anchor", "piece", F.explode(held).alias("first"))
    wanted = settled(
        compared.join(rivals.hint("merge"), "anchor").select(
            "anchor",
            "piece",
            "first.*",
            F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"),
        ),
        f"{method.name}-wanted",
    )
    total = wanted.agg(F.sum((F.col("n") + method.width) * method.unit_bytes)).first()[0] or 0
    # More shards than tasks at a time, however small the input, so that no task waits for one large shard.
    shards = max(int(total // shard_bytes) + 1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = ranges(texts(docs, wanted, method), method, shards, shard_bytes)
    found = settled(found, f"{method.name}-ranges")
    release(at)

    known = pieces.join(found.hint("merge"), ["anchor", "piece"], "left")
    if method.either_way:
        everywhere = several
    elif method.other_document:
        everywhere = F.col("doc_id") > F.col("first.doc_id")
    else:
        everywhere = F.col("times") > 1
    known = settled(known.where((F.col("times") > 1) | F.col("windows").isNotNull()), f"{method.name}-known")
    window = F.when(everywhere, F.array(F.lit(0), F.col("n"))).otherwise(F.col("windows"))
    hits = (
        at.join(known.hint("merge"), ["anchor", "piece"])
        .select("doc_id", "start", window.alias("windows"))
        .where("windows IS NOT NULL")
    )
    run = F.transform(
        "windows", lambda x, k: x + F.col("start") + F.when(k % 2 == 1, method.width - 1).otherwise(0)
    )
    return hits.select("doc_id", run.alias("run")).groupBy("doc_id").agg(F.flatten(F.collect_list("run")).alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, and the spans found for their doc_id (null: none)."""
    found = found.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    return docs.join(found, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def covered(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of `size` units lie in a run; `runs` are flat pairs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, runs[0::2], 1)
    np.add.at(edge, runs[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(flags: np.ndarray) -> list[int]:
    """Flat pairs of first and end of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()
