"""Benchmark passages in documents, found by winnowing.

A window is `WIDTH` consecutive words of a benchmark item (a shorter item is one window). Of the
hashes of `GRAM` consecutive words, each window keeps the smallest; documents do the same. Equal
windows keep equal hashes, so every shared span of `WIDTH` words meets in a kept hash. A document
hash that the benchmark may hold is extended to the windows that keep it, and those windows are
joined with the benchmark's by 128-bit hashes of their words. Items shorter than a window cannot
rely on kept hashes: for each of their lengths, at most `WIDTH` - 1, all spans of that length are
looked up.

Before anything is shuffled, hashes are tested against a bit table of the benchmark. Its size
follows the benchmark up to `MAX_BITS` (8 MB); beyond that more false hits pass, and none is lost.

Defined cases: null has no words, nor has a text of separators only; such an item occurs nowhere.
Rows without doc_id are kept apart by their text. Repeated rows give equal rows. Without items
nothing is contaminated. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import lists, slices
from tidemark.llm.store import row_key, settled

WIDTH, GRAM = 10, 5
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the row offsets into them."""
    data = w.lower(data)
    starts, ends, first = w.spans(data, offsets, w.NOT_ALNUM)
    return w.hashes(data, starts, ends), first


def _spans(hashes: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of the spans of `length` words that begin at `starts`."""
    if len(starts) * length >= len(hashes) * 2:
        return w.grams(hashes, length, seed)[starts]
    flat = hashes[(starts[:, None] + np.arange(length)).ravel()]
    return w.grams(flat, length, seed)[::length] if len(starts) else np.empty(0, np.uint64)


def _within(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every span of `length` words that lies in one row."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return rows, places


def _kept(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The smallest hash of `GRAM` words in each window at `places`."""
    marks = w.grams(hashes, GRAM, 3)
    return marks[w.anchors(marks, WIDTH - GRAM + 1)[places]] if len(places) else np.empty(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, h1, h2, mark): the windows of items and the hash that leads to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            hashes, first = _words(data, offsets)
            sizes = np.diff(first)
            for length in range(1, WIDTH + 1):
                rows, places = _within(first, length)
                if length < WIDTH:
                    own = sizes[rows] == length
                    rows, places = rows[own], places[own]
                h1 = _spans(hashes, places, length, 100 + length)
                mark = _kept(hashes, places) if length == WIDTH else h1
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(rows), length, np.int32)),
                        _signed(h1),
                        _signed(_spans(hashes, places, length, 200 + length)),
                        _signed(mark),
                    ],
                    ["item_id", "length", "h1", "h2", "mark"],
                )

    return (
        items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, "item_id string, length int, h1 long, h2 long, mark long")
        .distinct()
    )


def bit_table(windows: DataFrame) -> np.ndarray:
    """The marks of all windows as bits; at most `MAX_BITS` of them reach the driver."""
    marks = windows.select("mark").distinct()
    bits, wanted = MIN_BITS, 16 * marks.count()
    while bits < min(MAX_BITS, wanted):
        bits *= 2
    place = F.col("mark").bitwiseAND(bits - 1)
    cells = (
        marks.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((mark & {bits - 1}) & 63 AS INT))").alias("bit"))
        .groupBy("cell")
        .agg(F.expr("bit_or(bit)").alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return table


def _holds(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = marks & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def candidates(
    docs: DataFrame, table: np.ndarray, short: list[int], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its key, number of words, and the windows whose mark the bit table holds."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            hashes, first = _words(data, offsets)
            found = []
            for length in [*short, WIDTH]:
                rows, places = _within(first, length)
                marks = _kept(hashes, places) if length == WIDTH else _spans(hashes, places, length, 100 + length)
                hit = _holds(shared.value, marks)
                rows, places = rows[hit], places[hit]
                h1, h2 = (_spans(hashes, places, length, seed + length) for seed in (100, 200))
                found.append((rows, places - first[rows], np.full(len(rows), length), h1, h2))
            rows, starts, lengths, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(rows, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.diff(first), pa.int64()),
                    lists(starts[order].astype(np.int32), ends, pa.int32()),
                    lists(lengths[order].astype(np.int32), ends, pa.int32()),
                    lists(h1[order].view(np.int64), ends, pa.int64()),
                    lists(h2[order].view(np.int64), ends, pa.int64()),
                ],
                ["id", "key", "n_words", "start", "length", "h1", "h2"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("_key"))
    return rows.mapInArrow(
        run,
        f"id {kind}, key string, n_words long, start array<int>, length array<int>, h1 array<long>, h2 array<long>",
    )


def find(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with key and n_words, hit windows by key, distinct pairs of key and item)."""
    windows = settled(item_windows(items, item_col, item_text_col), "item-windows")
    short = sorted(r.length for r in windows.where(F.col("length") < WIDTH).select("length").distinct().collect())
    rows = settled(candidates(docs, bit_table(windows), short, id_col, text_col), "document-windows")
    hits = rows.select("key", F.explode(F.arrays_zip("start", "length", "h1", "h2")).alias("x")).select("key", "x.*")
    same = ["length", "h1", "h2"]
    # Both sides come from tables, so Spark can split the rows of a window that very many documents hold.
    kinds = settled(windows.select(same).distinct(), "window-kinds")
    hits = settled(hits.join(kinds, same, "left_semi"), "hits")
    pairs = hits.select("key", *same).distinct().join(windows.select("item_id", *same), same).select("key", "item_id").distinct()
    return rows.select("id", "key", "n_words"), hits.select("key", "start", "length"), pairs


def summary(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    rows, hits, pairs = find(docs, items, id_col, **columns)
    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = (
        hits.withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "done"))).cast("long").alias("n_hit"))
    )
    named = pairs.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(covered, "key", "left")
        .join(named, "key", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of any item."""
    _, hits, _ = find(docs, items, id_col, text_col)
    found = hits.select(F.col("key").alias("_found")).distinct()
    return docs.join(found, row_key(id_col, text_col) == F.col("_found"), "left_anti")
