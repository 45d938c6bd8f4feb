"""Quality score of texts by a factorisation machine.

Inputs are the text's words, lower-cased and hashed into `WORDS` columns (value: damped count, the
text's words having length one together), structure statistics and length, each of the latter as
one column of a scale of `STEPS` steps. The score adds a weight per input and, for each pair of inputs, the
product of their factor vectors of length `RANK`. The pairs are never formed: for each factor the
sum over pairs is half of (the square of the sum minus the sum of the squares), so scoring takes
time in proportion to the inputs. Training is AdaGrad on the logistic loss, on at most about
`SAMPLE` labelled texts chosen by a hash of their id; every text is scored whole.

Defined cases: null and empty texts are scored by their length and structure alone; without any
labels every score is 0.5; with one label value it is the share of that value. Rows without doc_id
are not learned from and count as held out. A text labelled both ways counts for both. Only id,
text and the label table's id and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import lists, ragged, slices

WORDS, STEPS, RANK, SAMPLE = 1 << 15, 16, 8, 8000
THRESHOLD = 0.3
#: Kinds of bytes whose shares are structure statistics.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:", "!?", "'\"-()", "#$%&*@~^+=_\\/", "|<>{}[]`"]
STATISTICS = len(KINDS) + 7


def _kinds() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    table[128:] = len(KINDS) + 1
    for k, chars in enumerate(KINDS):
        table[list(chars.encode())] = k
    return table


KIND = _kinds()


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of all inputs, by row."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = len(KINDS) + 2
    shares = np.bincount(row * kinds + KIND[data], minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]

    low = w.lower(data)
    starts, ends, first = w.spans(low, offsets, w.SPACE)
    count = np.diff(first)
    own = np.repeat(np.arange(n), count)
    column = (w.hashes(low, starts, ends) >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
    cells, times = np.unique(own * WORDS + column, return_counts=True)
    rows, columns = cells // WORDS, cells % WORDS
    values = 1.0 + np.log(times)
    values /= np.sqrt(np.bincount(rows, values * values, minlength=n))[rows]

    letters = np.bincount(own, ends - starts, minlength=n) / np.maximum(count, 1)
    distinct = np.bincount(rows, minlength=n) / np.maximum(count, 1)
    upper_first = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.empty(0, bool)
    sign_last = (KIND[data[ends - 1]] < len(KINDS)) & (KIND[data[ends - 1]] > 3) if len(starts) else np.empty(0, bool)
    titled = np.bincount(own, upper_first, minlength=n) / np.maximum(count, 1)
    signed = np.bincount(own, sign_last, minlength=n) / np.maximum(count, 1)
    scales = [
        np.sqrt(shares),
        (letters / 16)[:, None],
        distinct[:, None],
        titled[:, None],
        signed[:, None],
        (np.log1p(size) / 16)[:, None],
    ]
    scaled = np.concatenate(scales, axis=1)
    step = np.minimum((scaled * STEPS).astype(np.int64), STEPS - 1) + np.arange(STATISTICS) * STEPS + WORDS
    rows = np.concatenate([rows, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(rows, kind="stable")
    return (
        rows[order],
        np.concatenate([columns, step.ravel()])[order],
        np.concatenate([values, np.full(step.size, 1.0 / np.sqrt(STATISTICS))])[order],
    )


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The raw score of each row, and its sum for each factor."""
        vx = self.factors[columns] * values[:, None]
        first = np.searchsorted(rows, np.arange(n))
        sums = np.add.reduceat(vx, first)
        squares = np.add.reduceat(vx * vx, first)
        linear = np.add.reduceat(self.weights[columns] * values, first)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw, _ = self.parts(*inputs(data, offsets), len(offsets) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35)))


def train(
    examples: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    epochs: int = 14,
    rate: float = 0.15,
    penalty: float = 1e-5,
    batch: int = 64,
) -> Machine:
    """AdaGrad over batches of examples (columns, values)."""
    rnd = np.random.default_rng(3)
    size = WORDS + STATISTICS * STEPS
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(size)
    factors = rnd.normal(0, 0.05, (size, RANK))
    if len(set(labels.tolist())) < 2:
        return Machine(bias, weights, factors * 0)
    gw, gf, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rnd.permutation(len(examples))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            rows = np.repeat(np.arange(len(some)), [len(examples[i][0]) for i in some])
            columns = np.concatenate([examples[i][0] for i in some])
            values = np.concatenate([examples[i][1] for i in some])
            raw, sums = Machine(bias, weights, factors).parts(rows, columns, values, len(some))
            error = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))) - labels[some]
            slope = error[rows] * values
            ids, at = np.unique(columns, return_inverse=True)
            dw = np.bincount(at, slope) + penalty * weights[ids]
            each = slope[:, None] * (sums[rows] - factors[columns] * values[:, None])
            df = np.stack([np.bincount(at, each[:, k]) for k in range(RANK)], axis=1) + penalty * factors[ids]
            gw[ids] += dw * dw
            gf[ids] += df * df
            gb += error.sum() ** 2
            weights[ids] -= rate * dw / np.sqrt(gw[ids])
            factors[ids] -= rate * 0.5 * df / np.sqrt(gf[ids])
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(bias, weights.astype(np.float32), factors.astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0; or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Learn from the labelled rows that are not held out.

    The chosen labels are a bounded number of rows, so they go to the documents; no text is shuffled.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).distinct()
    total = known.count()
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(max(total, 1))) < sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            rows, columns, values = inputs(data, offsets)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.record_batch(
                [
                    batch.column(1),
                    batch.column(2),
                    lists(columns.astype(np.int32), ends, pa.int32()),
                    lists(values.astype(np.float32), ends, pa.float32()),
                ],
                ["label", "place", "columns", "parts"],
            )

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(known), "_id")
        .select("text", "label", F.xxhash64("_id", "label").alias("place"))
        .mapInArrow(run, "label double, place long, columns array<int>, parts array<float>")
        .toArrow()
    )
    # Sorted, so that the order of training does not depend on how the rows were read.
    rows = rows.sort_by([("place", "ascending")])
    examples = list(zip(ragged(rows, "columns"), ragged(rows, "parts"), strict=True))
    return train(examples, rows.column("label").to_numpy())


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            found = shared.value.scores(data, offsets).astype(np.float64)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")).mapInArrow(
        run, f"{id_col} {kind}, held_out boolean, score double, predicted int"
    )


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from `labels` (doc_id, quality) and score every row of `docs` (doc_id, text)."""
    return score(docs, fit(docs, labels, sample))
