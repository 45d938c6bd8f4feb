"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to `ORDER` characters, lower-cased, with everything but letters read as a space,
are hashed into `FEATURES` columns; a column's value is its share of the text's n-grams times its
inverse document frequency, counted over all texts that may be learned from. Weights are trained
by follow-the-regularised-leader with elastic-net penalties, which leaves columns of no use at
exactly zero, on at most about `SAMPLE` texts per language, chosen by a hash of their id. A part
of the sample is kept out of training and sets the temperature that calibrates the probabilities.
Every text is scored whole.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is everything
when there is nothing to learn from; with one language all else is that language. Rows without
doc_id are not learned from and count as held out. Rows without a language are only predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import give_back, lists, ragged, slices
from tidemark.llm.store import row_key

FEATURES, ORDER, SAMPLE = 1 << 15, 3, 600
UNKNOWN = "und"
SPREAD = 60.0


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and what it is read as."""
    letter = np.zeros(0x110000, bool)
    read = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            letter[c] = True
            low = s.lower()
            read[c] = ord(low) if len(low) == 1 else c
    return letter, read


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters as they are read, row offsets into them, and which rows hold a letter."""
    letter, read = _letters()
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = heads[offsets]
    total = np.concatenate([[0], np.cumsum(letter[points])])
    return read[points], ends, total[ends[1:]] > total[ends[:-1]]


def columns(points: np.ndarray, order: int) -> np.ndarray:
    """The column of the n-gram of `order` characters at each place."""
    n = max(len(points) - order + 1, 0)
    out = np.full(n, order, np.uint64)
    for k in range(order):
        out = (out ^ points[k : k + n]) * w.M1
        out ^= out >> np.uint64(32)
    return ((out * w.M2) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)


def _rows(points: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """All columns of each row, with repeats."""
    found = [columns(points, k) for k in range(1, ORDER + 1)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.concatenate([c[a : max(b - k, a)] for k, c in enumerate(found)])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each column occurs, and in the last place the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for _, data, offsets in slices(batches, "text"):
            points, ends, _ = characters(data, offsets)
            for own in _rows(points, ends):
                seen = np.zeros(FEATURES, bool)
                seen[own] = True
                total[:-1] += seen
            total[-1] += len(offsets) - 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(label, place, features, counts) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            points, ends, _ = characters(data, offsets)
            found = [np.unique(x, return_counts=True) for x in _rows(points, ends)]
            at = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])])
            yield pa.record_batch(
                [
                    batch.column(1),
                    batch.column(2),
                    lists(np.concatenate([x for x, _ in found]).astype(np.int32), at, pa.int32()),
                    lists(np.concatenate([c for _, c in found]).astype(np.int32), at, pa.int32()),
                ],
                ["label", "place", "features", "counts"],
            )

    rows = docs.select("text", "label", F.xxhash64("key").alias("place"))
    return rows.mapInArrow(run, "label string, place long, features array<int>, counts array<int>")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # language by column, inverse document frequency included
    bias: np.ndarray
    temperature: float

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        x = (scores + self.bias) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def scores(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row of scores per text, before the bias."""
        out = np.zeros((len(ends) - 1, len(self.languages)))
        grams = np.zeros(len(ends) - 1)
        for order in range(1, ORDER + 1):
            column = columns(points, order)
            last = np.maximum(ends[1:] - order + 1, ends[:-1])
            grams += last - ends[:-1]
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[k][column], dtype=np.float64)])
                out[:, k] += sums[np.minimum(last, len(column))] - sums[np.minimum(ends[:-1], len(column))]
        return out * (SPREAD / np.maximum(grams, 1))[:, None]


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    epochs: int = 4,
) -> np.ndarray:
    """Weights (class by column, the last column is the bias) by follow-the-regularised-leader."""
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(at):
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for (at, x), label in zip(rows, labels, strict=True):
            own = weights(at)
            p = own @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1.0
            g = p[:, None] * x
            more = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(more) - np.sqrt(n[:, at])) / alpha * own
            n[:, at] = more
    return weights(np.arange(FEATURES + 1))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from all rows of `docs` (key, text, label); None if there are none."""
    docs = docs.where("label IS NOT NULL AND text IS NOT NULL")
    known = {r.label: r.n for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return None
    languages = sorted(known)
    frequency = document_frequencies(docs)
    idf = np.log((1.0 + frequency[-1]) / (1.0 + frequency[:-1])) + 1.0
    share = F.lit(False)
    for name, total in known.items():
        share |= (F.col("label") == name) & (F.pmod(F.xxhash64("key"), F.lit(total)) < sample)
    chosen = counted(docs.where(share)).toArrow().combine_chunks()
    # Sorted, so that the order of training does not depend on how the rows were read.
    chosen = chosen.sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
    at, x = ragged(chosen, "features"), ragged(chosen, "counts")
    rows = []
    for own, times in zip(at, x, strict=True):
        share_of = SPREAD * times / max(times.sum(), 1.0) * idf[own]
        rows.append((np.append(own, FEATURES), np.append(share_of, 1.0)))
    labels = [languages.index(name) for name in chosen.column("label").to_pylist()]
    labels = np.array(labels, np.int64)
    order = np.random.default_rng(7).permutation(len(rows))
    kept_out, learned = order[::5], order if len(rows) < 50 else np.delete(order, np.s_[::5])
    found = ftrl([rows[i] for i in learned], labels[learned], len(languages))
    model = Model(languages, (found[:, :-1] * idf).astype(np.float32), found[:, -1], 1.0)
    scores = np.array([found[:, rows[i][0]] @ rows[i][1] for i in kept_out]) - model.bias
    best = min(np.geomspace(0.05, 20, 120), key=lambda t: _loss(Model(languages, model.weights, model.bias, t), scores, labels[kept_out]))
    return Model(languages, model.weights, model.bias, float(best))


def _loss(model: Model, scores: np.ndarray, labels: np.ndarray) -> float:
    p = model.probabilities(scores)[np.arange(len(labels)), labels]
    return float(-np.log(np.maximum(p, 1e-12)).mean())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1; or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, offsets in slices(batches, "text"):
            points, ends, lettered = characters(data, offsets)
            if model is None:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = model.probabilities(model.scores(points, ends))
                best = p.argmax(axis=1)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, p.max(axis=1), 0.0)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)],
                [id_col, "held_out", "lang_pred", "score"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")).mapInArrow(
        run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double"
    )


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    return predict(docs, fit(_learnable(docs, id_col, text_col, label_col), sample), id_col, text_col)


def _learnable(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return docs.where(~held_out(id_col)).select(
        F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(label_col).alias("label")
    )


def keep_known(
    docs: DataFrame,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows of `docs`, all columns, whose language is found with a probability of `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(fit(_learnable(docs, id_col, text_col, label_col), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            kept = []
            for _, data, offsets in slices(iter([batch.select([batch.num_columns - 1])]), batch.schema.names[-1]):
                points, ends, lettered = characters(data, offsets)
                if model.value is None:
                    kept.append(np.zeros(len(lettered), bool))
                else:
                    kept.append(lettered & (model.value.probabilities(model.value.scores(points, ends)).max(axis=1) >= least))
            yield own.filter(pa.array(np.concatenate(kept))) if kept else own
        give_back()

    # Rows pass through with all their columns; the text comes once more, last, as a string.
    return docs.select(*docs.columns, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, docs.schema)
