"""Words covered by windows that a smaller document holds, by relative Lempel-Ziv parsing.

A shard (see `pieces`) is a reference block: its windows of `WIDTH` words are indexed with the
smallest document that holds them and a place there. Every piece is factored greedily from its
first word on against the blocks that can hold its windows: at a place whose window the index has
for a smaller document, the factor goes on there word by word as far as both agree; elsewhere one
word is passed as it is. All pieces of a block are factored at once, one step at a time. A factor
ends where its own source does, and windows over its end may well occur elsewhere, so all of them
are looked up as well. Every window is thus inside a factor, over the end of one, or at a passed
word, and has been decided.

Defined cases: null, empty and blank texts have no words; rows without doc_id stay as they are and
are compared with nothing; repeated rows have one doc_id, so neither is smaller. doc_id names one
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import slices
from tidemark.llm.pieces import Method, covered, runs_of, spans, with_spans

WIDTH, GRAM = 13, 4


class Block:
    """Pieces as word hashes, with an index of their windows by smallest document."""

    def __init__(self, bodies: list[bytes], ids: np.ndarray, width: int) -> None:
        data = np.frombuffer(b"".join(bodies), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
        starts, ends, self.first = w.spans(data, offsets, w.SPACE)
        self.words = w.hashes(data, starts, ends)
        piece = np.repeat(np.arange(len(bodies)), np.diff(self.first))
        self.ends = self.first[1:][piece]
        self.ids = np.asarray(ids, np.int64)[piece]
        hashes = w.grams(self.words, width, 7)
        self.hashes = np.concatenate([hashes, np.zeros(len(self.words) - len(hashes), np.uint64)])
        self.window = np.arange(len(self.words)) + width <= self.ends
        places = np.flatnonzero(self.window)
        places = places[np.lexsort((self.ids[places], self.hashes[places]))]
        keys = self.hashes[places]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.keys, self.places = keys[new], places[new]

    def sources(self, other: Block) -> np.ndarray:
        """For every word of `other`, a place here in a smaller document with the same window; else -1."""
        out = np.full(len(other.words), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, other.hashes), len(self.keys) - 1)
            place = self.places[at]
            found = other.window & (self.keys[at] == other.hashes) & (self.ids[place] < other.ids)
            out[found] = place[found]
        return out


def factor(block: Block, target: Block, width: int) -> np.ndarray:
    """Which windows of `target` occur in a smaller document of `block`."""
    source = block.sources(target)
    flags = np.zeros(len(target.words) + 1, bool)
    at = target.first[:-1][np.diff(target.first) >= width]
    while len(at):
        end = target.ends[at]
        here = source[at] >= 0
        size = np.ones(len(at), np.int64)
        size[here] = width
        live = np.flatnonzero(here)
        while len(live):
            a, b = at[live] + size[live], source[at[live]] + size[live]
            room = (a < end[live]) & (b < block.ends[source[at[live]]])
            live, a, b = live[room], a[room], b[room]
            live = live[target.words[a] == block.words[b]]
            size[live] += 1
        steps = int(size.max())
        for k in range(steps):  # inside the factor its windows are found; those over its end are looked up
            on = here & (size > k)
            place = at[on] + k
            flags[place] |= (k + width <= size[on]) | (source[place] >= 0)
        at = at + size
        at = at[at + width <= end]
    return flags[:-1]


def earlier(
    bodies: list[bytes], ids: np.ndarray, others: list[bytes] | None, other_ids: np.ndarray | None, width: int = WIDTH
) -> list[list[int]]:
    """For each piece, ranges of the windows that a smaller document among the pieces holds."""
    block = Block(bodies, ids, width)
    if others is None:
        sides = [(block, factor(block, block, width))]
    else:
        other = Block(others, other_ids, width)
        sides = [(block, factor(other, block, width)), (other, factor(block, other, width))]
    return [
        runs_of(flags[a:b])
        for side, flags in sides
        for a, b in zip(side.first[:-1], side.first[1:], strict=True)
    ]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return w.hashed(data, offsets, w.SPACE)


def _marks(values: np.ndarray) -> np.ndarray:
    return w.grams(values, GRAM, 5)


def _text(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    a, b, _ = w.spans(body, np.array([0, len(body)]), w.SPACE)
    return [body[a[i] : b[j - 1]].tobytes() for i, j in zip(starts, ends, strict=True)]


def method(width: int = WIDTH) -> Method:
    return Method(
        name="lempel",
        width=width,
        gram=GRAM,
        units=_units,
        marks=_marks,
        text=_text,
        compare=lambda bodies, ids, others, other_ids: earlier(bodies, ids, others, other_ids, width),
        other_document=True,
        unit_bytes=7.0,
        keep_places=False,
    )


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, spans): word ranges of `docs` (doc_id, text) that windows of smaller documents cover."""
    return spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), method(), **options)


def cut(docs: DataFrame, with_text: bool = True, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row, and on demand the kept words as text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            starts, ends, first = w.spans(data, offsets, w.SPACE)
            removed, kept = [], []
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                runs = batch.column(2)[i]
                gone = covered(b - a, runs.values.to_numpy()) if runs.is_valid else np.zeros(b - a, bool)
                removed.append(int(gone.sum()))
                body = data[offsets[i] : offsets[i + 1]].tobytes()
                if removed[-1]:
                    stay = np.flatnonzero(~gone) + a
                    base = int(offsets[i])
                    kept.append(b" ".join([body[x - base : y - base] for x, y in zip(starts[stay], ends[stay], strict=True)]))
                else:
                    kept.append(b" ".join(body.split()))
            out = {
                "doc_id": batch.column(0),
                "n_words": pa.array(np.diff(first), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
            if with_text:
                out["kept"] = pa.array([x.decode() for x in kept], pa.string())
            yield pa.record_batch(list(out.values()), list(out))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return (
        with_spans(docs, find(docs, **options)).select("doc_id", F.col("text"), "_spans").mapInArrow(run, schema)
    )
