"""Words covered by passages of `WIDTH` consecutive words that several documents hold.

Passages of many short words are shorter than the strings `suffix` looks for, and have no fixed number of
bytes. The windows are found as in `lempel` (words as hashes, pieces named by anchors), but no document comes
first: all places of a window that starts in two documents count. What one document repeats in itself stays.
A shard sorts the hashes of its windows with the documents that hold them.

Defined cases: null, empty and blank texts have no words; rows without doc_id are compared with nothing;
repeated rows have one doc_id, so they are one document. White space between words may differ.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lempel
from tidemark.llm import words as w
from tidemark.llm.pieces import Method, runs_of, spans

WIDTH = 51


def shared(
    bodies: list[bytes], ids: np.ndarray, others: list[bytes] | None, other_ids: np.ndarray | None, width: int = WIDTH
) -> list[list[int]]:
    """For each piece, ranges of the windows that two documents among the pieces of one or both sides hold."""
    sides = [lempel.Block(bodies, ids, width)]
    if others is not None:
        sides.append(lempel.Block(others, other_ids, width))
    hashes = np.concatenate([x.hashes[x.window] for x in sides])
    docs = np.concatenate([x.ids[x.window] for x in sides])
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hashes))[: len(first)] - 1
    found = hashes[first][docs[first] < docs[last]]
    flags = [x.window & np.isin(x.hashes, found) for x in sides]
    return [
        runs_of(f[a:b]) for x, f in zip(sides, flags, strict=True) for a, b in zip(x.first[:-1], x.first[1:], strict=True)
    ]


def method(width: int = WIDTH) -> Method:
    return replace(
        lempel.method(width),
        name="passages",
        compare=lambda bodies, ids, others, other_ids: shared(bodies, ids, others, other_ids, width),
        either_way=True,
        keep_places=True,
    )


def find(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, spans): word ranges of `docs` (doc_id, text) that passages of several documents cover."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return spans(docs, method(width), **options)


def in_bytes(body: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Ranges of words as ranges of bytes, from the first byte of the first word to the end of the last."""
    starts, ends, _ = w.spans(body, np.array([0, len(body)]), w.SPACE)
    out = np.empty(len(runs), np.int64)
    out[0::2], out[1::2] = starts[runs[0::2]], ends[runs[1::2] - 1]
    return out
