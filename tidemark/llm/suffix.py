"""Bytes covered by long strings that occur more than once, by suffix arrays.

Shards of the pieces that may hold repeats (see `pieces`) get a suffix array each. It is built by
Larsson-Sadakane refinement: suffixes sorted by their first 8 bytes form groups, and each round
sorts the members of groups that are still larger than one by the rank of the suffix `h` bytes on,
doubling `h` until more than `WIDTH` bytes are told apart. Common prefixes of neighbours follow
Kasai: if the neighbour of i + 1 is the one of i moved by one, its common prefix is one less, so
only the first place of such a chain is compared byte by byte, eight at a time and all chains at
once. A window is repeated if it shares `WIDTH` bytes with a neighbour. Two shards of one anchor
are merged by binary search of the suffixes of one in the suffix array of the other.

Defined cases: null and empty texts have no bytes; rows without doc_id stay as they are and are
compared with nothing; repeated rows are copies of each other. doc_id names one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import passages
from tidemark.llm import words as w
from tidemark.llm.arrow import flat, give_back, slices
from tidemark.llm.pieces import Method, covered, runs_of, spans, with_spans

WIDTH, GRAM = 400, 24


def leading(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a number that sorts like them."""
    return w.octets(data).byteswap()


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All places of `data`, sorted by the bytes from there on, at least `depth` of them."""
    n = len(data)
    key = leading(data)
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    slots = np.arange(n)
    h = 8
    while h < depth and len(slots):
        single = new & np.concatenate([new[1:], [True]])
        slots, group = slots[~single], group[~single]
        if not len(slots):
            break
        members = order[slots]
        keys = (group << 32) | (rank[np.minimum(members + h, n)] + 1)
        by = np.argsort(keys)
        members, keys = members[by], keys[by]
        order[slots] = members
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[members] = group
        h *= 2
    return order


def shared_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: int | None = None) -> np.ndarray:
    """Length of the common prefix of a[i:] and b[j:] for each pair, to the ends of the data or `most`."""
    left, right = w.octets(a), w.octets(b)
    out = np.zeros(len(i), np.int64)
    room = np.minimum(len(a) - i, len(b) - j)
    if most is not None:
        room = np.minimum(room, most)
    live = np.flatnonzero(room > 0)
    at = 0
    while len(live):
        x = left[i[live] + at] ^ right[j[live] + at]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[live[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
        at += 8
        out[live] = at
        live = live[room[live] > at]
    return np.minimum(out, room)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in `order` but the first, the common prefix with the place before it."""
    if len(order) < 2:
        return np.empty(0, np.int64)
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    place = np.sort(order[1:])
    chained = np.zeros(len(place), bool)
    chained[1:] = (place[1:] == place[:-1] + 1) & (before[place[1:]] == before[place[:-1]] + 1)
    heads = np.flatnonzero(~chained)
    length = np.zeros(len(place), np.int64)
    length[heads] = shared_prefix(data, place[heads], data, before[place[heads]])
    head = heads[np.cumsum(~chained) - 1]
    length = np.maximum(length[head] - (place - place[head]), 0)
    late = np.flatnonzero((length == 0) & chained)  # past the end of a chain's first prefix: compared anew
    length[late] = shared_prefix(data, place[late], data, before[place[late]])
    at = np.zeros(len(data), np.int64)
    at[place] = length
    return at[order[1:]]


def _join(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the offsets of the pieces, and which places start a window inside one piece."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    return data, offsets, room >= width


def _search(data: np.ndarray, order: np.ndarray, other: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """For every place of `other`, how many suffixes in `order` come before it, by binary search."""
    keys, wanted = leading(data)[order], leading(other)[places]
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    padded, padded_other = np.append(data, np.uint8(0)), np.append(other, np.uint8(0))
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        here, there = order[mid], places[live]
        same = shared_prefix(data, here, other, there, width)
        less = (same < width) & (padded[here + same] < padded_other[there + same])
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    return low


def repeated(bodies: list[bytes], others: list[bytes] | None = None, width: int = WIDTH) -> list[list[int]]:
    """For each piece, ranges of the windows that occur in another place among all pieces.

    With `others` only windows that both sides hold count, and the pieces of both are returned.
    """
    data, offsets, valid = _join(bodies, width)
    flags = np.zeros(len(data), bool)
    order = suffix_array(data, width + 1)
    order = order[valid[order]]
    if others is None:
        same = np.flatnonzero(common_prefixes(data, order) >= width)
        flags[order[same]] = flags[order[same + 1]] = True
        return [runs_of(flags[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    data2, offsets2, valid2 = _join(others, width)
    flags2 = np.zeros(len(data2), bool)
    places = np.flatnonzero(valid2)
    if len(order) and len(places):
        at = np.minimum(_search(data, order, data2, places, width), len(order) - 1)
        hit = shared_prefix(data, order[at], data2, places, width) >= width
        flags2[places[hit]] = True
        flags[order[at[hit]]] = True
    return [
        runs_of(f[a:b])
        for f, o in ((flags, offsets), (flags2, offsets2))
        for a, b in zip(o[:-1], o[1:], strict=True)
    ]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def _marks(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = w.octets(data)
    out = eight[:n] * w.M1
    for at in range(8, GRAM, 8):
        out ^= out >> np.uint64(31)
        out = (out + eight[at : at + n]) * w.M2
    return w.mix(out)


def _text(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [body[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def method(width: int = WIDTH) -> Method:
    return Method(
        name="suffix",
        width=width,
        gram=GRAM,
        units=_units,
        marks=_marks,
        text=_text,
        compare=lambda bodies, ids, others, other_ids: repeated(bodies, others, width),
        other_document=False,
        unit_bytes=1.0,
        keep_places=True,
    )


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, spans): byte ranges of `docs` (doc_id, text) that repeated strings cover."""
    return spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), method(), **options)


def _kept(body: np.ndarray, runs: np.ndarray | None) -> tuple[np.ndarray, int, int]:
    """The remaining bytes, and the number of bytes and of maximal runs removed."""
    if runs is None or not len(runs):
        return body, 0, 0
    gone = covered(len(body), runs)
    return body[~gone], int(gone.sum()), len(runs_of(gone)) // 2


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                runs = batch.column(2)[i]
                kept, removed, parts = _kept(
                    data[offsets[i] : offsets[i + 1]], runs.values.to_numpy() if runs.is_valid else None
                )
                out.append((removed, parts, hashlib.sha256(kept.tobytes()).hexdigest()))
            removed, parts, digests = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(parts, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return (
        with_spans(docs, find(docs))
        .select("doc_id", F.col("text").cast("binary"), "_spans")
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def remove(docs: DataFrame, passage: int | None = None) -> DataFrame:
    """The rows of `docs`, all columns, without the repeated bytes.

    With `passage` the bytes of passages of that many words go as well where several documents hold them (see
    `passages`); both are judged on the texts as they come. A character that is cut in two goes; n_chars follows the text; a text of which nothing is left
    goes with its row, one that was empty before stays.
    """

    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(iter([batch]), "text"):
                columns, runs, words = part.column(0).flatten(), part.column(2), part.column(3)
                mask = runs.is_valid().to_numpy(zero_copy_only=False) | words.is_valid().to_numpy(zero_copy_only=False)
                changed = np.flatnonzero(mask)
                left = []
                for i in changed:
                    body, gone = data[offsets[i] : offsets[i + 1]], []
                    if runs[i].is_valid:
                        gone.append(runs[i].values.to_numpy())
                    if words[i].is_valid:
                        gone.append(passages.in_bytes(body, words[i].values.to_numpy()))
                    left.append(_kept(body, np.concatenate(gone))[0].tobytes().decode("utf-8", "ignore"))
                columns[at] = pc.replace_with_mask(part.column(1), pa.array(mask), pa.array(left, pa.string()))
                if chars is not None:
                    sizes = pa.array([len(x) for x in left], pa.int64()).cast(columns[chars].type)
                    columns[chars] = pc.replace_with_mask(columns[chars], pa.array(mask), sizes)
                stay = ~mask
                stay[changed] = [x != "" for x in left]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay))
        give_back()

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # whatever the columns are called
    packed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = with_spans(packed, find(docs)).withColumnRenamed("_spans", "_bytes")
    if passage is None:
        cut = cut.withColumn("_spans", F.lit(None).cast("array<int>"))
    else:
        cut = with_spans(cut, passages.find(docs, passage))
    cut = cut.select("row", "text", "_bytes", "_spans")
    kind = [T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema]
    return cut.mapInArrow(run, T.StructType(kind))
