"""Approximate nearest neighbours by largest inner product, on a graph made by NN-descent.

Rows with the same vector are one node, named by its smallest id; a node keeps the ids of its
`top` + 1 smallest rows, which are all that an answer with ties to smaller ids can use.

The graph starts from several divisions of the nodes into cells of about `CELL_ROWS` of like direction
around random pivots: each node gets its best neighbours within its cells. A cell that is much too
large is divided again by pivots of its own, around its own mean. Then the graph descends: neighbours
of neighbours, in both directions, are likely neighbours. In a round each node meets the nodes it is
a neighbour of and its own neighbours (the best ones, a fixed number of either); all who meet at a
node are compared there if at least one of them is new there, and each node keeps its best. What a
node has already bettered is not sent on. Rounds end when no more than `STILL` of the edges change. Neighbours of a
node, divisions and the breadth of the search grow with the nodes (see `Sizes`), as more nodes are
harder to tell apart.

A query starts at its own node, as every query is a row of the table, and searches greedily: of
the `beam` best nodes it has seen, those not yet opened are opened, their neighbours on the graph
scored, until none of the best is unopened. Nodes are dealt to parts by hash, and a row that passes
between tasks holds the numbers, vectors and scores of many nodes (see `MAIL`). The longest vectors are scored for every query. All
comparisons are in double precision on the original vectors, so every node seen has its exact score.

Defined cases: vectors that are null, zero, or hold nulls or non-finite components, and rows
without id, take no part; so do vectors whose length is not the most common one. Fewer candidates
than `top` are returned as they are. Repeated rows with one id are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat
from tidemark.llm.store import release, settled

CELL_ROWS, PIVOTS = 1500, 4096
ROUNDS, STILL = 12, 0.01

#: Nodes of a part; edges a task gathers before it keeps the best of them; bytes of vectors a block of meetings holds.
PART_NODES, HELD, BLOCK_BYTES = 8192, 1 << 20, 200 << 20

#: Rows that pass between parts: numbers, vectors and scores of many nodes, as bytes.
MAIL = "part int, kind int, x binary, y binary, s binary"
VECTORS, LOW, EDGES, BACK, FOUND, ASK, MEET, QUERIES, BEST, OPEN, CAND = range(11)


class Sizes(NamedTuple):
    """What grows with the nodes: neighbours of a node, divisions, nodes a search keeps open."""

    degree: int
    splits: int
    beam: int


def sizes(total: int) -> Sizes:
    more = max(1.0, total / 50_000)
    return Sizes(round(48 * more**0.25), round(10 * more**0.25), round(72 * more**0.5))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = (
        F.col(id_col).isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


def nodes(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(node, h) of distinct vectors, h their bytes, and (id, node) of their `top` + 1 smallest ids.

    Copies are found by hash and vector; the smallest ids of a vector that very many rows share
    are found in parts of the ids first, so no group is ever sorted in one task.
    """
    rows = rows.withColumn("key", F.xxhash64("v"))
    first = settled(rows.groupBy("key", "v").agg(F.min("id").alias("node")), "distinct-vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = pa.array([x.tobytes() for x in _matrix(batch.column(1))], pa.binary())
                yield pa.record_batch([batch.column(0), h], ["node", "h"])

    named = settled(first.select("node", "v").mapInArrow(pack, "node long, h binary"), "nodes")
    member = rows.join(first.hint("merge"), ["key", "v"]).select("id", "node").distinct()
    part = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    few = member.withColumn("p", F.row_number().over(part)).where(F.col("p") <= top + 1)
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = few.withColumn("p", place).where(F.col("p") <= top + 1).select("id", "node")
    return named, settled(few, "members")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a column of single-precision bytes, in double precision."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    return data.view(np.float32).reshape(n, -1).astype(np.float64) if n else np.empty((0, 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _cells(matrix: np.ndarray, cell_rows: int) -> list[np.ndarray]:
    """Rows in groups of at most four cells' size, divided by pivots drawn from the group itself."""
    size, done, stack = 4 * cell_rows, [], [np.arange(len(matrix))]
    random = np.random.default_rng(len(matrix))
    while stack:
        some = stack.pop()
        if len(some) <= size:
            done.append(some)
            continue
        own = _unit(matrix[some])
        own = _unit(own - own.mean(axis=0))
        pivots = own[random.choice(len(some), min(256, max(2, len(some) // cell_rows)), replace=False)].T
        best = np.concatenate([(own[at : at + 4096] @ pivots).argmax(axis=1) for at in range(0, len(some), 4096)])
        order = np.argsort(best, kind="stable")
        parts = np.split(some[order], np.flatnonzero(np.diff(best[order])) + 1)
        if max(map(len, parts)) <= 0.9 * len(some):
            stack += parts
            continue
        order = some[np.argsort(own @ pivots[:, 0])]  # not to be told apart: overlapping runs along one direction
        done += [order[at : at + size] for at in range(0, len(some) - size // 2, size // 2)]
    return done


def _over(scores: np.ndarray, low: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores above `low` of their row, of each row the `top` best at most."""
    over = scores > low[:, None]
    many = np.flatnonzero(np.count_nonzero(over, axis=1) > top)
    if len(many):
        best = np.argpartition(-scores[many], top - 1, axis=1)[:, :top]
        over[many] = False
        over[many[:, None], best] = True
    return np.divmod(np.flatnonzero(over), max(1, scores.shape[1]))


def _best_pairs(ids: np.ndarray, matrix: np.ndarray, low: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row its `top` best other rows above `low`: (a, b, score)."""
    for at in range(0, len(ids), 512):
        scores = matrix[at : at + 512] @ matrix.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        i, j = _over(scores, low[at : at + 512], top)
        yield ids[at + i], ids[j], scores[i, j]


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` best distinct edges of each `a`, sorted by `a` and from the best."""
    key = _key(a, b)
    order = np.argsort(key)
    key = key[order]
    order = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(order) else order
    group = np.cumsum(np.concatenate([[0], np.diff(a[order]) != 0])) if len(order) else order
    by = np.argsort(-s[order])
    small = group[by].astype(np.uint16 if len(group) and group[-1] < 1 << 16 else np.int64)  # sorted by radix
    by = by[np.argsort(small, kind="stable")]
    group = group[by]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    return order[by[place < top]]


def _absent(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are not among the known, which are sorted."""
    place = np.searchsorted(known, keys)
    return np.append(known, -1)[place] != keys


class _Lists:
    """Edges as they come, thinned out to the best `top` of each node whenever many are held."""

    def __init__(self, top: int):
        self.top, self.held, self.rows, self.next = top, [], 0, HELD

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        self.held.append((a, b, s))
        self.rows += len(a)
        if self.rows > self.next:
            self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        a, b, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        best = _best(a, b, s, self.top)
        self.held, self.rows, self.next = [(a[best], b[best], s[best])], len(best), 2 * len(best) + HELD
        return self.held[0]


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each range of rows."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:], dtype=np.int64))
    offsets = (ends * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _mail(to: np.ndarray, kind: int, x: np.ndarray, y: np.ndarray | None = None, s: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each part that something goes to."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")
    to = to[order]
    ends = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
    none = np.empty((len(to), 0), np.uint8)
    cells = [_packed(none if c is None else c[order], ends) for c in (x, y, s)]
    return pa.record_batch([pa.array(to[ends[:-1]], pa.int32()), pa.array(np.full(len(ends) - 1, kind), pa.int32()), *cells], MAIL_NAMES)


MAIL_NAMES = [x.split()[0] for x in MAIL.split(", ")]


def _row(part: int, kind: int, x: np.ndarray, y: np.ndarray | None = None, s: np.ndarray | None = None) -> pa.RecordBatch:
    """One row, also of nothing."""
    cells = [pa.array([b"" if c is None else np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (x, y, s)]
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), *cells], MAIL_NAMES)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each part in turn its rows (part, kind, x, y, s), the last three as bytes."""

    def rows():
        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cells = [flat(batch.column(k)) for k in (2, 3, 4)]
            for r in range(batch.num_rows):
                yield int(part[r]), int(kind[r]), *(data[ends[r] : ends[r + 1]] for data, ends in cells)

    return groupby(rows(), key=lambda row: row[0])


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind")


def _read(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x.view(np.int32), y.view(np.int32), s.view(np.float64)


def _lows(a: np.ndarray, s: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes whose list is full, and the score of their worst edge. Edges are sorted by node and from the best."""
    last = np.flatnonzero(np.concatenate([np.diff(a) != 0, [True]])) if len(a) else np.empty(0, np.int64)
    full = last[np.diff(last, prepend=-1) >= degree]
    return a[full], s[full]


class Parts(NamedTuple):
    """The nodes dealt by hash. A node's number is its place in its part, times the parts, plus its part."""

    vectors: DataFrame  # a row of MAIL for each part: x the ids in order, y the vectors
    count: int
    total: int
    width: int  # of a vector


def _part(node: str, count: int) -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit(29)), F.lit(count)).cast("int")


def dealt(named: DataFrame) -> Parts:
    total = named.count()
    count = max(-(-total // PART_NODES), min(24, -(-total // 256)), 1)

    def pack(group: pa.Table) -> pa.Table:
        ids = group["node"].to_numpy()
        order = np.argsort(ids)
        data, _ = flat(group["h"])
        return pa.Table.from_batches([_row(group["part"][0].as_py(), VECTORS, ids[order], data.reshape(len(ids), -1)[order])])

    vectors = settled(named.withColumn("part", _part("node", count)).groupBy("part").applyInArrow(pack, MAIL), "parts")
    first = named.select(F.length("h").alias("n")).first()
    if total >= 1 << 29:
        raise ValueError("numbers of nodes, which the parts make a little larger, take 30 bits")
    return Parts(vectors, count, total, first.n // 4 if first else 0)


def _numbered(parts: Parts, part: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and single-precision vectors of a part."""
    h = y.view(np.float32).reshape(-1, parts.width)
    return (np.arange(len(h), dtype=np.int64) * parts.count + part).astype(np.int32), h


def start(named: DataFrame, parts: Parts, degree: int, cell_rows: int = CELL_ROWS, splits: int = 10) -> DataFrame:
    """First neighbours: the best within cells of nearest random pivots.

    The first few divisions tell each node a score that the neighbours from all the others must exceed.
    """
    cells = max(1, parts.total // cell_rows)
    per = min(cells, PIVOTS // splits)
    pivots = named.select("node", "h").orderBy(F.xxhash64("node", F.lit(17))).limit(per * splits).toArrow()
    shared = named.sparkSession.sparkContext.broadcast(_unit(_vectors(pivots.column("h"))))
    shape = parts._replace(vectors=None)

    def wave(some: range, edges: DataFrame | None) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _letters(batches):
                for _, kind, x, y, s in rows:
                    if kind == VECTORS:
                        number, h = _numbered(shape, part, y)
                        low = np.full(len(number), -np.inf)
                    else:
                        a, _, s = _read(x, y, s)
                        a, s = _lows(a, s, degree)
                        low[a // shape.count] = s
                cell = np.empty((len(number), len(some)), np.int32)
                for at in range(0, len(number), 1024):
                    scores = h[at : at + 1024].astype(np.float64) @ shared.value[some.start * per : some.stop * per].T
                    for k in range(len(some)):
                        own = scores[:, k * per : (k + 1) * per]
                        cell[at : at + 1024, k] = own.argmax(axis=1) * len(some) + k if own.shape[1] else k
                for k in range(len(some)):
                    yield _mail(cell[:, k], VECTORS, number, h, low)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, held = [], 0
            for _, rows in _letters(batches):
                ids, h, low = (np.concatenate(x) for x in zip(*(x[2:] for x in rows), strict=True))
                ids, low = ids.view(np.int32), low.view(np.float64)
                matrix = h.view(np.float32).reshape(-1, shape.width).astype(np.float64)
                for own in _cells(matrix, cell_rows):
                    for pairs in _best_pairs(ids[own], matrix[own], low[own], degree):
                        found.append(pairs)
                        held += len(pairs[0])
                        if held > HELD:
                            yield _edges(found, shape.count)
                            found, held = [], 0
            if found:
                yield _edges(found, shape.count)

        told = parts.vectors if edges is None else _sorted(parts.vectors.unionByName(edges), parts.count)
        sent = told.mapInArrow(deal, MAIL)
        spread = _sorted(sent, min(per * len(some), parts.count * len(some)))
        return merged(parts, edges, spread.mapInArrow(compare, MAIL), degree, all_new=True)

    first = max(1, round(splits**0.5))
    edges = wave(range(first), None)
    return wave(range(first, splits), edges.select(*MAIL_NAMES)) if first < splits else edges


def _edges(found: list[tuple[np.ndarray, ...]], count: int, kind: int = FOUND) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return _mail(a % count, kind, a, b, s)


def merged(parts: Parts, edges: DataFrame | None, found: DataFrame, degree: int, all_new: bool = False) -> DataFrame:
    """Each part's edges, sorted by node and from the best; `fresh` counts those that were not there.

    In EDGES, as in what is made of them, the other end is twice its number, plus one if the edge is new.
    """
    count = parts.count

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            lists, known = _Lists(degree), np.empty(0, np.int64)
            for _, kind, *cells in rows:
                a, b, s = _read(*cells)
                if kind == EDGES:
                    b = b >> 1
                    known = np.sort(_key(a, b))
                lists.add(a, b, s)
            a, b, s = lists.edges()
            new = _absent(_key(a, b), known)
            fresh = pa.array([int(new.sum())], pa.int64())
            yield _row(part, EDGES, a, b * 2 + (new | all_new), s).append_column("fresh", fresh)

    rows = found if edges is None else edges.unionByName(found)
    return settled(_sorted(rows, count).mapInArrow(best, MAIL + ", fresh long"), "graph")


def descend(parts: Parts, edges: DataFrame, degree: int) -> DataFrame:
    """One round: all who meet at a node are compared, and each keeps its best.

    Two are compared where at least one of them is new. Meetings are held in blocks of nodes; a vector is sent to each
    block once, however many meetings there it attends.
    """
    shape, count = parts._replace(vectors=None), parts.count
    vector = max(1, 4 * parts.width)
    blocks = min(count, 24)
    if parts.total * vector > BLOCK_BYTES:
        blocks = max(blocks, -(-parts.total * vector * (2 * degree + 1) // BLOCK_BYTES))
    within = -(-blocks // count)  # blocks of a part, if there are more blocks than parts

    def block(at: np.ndarray) -> np.ndarray:
        return at % count % blocks if within == 1 else at % count * within + at // count % within

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _letters(batches):
            for _, _, *cells in rows:
                a, b, s = _read(*cells)
                lists = _Lists(degree)
                lists.add(b >> 1, a * 2 + (b & 1), s)
                yield _edges([lists.edges()], count, BACK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            lists, forth = _Lists(degree), (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
            for _, kind, *cells in rows:
                if kind == EDGES:
                    forth = _read(*cells)
                else:
                    lists.add(*_read(*cells))
            a, b, _ = lists.edges()
            a, b = np.concatenate([forth[0], a]), np.concatenate([forth[1], b])
            new = (b & 1).astype(bool)
            own = np.unique(a[new])  # where nobody is new, all have met
            key = np.unique(np.concatenate([_key(a, b >> 1)[np.isin(a, own)], _key(own, own)]))
            new = ~_absent(key, np.unique(_key(a, b >> 1)[new]))
            at, node = (key >> 32).astype(np.int32), key.astype(np.int32)
            to = block(at)
            yield _mail(to, MEET, at, node * 2 + new)
            ask = np.unique(_key(to, node))
            to, node = (ask >> 32).astype(np.int32), ask.astype(np.int32)
            yield _mail(node % count, ASK, node, to)
            full, low = _lows(forth[0], forth[2], degree)
            yield _row(part, LOW, full, None, low)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            asked = []
            for _, kind, x, y, s in rows:
                if kind == VECTORS:
                    number, h = _numbered(shape, part, y)
                    low = np.full(len(number), -np.inf)
                elif kind == LOW:
                    low[x.view(np.int32) // count] = s.view(np.float64)
                else:
                    asked.append(_key(y.view(np.int32), x.view(np.int32)))
            key = np.unique(np.concatenate(asked)) if asked else np.empty(0, np.int64)
            to, place = (key >> 32).astype(np.int32), key.astype(np.int32) // count
            for at in range(0, len(to), 1 << 16):
                own = place[at : at + (1 << 16)]
                yield _mail(to[at : at + (1 << 16)], VECTORS, number[own], h[own], low[own])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _letters(batches):
            meetings, ids = [], None
            for _, kind, x, y, s in rows:
                if kind == MEET:
                    meetings.append((x.view(np.int32), y.view(np.int32)))
                    continue
                if ids is None:
                    at, node = (np.concatenate(m) for m in zip(*meetings, strict=True))
                    del meetings
                    ids = np.unique(node >> 1)
                    h, low = np.empty((len(ids), shape.width), np.float32), np.empty(len(ids))
                place = np.searchsorted(ids, x.view(np.int32))
                h[place], low[place] = y.view(np.float32).reshape(-1, shape.width), s.view(np.float64)
            if ids is None:
                continue
            new, node = (node & 1).astype(bool), np.searchsorted(ids, node >> 1)
            ends = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            found = _Lists(degree)
            for one, other in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                here, fresh = node[one:other], np.flatnonzero(new[one:other])
                known = np.flatnonzero(~new[one:other])
                matrix = h[here].astype(np.float64)
                scores = matrix[fresh] @ matrix.T
                scores[np.arange(len(fresh)), fresh] = -np.inf
                i, j = _over(scores, low[here[fresh]], degree)
                found.held.append((ids[here[fresh[i]]], ids[here[j]], scores[i, j]))
                found.rows += len(i)
                i, j = _over(scores[:, known].T, low[here[known]], degree)
                found.held.append((ids[here[known[i]]], ids[here[fresh[j]]], scores[j, known[i]]))
                found.rows += len(i)
                if found.rows > HELD:
                    yield _edges([found.edges()], count)
                    found = _Lists(degree)
            yield _edges([found.edges()], count)

    edges = edges.select(*MAIL_NAMES)
    told = _sorted(edges.unionByName(edges.mapInArrow(back, MAIL)), count).mapInArrow(meet, MAIL)
    told = settled(told, "meetings")
    sent = _sorted(parts.vectors.unionByName(told.where(F.col("kind") != MEET)), count).mapInArrow(send, MAIL)
    # VECTORS are the lowest kind, but a block wants its meetings first.
    sent = sent.withColumn("kind", F.lit(MEET + 1))
    held = _sorted(told.where(F.col("kind") == MEET).unionByName(sent), blocks if within == 1 else count * within).mapInArrow(compare, MAIL)
    return merged(parts, edges, held, degree)


def graph(named: DataFrame, parts: Parts, degree: int = 48, rounds: int = ROUNDS, still: float = STILL, **options) -> DataFrame:
    """Rows of MAIL with up to `degree` neighbours of each node: x the nodes, y their neighbours, s the scores."""
    edges = start(named, parts, degree, **options)
    total = edges.agg(F.sum(F.length("x") / 4)).first()[0] or 0
    for _ in range(rounds if total else 0):
        edges = descend(parts, edges, degree)
        release(named)
        if edges.agg(F.sum("fresh")).first()[0] <= still * total:
            break
    return edges.select(*MAIL_NAMES)


def _longest(parts: Parts, count: int) -> list:
    """(number, h) of the longest vectors."""
    shape = parts._replace(vectors=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            for _, _, x, y, _ in rows:
                number, h = _numbered(shape, part, y)
                length, ids = np.linalg.norm(h.astype(np.float64), axis=1), x.view(np.int64)
                own = np.lexsort((ids, -length))[:count]
                cells = pa.array([v.tobytes() for v in h[own]], pa.binary())
                yield pa.record_batch([pa.array(number[own]), pa.array(ids[own]), pa.array(length[own]), cells], ["number", "node", "l", "h"])

    lengths = parts.vectors.mapInArrow(run, "number int, node long, l double, h binary")
    return lengths.orderBy(F.desc("l"), "node").limit(count).select("number", "h").collect()


def search(
    parts: Parts, edges: DataFrame, members: DataFrame, queries: DataFrame, top: int = 20, beam: int = 72
) -> DataFrame:
    """(query_id, rank, id, score) for `queries` (query_id, node); `node` is the node of the query's own row.

    A query's state is its vector and the best `beam` nodes seen, which lie in the part of its own node. What has
    been seen and is not among them is scored again if met again, and is again too low.
    """
    shape, count = parts._replace(vectors=None), parts.count
    beam = max(beam, top + 1)
    # The longest vectors are near many queries, but only some of those are near them; they are only scored.
    long = [(r.number, np.frombuffer(r.h, np.float32).astype(np.float64)) for r in _longest(parts, top + 1)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _mail(batch.column(0).to_numpy(), QUERIES, batch.column(1).to_numpy())

    def stated(part: int, q: np.ndarray, h: np.ndarray, own: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        query, node, s, opened = own
        fresh = pa.array([0], pa.int64()), pa.array([int((~opened).sum())], pa.int64())
        yield _row(part, QUERIES, q, h).append_column("fresh", fresh[0])
        yield _row(part, BEST, np.stack([query, node], axis=1).astype(np.int32), opened, s).append_column("fresh", fresh[1])

    def best(query: np.ndarray, node: np.ndarray, s: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, ...]:
        own = _best(query, node, s, beam)
        return query[own], node[own], s[own], opened[own]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            asked, ids = [], np.empty(0, np.int64)
            for _, kind, x, y, _ in rows:
                if kind == VECTORS:
                    ids, (number, h) = x.view(np.int64), _numbered(shape, part, y)
                else:
                    asked.append(x.view(np.int64))
            if not asked:
                continue
            place = np.searchsorted(ids, np.unique(np.concatenate(asked)))
            q, h = number[place], h[place]
            matrix = h.astype(np.float64)
            rows = [(q, q, (matrix * matrix).sum(axis=1), np.zeros(len(q), bool))]
            for far, v in long:
                own = q != far
                rows.append((q[own], np.full(own.sum(), far, np.int32), (matrix[own] * v).sum(axis=1), np.ones(own.sum(), bool)))
            yield from stated(part, q, h, best(*(np.concatenate(x) for x in zip(*rows, strict=True))))

    def read(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        query, node = x.view(np.int32).reshape(-1, 2).T
        return query, node, s.view(np.float64), y.view(bool)

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _letters(batches):
            for _, _, *cells in rows:
                query, node, _, opened = read(*cells)
                yield _mail(node[~opened] % count, OPEN, node[~opened], query[~opened])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of queries that still open nodes, and the score to exceed, to all parts."""
        for _, rows in _letters(batches):
            for _, kind, x, y, s in rows:
                if kind == QUERIES:
                    q, h = x.view(np.int32), y.view(np.float32).reshape(-1, shape.width)
                    continue
                query, _, s, opened = read(x, y, s)
                full, worst = _lows(query, s, beam)
                low = np.full(len(q), -np.inf)
                low[np.searchsorted(q, full)] = worst
                own = np.searchsorted(q, np.unique(query[~opened]))
                for to in range(count if len(own) else 0):
                    yield _row(to, QUERIES, q[own], h[own], low[own])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _letters(batches):
            ends = np.zeros(1, np.int64)
            for _, kind, x, y, _ in rows:
                if kind == EDGES:
                    ends = np.concatenate([[0], np.cumsum(np.bincount(x.view(np.int32) // count))])
                    near = y.view(np.int32) >> 1
                    continue
                place, query = x.view(np.int32) // count, y.view(np.int32)
                if len(ends) == 1:  # no node here has neighbours
                    continue
                query, place = query[place < len(ends) - 1], place[place < len(ends) - 1]
                size = ends[place + 1] - ends[place]
                upto = np.cumsum(size)
                at = 0
                while at < len(place):
                    to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD)))
                    own = size[at:to]
                    node = near[np.repeat(ends[place[at:to]] - np.cumsum(own) + own, own) + np.arange(own.sum())]
                    key = np.unique(_key(np.repeat(query[at:to], own), node))
                    node = key.astype(np.int32)
                    yield _mail(node % count, CAND, node, (key >> 32).astype(np.int32))
                    at = to

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            told, q, found = [], None, _Lists(beam)
            for _, kind, x, y, s in rows:
                if kind == VECTORS:
                    h = _numbered(shape, part, y)[1].astype(np.float64)
                    continue
                if kind == QUERIES:
                    told.append((x.view(np.int32), y.view(np.float32).reshape(-1, shape.width), s.view(np.float64)))
                    continue
                if q is None:
                    q, qh, low = (np.concatenate(c) for c in zip(*told, strict=True))
                    order = np.argsort(q)
                    q, qh, low = q[order], qh[order].astype(np.float64), low[order]
                    del told
                node, query = x.view(np.int32), y.view(np.int32)  # sorted by query
                ends = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1, [len(query)]])
                place = np.repeat(np.searchsorted(q, query[ends[:-1]]), np.diff(ends))
                for at in range(0, len(node), 1 << 13):
                    n, k = node[at : at + (1 << 13)], place[at : at + (1 << 13)]
                    s = np.einsum("ij,ij->i", h[n // count], qh[k])
                    own = s > low[k]
                    found.add(q[k[own]], n[own], s[own])
            query, node, s = found.edges()
            yield _mail(query % count, FOUND, np.stack([query, node], axis=1), np.zeros(len(s), bool), s)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            found, own = _Lists(beam), ()
            for _, kind, x, y, s in rows:
                if kind == QUERIES:
                    q, h = x.view(np.int32), y.view(np.float32).reshape(-1, shape.width)
                elif kind == BEST:
                    query, node, s, _ = read(x, y, s)
                    own = query, node, s, np.ones(len(s), bool)  # those to be opened have been
                else:
                    found.add(*read(x, y, s)[:3])
            new = found.edges()
            fresh = _absent(_key(*new[:2]), np.sort(_key(*own[:2])))  # the state's own have a say about being opened
            both = zip(own, (*(x[fresh] for x in new), np.zeros(fresh.sum(), bool)), strict=True)
            yield from stated(part, q, h, best(*(np.concatenate(x) for x in both)))

    own = queries.select(_part("node", count).alias("part"), "node").distinct()
    known = parts.vectors.unionByName(own.mapInArrow(ask, MAIL))
    state = settled(_sorted(known, count).mapInArrow(begin, MAIL + ", fresh long"), "seen")
    near = edges.withColumn("s", F.lit(b""))
    while state.agg(F.sum("fresh")).first()[0]:
        state = state.select(*MAIL_NAMES)
        fresh = state.where(F.col("kind") == BEST).mapInArrow(front, MAIL)
        fresh = _sorted(near.unionByName(fresh), count).mapInArrow(widen, MAIL)
        fresh = parts.vectors.unionByName(_sorted(state, count).mapInArrow(tell, MAIL)).unionByName(fresh)
        fresh = _sorted(fresh, count).mapInArrow(score, MAIL)
        # FOUND is a lower kind than that of the state, which comes first.
        fresh = fresh.withColumn("kind", F.lit(BEST + 1))
        state = settled(_sorted(state.unionByName(fresh), count).mapInArrow(gather, MAIL + ", fresh long"), "seen")
        release(state)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _letters(batches):
            for _, _, *cells in rows:
                query, node, s, _ = read(*cells)
                first = np.searchsorted(query, query)
                last = np.minimum(first + top, np.searchsorted(query, query, "right") - 1)
                own = s >= s[last]
                yield pa.record_batch([pa.array(x[own]) for x in (query, node, s)], ["qn", "n", "s"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _letters(batches):
            for _, _, x, y, _ in rows:
                number, _ = _numbered(shape, part, y)
                yield pa.record_batch([pa.array(number), pa.array(x.view(np.int64))], ["n", "node"])

    named = settled(parts.vectors.mapInArrow(name, "n int, node long"), "names")
    best_ = state.where(F.col("kind") == BEST).select(*MAIL_NAMES).mapInArrow(result, "qn int, n int, s double")
    best_ = best_.join(named.hint("merge"), "n").select("qn", "node", "s")
    seen = best_.join(named.select(F.col("n").alias("qn"), F.col("node").alias("q")).hint("merge"), "qn").select("q", "node", "s")
    order = [F.desc("s"), "node"]
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    best = seen.withColumn("r", place).where(F.col("r") <= top + 1).select("q", "node", "s")
    # A node stands for all rows with its vector; the query's own row is no candidate.
    found = best.join(members.hint("merge"), "node").select("q", "id", "s")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    found = found.withColumn("r", place).where(F.col("r") <= top + 1).drop("r")
    rows = found.join(queries.select(F.col("node").alias("q"), "query_id").hint("merge"), "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("s").alias("score"))


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, **options
) -> DataFrame:
    """(query_id, rank, id, score): the nearest of each row whose id is divisible by `every`."""
    rows = settled(usable(rows, id_col, vector_col), "vectors")
    named, members = nodes(rows, top)
    parts = dealt(named)
    grown = sizes(parts.total)
    edges = graph(named, parts, **{"degree": grown.degree, "splits": grown.splits} | options)
    first = rows.groupBy(F.xxhash64("v").alias("key"), "v").agg(F.min("id").alias("node"))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "v").distinct()
    asked = asked.withColumn("key", F.xxhash64("v")).join(first.hint("merge"), ["key", "v"])
    found = search(parts, edges, members, settled(asked.select("query_id", "node"), "asked"), top, grown.beam)
    return found.withColumnRenamed("id", id_col)
