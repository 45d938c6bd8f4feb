"""Nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import neighbours


def brute(rows, every=20, top=20):
    ok = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 16 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    matrix = np.stack([ok[i] for i in ids]) if len(ids) else np.empty((0, 16))
    out = {}
    for i in ids:
        if i % every == 0:
            scores = (matrix * ok[i]).sum(axis=1)
            order = [(j, s) for j, s in sorted(zip(ids.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0])) if j != i]
            out[int(i)] = order[:top]
    return out


def vectors(n, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 16))
    data = (centres[rnd.integers(0, 12, n)] + 0.4 * rnd.normal(size=(n, 16))).astype(np.float32)
    return [(i, [float(x) for x in v]) for i, v in enumerate(data)]


def check(got, want, least):
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {q for q, x in want.items() if x}
    hits = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
        total += len(want[q])
    assert hits >= least * total, hits / max(total, 1)


def test_recall_and_order(spark):
    rows = vectors(1500)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.nearest(frame, cell_rows=150, splits=3).collect()
    check(got, brute(rows), 0.95)
    best = {(q, v): s for q, x in brute(rows).items() for v, s in x}
    assert all(abs(r.score - best[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in best)


def test_odd_rows_copies_and_ties(spark):
    rows = vectors(120, seed=2)
    rows += [(200 + i, rows[5][1]) for i in range(300)] + [rows[7], rows[20], (None, rows[1][1])]
    rows += [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0] * 15 + [None]), (980, [1.0] * 15)]
    rows += [(1000, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS h")
    got = neighbours.nearest(frame).collect()
    check(got, brute(rows), 1.0)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {
        (q, k + 1): v for q, x in brute(rows).items() for k, (v, _) in enumerate(x)
    }


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = vectors(3)[:n]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(neighbours.nearest(frame).collect(), brute(rows), 1.0)


def test_near_copies_and_a_long_vector(spark):
    """Vectors that differ by less than half precision tells, and one of very large norm."""
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=16) + 0.004 * rnd.normal(size=(3000, 16))
    data = np.concatenate([data / np.linalg.norm(data, axis=1, keepdims=True), rnd.normal(size=(500, 16)), data[:1] * 1e6])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data.astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    check(neighbours.nearest(frame, every=50).collect(), brute(rows, 50), 0.95)


def test_large_cells_are_divided_and_sizes_grow():
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=16)
    matrix = centre + 0.01 * rnd.normal(size=(5000, 16))
    cells = neighbours._cells(matrix, 100)
    assert all(len(c) <= 400 for c in cells)
    assert sorted(np.concatenate(cells).tolist()) == list(range(5000))
    # Cells lie close together: their own spread is less than that of the whole.
    assert np.mean([matrix[c].var(axis=0).sum() for c in cells if len(c) > 20]) < 0.9 * matrix.var(axis=0).sum()
    small, large = neighbours.sizes(50_000), neighbours.sizes(200_000)
    assert all(y > x for x, y in zip(small, large, strict=True))
    assert neighbours.STILL <= 0.01


def test_a_part_is_one_row_and_a_round_compares_all_who_meet(spark):
    """Edges pass between tasks as one row for each part; what a round finds is held against plain Python."""
    rows = vectors(700, seed=5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    named, _ = neighbours.nodes(neighbours.usable(frame, "vec_id", "embedding"), 20)
    parts = neighbours.dealt(named)
    number = {}
    for r in parts.vectors.collect():
        for place, i in enumerate(np.frombuffer(r.x, np.int64).tolist()):
            number[place * parts.count + r.part] = i
    assert sorted(number.values()) == list(range(700))

    def lists(edges):
        got, new = {i: {} for i in range(700)}, set()
        assert edges.count() <= parts.count
        for r in edges.collect():
            for a, b, s in zip(*(np.frombuffer(x, k).tolist() for x, k in ((r.x, "i4"), (r.y, "i4"), (r.s, "f8"))), strict=True):
                assert a % parts.count == r.part
                got[number[a]][number[b >> 1]] = s
                if b & 1:
                    new.add((number[a], number[b >> 1]))
        return got, new

    degree = 6
    before = neighbours.start(named, parts, degree, cell_rows=60, splits=4)
    after = neighbours.descend(parts, before, degree)
    old, _ = lists(before)
    got, new = lists(after)
    matrix = np.array([v for _, v in rows], np.float32).astype(float)
    scores = matrix @ matrix.T
    want = {i: set(x) for i, x in old.items()}
    for at in range(700):
        back = sorted((a for a in old if at in old[a]), key=lambda a: -old[a][at])[:degree]
        here = {at, *old[at], *back}
        for x in here:
            want[x] |= here - {x}
    for i, x in want.items():
        best = sorted(x, key=lambda j: -scores[i, j])[:degree]
        assert set(best) == set(got[i])
        assert all(abs(got[i][j] - scores[i, j]) < 1e-12 for j in best)
    assert new == {(a, b) for a in got for b in got[a] if b not in old[a]}
    assert after.agg({"fresh": "sum"}).first()[0] == len(new) > 0
