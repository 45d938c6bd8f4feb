"""Mined negatives against plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import negatives


def brute(rows):
    sound = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if math.sqrt(sum(c * c for c in x)) >= 2**31:
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        sound[i] = min(sound.get(i, (math.inf,)), (int(label), x))
    out = []
    for a, (label, x) in sound.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), b, k) for b, (k, y) in sound.items() if b != a)
        for s, b, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, b, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def corpus(seed: int, n: int, dims: int = 6) -> list[tuple]:
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        v = [m + rnd.gauss(0, 0.4) for m in rnd.choice(middles)]
        if rnd.random() < 0.2:
            v = middles[0]  # a hot vector
        if rnd.random() < 0.1:
            v = [round(c) for c in v]  # ties
        rows.append((i - 60, [float(c) for c in v], rnd.choice([0, 0, 0, 1, 2, 9, 11])))
    rows += [rows[3], (rows[5][0], rows[6][1], 1), (None, rows[0][1], 1), (10_000, None, 1), (10_050, rows[0][1], None)]
    rows += [(10_100, [float("nan")] * dims, 1), (10_150, [float("inf")] + [0.0] * (dims - 1), 1), (10_200, [None] * dims, 1)]
    rows += [(10_250, [0.0] * dims, 0), (10_300, [], 0), (10_350, [1.0, 2.0], 0), (10_400, [1.0] * (dims + 3), 0), (10_450, [1e30] * dims, 0)]
    rows += [(10_500, [3e6] * dims, 0), (10_501, [2.9e6] * dims, 1), (10_502, [2.0e6] * dims, 0)]  # beyond exact doubles
    rnd.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, node string, page int"


@pytest.mark.parametrize("small", [False, True])
def test_mined_negatives(spark, small, monkeypatch):
    if small:  # many clusters, blocks and pages
        for name, value in {"CLUSTER": 4, "BLOCK": 7, "PAGE": 2}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = corpus(2, 700)
    got = negatives.mine(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_tables_without_anchors(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1, "", 0), (3, [1.0], 1, "", 0)], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1, "", 0), (3, [1.0], 2, "", 0)], SCHEMA)
    assert negatives.mine(alone).count() == 0


def test_walk_ends_early_and_bounds_hold(monkeypatch):
    """Clustered directions: an anchor stops after a part of the list, and what it skips cannot matter."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    near = rng.normal(0, 0.05, (400, 8)) + np.eye(8)[0]
    far = rng.normal(0, 0.05, (4000, 8)) - np.eye(8)[0]
    x = np.floor(256 * np.concatenate([near, far])).astype(np.int64)
    norm = np.linalg.norm(x, axis=1)
    page = pa.table({"label": [1] * len(x), "x": x.tolist(), "norm": norm, "ids": [[i] for i in range(len(x))]})
    anchors = x[:20]
    centre = negatives.learn_centres(anchors.astype(float), 1)[0]
    angle = negatives.angles(anchors.astype(float), norm[:20], centre[None, :])[:, 0]
    table = pa.table(
        {"node": [str(i) for i in range(20)], "x": anchors.tolist(), "norm": norm[:20], "angle": angle, "label": [1] * 20}
        | {"p": [[0]] * 20, "low": [[-negatives.FAR]] * 20, "high": [[negatives.FAR]] * 20}
    )
    chunks = []
    monkeypatch.setattr(negatives, "CHUNK", 64)
    monkeypatch.setattr(np, "nonzero", lambda v, f=np.nonzero: chunks.append(1) or f(v))
    found = negatives.walk(table, page, centre, True, 6).to_pylist()
    assert len(chunks) < 10  # of 69
    got = defaultdict(list)
    for r in found:
        got[int(r["node"])].append((r["score"], r["vec_id"]))
    scores = anchors @ x.T
    for i in range(20):
        want = sorted(range(len(x)), key=lambda j: (-scores[i, j], j))[:6]
        assert sorted(got[i], key=lambda r: (-r[0], r[1])) == [(scores[i, j], j) for j in want]
