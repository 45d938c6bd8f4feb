"""The manifest against a tree built level by level in plain Python."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tidemark.llm import merkle


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in tree[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def leaf(d, source, lang, n, text) -> str:
    shown = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text))
    return h(*shown)


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            d, source, lang, n, text = r
            path = siblings(trees[s], i) + siblings(top, k)
            node = leaf(*r)
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
                node = leaf(d, source, lang, n, text.replace("\n", ""))
            for a, b in path:
                node = h(*a, node, *b)
            proof = h(*[x for a, b in path for x in (*a, *b)])
            root = top[-1][0]
            out.append((d, leaf(*r), trees[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def test_positions_and_logs():
    for n in [*range(1, 40), 80, 81, 82, 243, 500]:
        top = merkle.height(n)
        names = [str(i) for i in range(n)]
        log = merkle.append_log(names, top)
        tree = levels(names)
        assert len(tree) == top + 1 and len(log) == sum(map(len, tree)) and log[-1] == tree[-1][0]
        at = [merkle.position(level, i, n, top) for level, row in enumerate(tree) for i in range(len(row))]
        assert sorted(at) == list(range(len(log)))
        for level, row in enumerate(tree):
            for i, node in enumerate(row):
                assert log[merkle.position(level, i, n, top)] == node
        for i in range(0, n, 7):
            assert merkle.path(log, i, n, top) == siblings(tree, i)
            assert merkle.fold(names[i], siblings(tree, i)) == log[-1]


@pytest.fixture
def small_builders(monkeypatch):
    """Builders of nine leaves, so that trees need several tiers. Tasks get the value with the functions."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "FAN", 9)


def corpus(n: int, seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        source = rnd.choice(["hot"] * 8 + [None, "", "a", "é", "Z", "-", "zz"] + [f"s{rnd.randint(0, 40)}"])
        text = rnd.choice([None, "", "a\nb", "x", "\n\n", "é" * rnd.randint(1, 5), "line\n" * rnd.randint(0, 3)])
        rows.append((d * 3 - 50, source, rnd.choice(["en", None, ""]), rnd.choice([None, 0, 7]), text))
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1], None, 1, "other text of one id"), (None, "a", "en", 1, "t"), (None, None, None, None, None)]
    rows.append((10**9, "hot", "en", 3_000_000, "very long\n" * 300_000))
    rnd.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [0, 40, 1500])
def test_manifest(spark, n):
    rows = corpus(n) if n else [(4, "only", None, 1, "t\n")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", tree string, index int").repartition(6)
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert got == brute(rows)


def test_more_tiers(spark, small_builders):
    rows = corpus(900, 2)
    got = sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
