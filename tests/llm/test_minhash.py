"""Near-duplicates against all pairs in plain Python."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import minhash
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for d, t in rows:
        ws = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[d] = {tuple(ws)} if len(ws) == 1 else {*zip(ws, ws[1:], strict=False)}
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def corpus(seed, families, size):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    rows = [(0, None), (1, " \n"), (2, "One"), (3, "one"), (4, "two"), (5, "a b"), (6, "A B"), (7, "a b c")]
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 20, 60, 200]))]
        family = [base]
        for _ in range(rnd.randint(0, size)):
            new = list(rnd.choice(family))
            for _ in range(rnd.randint(0, max(1, len(new) // 8))):
                k = rnd.randrange(len(new))
                new[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)]
            family.append(new)
        rows += [(0, " ".join(x)) for x in family]
    rnd.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "families", "size"), [(1, 40, 8), (2, 3, 90), (3, 150, 1)])
def test_components_equal_all_pairs(spark, seed, families, size):
    rows = corpus(seed, families, size)
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS bucket").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.cluster(docs).collect()}
    assert got == want


def test_rows_without_id_and_repeated_rows(spark):
    text = "a rose is a rose is a rose and nothing else"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted((repr(tuple(r)) for r in minhash.cluster(docs).collect()))
    n = len(sets_of([(1, text)])[1])
    want = [(None, n, None, True), (4, n, 4, True), (4, n, 4, True), (9, n, 4, False), (None, 0, None, True)]
    assert got == sorted(map(repr, want))
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == ["4", "4", "None", "None"]


def test_densified_bins_estimate_similarity():
    rnd = np.random.default_rng(1)
    for size in (5, 40, 400):
        rate = []
        for _ in range(60):
            union = rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            both = np.sort(union[: size * 8 // 10])
            x, y = minhash.signatures([both, np.sort(union)])
            rate.append((x == y).mean())
        assert abs(np.mean(rate) - 0.8) < 0.06


def test_components_of_chains(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + 2 * i, 102 + 2 * i) for i in range(20)] + [(60, 61), (61, 60), (7, 99)]
    rnd.shuffle(edges)
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {99: 0, 60: 60, 61: 60} | {100 + 2 * i: 100 for i in range(21)}
    assert got == want


def test_empty_tables(spark):
    assert minhash.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_members_linked_though_no_star_pair_is(spark):
    words = [f"w{i}" for i in range(40)]
    other = words[:28] + [f"x{i}" for i in range(12)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*other[:-1], "y"]))]
    sizes = {d: len(s) for d, s in sets_of(rows).items()}
    members = spark.createDataFrame([(d, sizes[d], [7]) for d, _ in rows], "doc_id long, n_shingles long, buckets array<long>")
    got = minhash.links(members, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(2, 2), (3, 2)}
