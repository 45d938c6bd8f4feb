"""Exact copies against plain Python, and the index itself."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "\t\n", " a", "a", "a ", "a b", "a b", "a\n\nb", "a\x0bb", "é", "é", "x" * 300_000]
    for _ in range(300):
        old = rnd.choice(texts[4:]) if rnd.random() < 0.4 else " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        texts.append(old.replace(" ", rnd.choice([" ", "  ", "\r\n", "\t"])) if old else old)
    texts += ["the common one"] * 200
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    rnd.shuffle(rows)
    return [*rows, rows[3], (None, "the common one"), (None, "nobody's"), (None, "nobody's"), (7, "another text of seven")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[SPACES.sub(" ", t or "")].append(d)
    out = []
    for d, t in rows:
        t = SPACES.sub(" ", t or "")
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [exact.CAPACITY, 2])
@pytest.mark.parametrize("bits", [64, 3])
def test_copies(spark, capacity, bits):
    rows = corpus(1)
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, key string, bucket int, keep_id string")
    key = F.xxhash64 if bits == 64 else lambda body: F.xxhash64(F.pmod(F.length(body), F.lit(1 << bits)))  # texts of other bytes, same key
    got = exact.copies(docs.repartition(5), key=key, capacity=capacity).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_buckets_split_and_chains(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact.build(docs, capacity=2)
    assert index.depth > index.first_depth
    slots = [r.slot for r in index.directory.collect()]
    assert len(slots) == len(set(slots))
    full = index.directory.where("local_depth < 63 AND n_keys > 2")
    assert full.isEmpty()
    entries = index.entries.collect()
    keys = defaultdict(set)
    for e in entries:
        keys[e.bucket].add(e.key)
        assert e.chain == 0
    assert max(map(len, keys.values())) <= 2
    assert len(entries) == len({SPACES.sub(" ", t or "") for _, t in rows})
    low = {r.bucket: r.local_depth for r in index.directory.collect()}
    for e in entries:  # a bucket's number is the first of its slots
        shift = index.depth - low[e.bucket]
        assert ((e.key % (1 << 64)) >> (64 - index.depth)) >> shift << shift == e.bucket

    chained = exact.build(docs, key=lambda body: F.xxhash64(F.length(body)), capacity=2).entries.collect()
    chains = defaultdict(list)
    for e in sorted(chained, key=lambda e: e.chain):
        chains[e.key].append(e)
    assert max(map(len, chains.values())) > 3
    for chain in chains.values():
        assert [e.chain for e in chain] == list(range(len(chain)))
        ids = [e.keep_id for e in chain if e.keep_id is not None]
        assert ids == sorted(ids)


def test_keep_first(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(t, d, "z") for d, t in rows], "text string, doc_id long, _id string")
    left = exact.keep_first(docs).collect()
    assert exact.keep_first(docs).columns == docs.columns
    texts = [SPACES.sub(" ", r.text or "") for r in left]
    assert len(texts) == len(set(texts)) and set(texts) == {SPACES.sub(" ", t or "") for _, t in rows}
    keep = {x[4]: x[1] for x in brute(rows)}
    assert all(r.doc_id == keep[hashlib.sha256(t.encode()).hexdigest()] for r, t in zip(left, texts, strict=True))


def test_no_python_and_empty_tables(spark, data, capsys):
    assert exact.copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    exact.copies(spark.read.parquet(f"{data}/documents.parquet")).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
