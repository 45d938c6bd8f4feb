"""Benchmark windows in documents against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from tidemark.llm import decontaminate as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, width=10):
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        ws = cut(t)
        for k in range(max(len(ws) - width, 0) + 1) if ws else ():
            windows.setdefault(tuple(ws[k : k + width]), set()).add(str(i))
    out = []
    for doc, t in docs:
        ws, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(ws) - n + 1):
                if (x := tuple(ws[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest, bool(hit)))
    return out


def tables():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefgé1") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    items = [(i, text(rnd.randint(1, 30))) for i in range(20)] + [(20, "only-Two"), (21, None), (22, " ,.")]
    items += [(23, items[3][1]), (3, items[3][1])]
    docs = [(0, None), (1, ""), (2, ". ,"), (3, "x Only TWO y"), (4, "only")]
    for i in range(5, 80):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            item = (rnd.choice(items)[1] or "").upper().replace(" ", ",\n")
            parts += [item[rnd.randint(0, 9) :], text(rnd.randint(0, 9))]
        docs.append((i, " ".join(parts)))
    docs += [docs[9], (None, docs[10][1]), (None, "nothing here"), (99, " ".join(x[1] or "" for x in docs) * 20)]
    return docs, items


def test_summary(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS key").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS length")
    got = [tuple(r) for r in d.summary(frame, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))
    kept = d.clean(frame, bench)
    assert kept.columns == frame.columns
    clean = [row for row, found in zip(docs, brute(docs, items), strict=True) if not found[5]]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, clean))


def test_only_short_items_or_none(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for some in ([x for x in items if len(cut(x[1])) < 5], []):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = [tuple(r) for r in d.summary(frame, bench).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, some)))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(tables()[1], "item_id long, text string")
    assert d.summary(docs, bench).count() == 0
