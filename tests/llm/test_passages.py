"""Repeated passages of words against plain Python, and in the pipeline's stage."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_repeats import WORD, brute_bytes, corpus

import corpus_pipeline
from tidemark.llm import passages, suffix
from tidemark.llm.pieces import covered


def brute_windows(rows, width):
    """For each text its words as matches, and the windows that several documents hold."""
    held: dict[tuple, set] = {}
    cut = {d: list(WORD.finditer((t or "").encode())) for d, t in rows}
    windows = {d: [tuple(m[0] for m in ws[i : i + width]) for i in range(len(ws) - width + 1)] for d, ws in cut.items()}
    for d, ks in windows.items():
        for k in ks:
            held.setdefault(k, set()).add(d)
    return {d: (ws, [i for i, k in enumerate(windows[d]) if len(held[k]) > 1]) for d, ws in cut.items()}


def brute_passages(rows, width):
    """Which words of each text lie in such a window."""
    out = {}
    for d, (ws, at) in brute_windows(rows, width).items():
        out[d] = np.zeros(len(ws), bool)
        for i in at:
            out[d][i : i + width] = True
    return out


@pytest.mark.parametrize("shard_bytes", [3 << 20, 1500])
@pytest.mark.parametrize("width", [13, 51])
def test_words_of_repeated_passages(spark, shard_bytes, width):
    rows = list(enumerate(corpus(7)))
    want = brute_passages(rows, width)
    assert any(x.any() for x in want.values())
    docs = spark.createDataFrame([*rows, (None, rows[8][1])], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.spans for r in passages.find(docs, width, shard_bytes=shard_bytes).collect()}
    for d, gone in want.items():
        assert np.array_equal(covered(len(gone), np.array(found.get(d, []), int)), gone), d


def test_shards_of_one_anchor():
    rnd = random.Random(1)
    bodies = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))).encode() for _ in range(30)]
    ids = np.array([rnd.randint(0, 9) for _ in bodies])
    for width in (3, 5, 51):
        half = passages.shared(bodies[:15], ids[:15], bodies[15:], ids[15:], width)
        whole = passages.shared(bodies, ids, None, None, width)
        held: dict[tuple, set] = {}
        for body, d in zip(bodies, ids, strict=True):
            ws = body.split()
            for i in range(len(ws) - width + 1):
                held.setdefault(tuple(ws[i : i + width]), set()).add(int(d))
        for body, a, b in zip(bodies, half, whole, strict=True):
            ws = body.split()
            want = [len(held[tuple(ws[i : i + width])]) > 1 for i in range(len(ws) - width + 1)]
            for found in (a, b):
                assert [any(x <= i < y for x, y in zip(found[0::2], found[1::2], strict=True)) for i in range(len(want))] == want


def test_what_one_document_repeats_stays(spark):
    """Pieces of one document, equal or not, and rows that are there twice, are no several documents."""
    rows = [(1, "a b " * 200), (2, "c d e " * 300), (2, "c d e " * 300), (3, "x " * 60), (4, "y " + "x " * 55)]
    found = {r.doc_id: r.spans for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {3, 4}
    assert covered(60, np.array(found[3])).all() and covered(56, np.array(found[4])).tolist() == [False] + [True] * 55


def test_stage_removes_short_passages(spark, data):
    """A passage of 52 words has fewer than 400 bytes; white space may differ between its copies."""
    rnd = random.Random(8)
    text = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(k))
    passage = text(52)
    assert len(passage) < 400
    rows = [(1, text(60) + "\n" + passage + " " + text(40)), (2, text(30) + " " + passage.replace(" ", "\n") + " é " + text(9))]
    rows += [(3, text(80)), (4, " ".join(passage.split()[:50]) + " " + text(50)), (5, passage)]
    long = "x" * 500  # a string of 400 bytes in one word still goes
    rows += [(6, text(5) + " " + long), (7, text(5) + " " + long), (8, ""), (9, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["repeated strings"]
    left = {r.doc_id: r for r in stage(spark, docs, data).collect()}
    windows, strings = brute_windows(rows, 51), brute_bytes(rows, 400)
    for d, t in rows:
        ws, at = windows[d]
        for i in at:
            strings[d][ws[i].start() : ws[i + 50].end()] = True
        want = bytes(b for b, g in zip((t or "").encode(), strings[d], strict=True) if not g).decode()
        assert ((left[d].text or "") if d in left else "") == want, d
    assert passage not in left[1].text and left[1].n_chars == len(left[1].text)
    assert 5 not in left and left[3].text == rows[2][1] and left[4].text == rows[3][1] and long not in left[6].text
    assert left[8].text == "" and left[9].text is None


def test_only_strings_without_a_width(spark):
    rows = [(1, "a b " * 30), (2, "a b " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in suffix.remove(docs).collect()) == rows
