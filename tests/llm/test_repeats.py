"""Repeated windows of bytes and words against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import lempel, suffix, words
from tidemark.llm.pieces import covered, pieces_of, spans

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passages = [text(rnd.randint(20, 150)) for _ in range(6)]
    out: list[str | None] = [None, "", " \n", "one"]
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.2 and len(out) > 8:
            out.append(rnd.choice(out[4:]))
        elif kind < 0.4 and len(out) > 8:
            old = (rnd.choice(out[4:]) or "").split(" ")
            for _ in range(3):
                old[rnd.randrange(len(old))] = rnd.choice(vocabulary)
            out.append(" ".join(old))
        elif kind < 0.8:
            out.append(text(rnd.randint(0, 80)) + "\n" + rnd.choice(passages) + " " + text(rnd.randint(0, 80)))
        else:
            out.append((text(9) + "\n") * rnd.randint(1, 20) + text(rnd.randint(5, 100)))
    out += ["a" * 2000, "b" * 100 + "a" * 1500, "ab" * 900, passages[0] * 3]
    return out


def brute_bytes(rows, width):
    seen: dict[bytes, int] = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out[d] = gone
    return out


def brute_words(rows, width):
    least: dict[tuple, int] = {}
    cut = {d: WORD.findall((t or "").encode()) for d, t in rows}
    for d, ws in cut.items():
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, ws in cut.items():
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - width + 1):
            if least[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = True
        out[d] = (ws, gone)
    return out


@pytest.mark.parametrize("width", [8, 13, 40, 400])
def test_suffix_arrays_of_shards(width):
    rnd = random.Random(width)
    for _ in range(15):
        bodies = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 900))).encode() for _ in range(6)]
        bodies += [bodies[0][5:], bodies[1][:450], b"", b"a" * 700]
        want = brute_bytes([(i, b.decode()) for i, b in enumerate(bodies)], width)
        for i, r in enumerate(suffix.repeated(bodies, width=width)):
            starts = np.zeros(len(bodies[i]), bool)
            for a, b in zip(r[0::2], r[1::2], strict=True):
                starts[a:b] = True
            gone = np.convolve(starts, np.ones(width))[: len(starts)] > 0 if len(starts) else starts
            assert np.array_equal(gone, want[i])
        both = suffix.repeated(bodies[:5], bodies[5:], width)
        for i, r in enumerate(both):
            rest = bodies[5:] if i < 5 else bodies[:5]
            for s in range(len(bodies[i]) - width + 1):
                held = any(bodies[i][s : s + width] in x for x in rest)
                flagged = any(a <= s < b for a, b in zip(r[0::2], r[1::2], strict=True))
                # Of equal windows on the left side one is enough: its own shard finds the others.
                assert held or not flagged
                if i >= 5:
                    assert flagged == held


def test_suffix_array_is_sorted():
    rnd = random.Random(3)
    data = "".join(rnd.choice("abc") for _ in range(3000)).encode() + b"x" * 500
    order = suffix.suffix_array(np.frombuffer(data, np.uint8), 10_000)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    got = suffix.common_prefixes(np.frombuffer(data, np.uint8), order)
    for k in range(0, len(order) - 1, 7):
        a, b = data[order[k] :], data[order[k + 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[k] == n


@pytest.mark.parametrize("shard_bytes", [3 << 20, 1500])
def test_bytes_of_documents(spark, shard_bytes):
    rows = list(enumerate(corpus(1)))
    want = brute_bytes(rows, 400)
    docs = spark.createDataFrame([*rows, (None, rows[8][1])], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.spans for r in suffix.find(docs, shard_bytes=shard_bytes).collect()}
    for d, gone in want.items():
        assert np.array_equal(covered(len(gone), np.array(found.get(d, []), int)), gone), d


def test_summary_and_removal_of_bytes(spark):
    rows = list(enumerate(corpus(2)))
    want = brute_bytes(rows, 400)
    docs = spark.createDataFrame([("x", t, i, "_", 3) for i, t in rows], "_spans string, text string, doc_id long, _id string, n_chars long")
    for r in suffix.summary(docs).collect():
        gone = want[r.doc_id]
        body = np.frombuffer((rows[r.doc_id][1] or "").encode(), np.uint8)
        parts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        digest = hashlib.sha256(body[~gone].tobytes()).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), gone.sum(), parts, digest)
    left = {r.doc_id: r for r in suffix.remove(docs).collect()}
    for d, t in rows:
        gone = want[d]
        kept = np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any():
            assert left[d].text == t and left[d].n_chars == 3
        elif kept:
            assert left[d].text == kept and left[d].n_chars == len(kept)
        else:
            assert d not in left


@pytest.mark.parametrize("shard_bytes", [3 << 20, 300])
@pytest.mark.parametrize("seed", [3, 4])
def test_words_of_documents(spark, shard_bytes, seed):
    rows = list(enumerate(corpus(seed)))
    want = brute_words(rows, 13)
    docs = spark.createDataFrame([*rows, (None, rows[8][1]), rows[9]], "doc_id long, text string").repartition(3)
    got = [r for r in lempel.cut(docs, shard_bytes=shard_bytes).collect()]
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        ws, gone = want[r.doc_id]
        kept = b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept.encode()) == (len(ws), gone.sum(), kept), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_blocks_agree_with_plain_windows():
    rnd = random.Random(9)
    for width in (2, 5, 13):
        bodies = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))).encode() for _ in range(30)]
        ids = np.array([rnd.randint(0, 9) for _ in bodies])
        least: dict[tuple, int] = {}
        for b, d in zip(bodies, ids, strict=True):
            ws = b.split()
            for i in range(len(ws) - width + 1):
                k = tuple(ws[i : i + width])
                least[k] = min(least.get(k, d), d)
        halves = [lempel.earlier(bodies, ids, None, None, width)]
        one, two = (lempel.earlier(x, y, None, None, width) for x, y in ((bodies[:15], ids[:15]), (bodies[15:], ids[15:])))
        across = lempel.earlier(bodies[:15], ids[:15], bodies[15:], ids[15:], width)
        halves.append([a + b for a, b in zip(one + two, across, strict=True)])
        for found in halves:
            for b, d, r in zip(bodies, ids, found, strict=True):
                ws = b.split()
                for i in range(len(ws) - width + 1):
                    flagged = any(x <= i < y for x, y in zip(r[0::2], r[1::2], strict=True))
                    assert flagged == (least[tuple(ws[i : i + width])] < d)


def test_words_and_hashes():
    texts = [b"", b" a  bc\n" + b"x" * 700 + b" bc", b"\xc3\xa9 a", b"a" * 8 + b" " + b"a" * 9]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, first = words.spans(data, offsets, words.SPACE)
    cut = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert cut == [x for t in texts for x in t.split()] and first.tolist() == [0, 0, 4, 6, 8]
    h = words.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(cut)) and h[0] == h[5] and h[1] == h[3]


def test_words_block_by_block():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab  \n") for _ in range(rnd.randint(0, 60))).encode() for _ in range(40)]
    texts[7] = b"x" * 200
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, first = words.hashed(data, offsets, words.SPACE)
    for block in (1, 7, 50, 333):
        got, at = words.hashed(data, offsets, words.SPACE, block)
        assert np.array_equal(got, whole) and np.array_equal(at, first)


def test_pieces_do_not_depend_on_blocks():
    rnd = random.Random(6)
    rows = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 3000))) for _ in range(12)] + [b"a" * 5000, b""]
    data, first = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    method = suffix.method()
    want = [np.concatenate(x) for x in zip(*pieces_of(data, first, method), strict=True)]
    for block in (800, 1111, 4000):
        got = [np.concatenate(x) for x in zip(*pieces_of(data, first, method, block), strict=True)]
        assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))


def test_very_long_texts(spark):
    """Two texts of 64 MB, the second ending in the first's last 8 MB: memory does not follow their length."""
    rnd = np.random.default_rng(1)
    letters = rnd.integers(97, 123, 64 << 20, dtype=np.uint8)
    letters[rnd.integers(0, len(letters), len(letters) // 6)] = 32
    one = letters.tobytes().decode()
    other = rnd.permutation(letters[: 1 << 20]).tobytes().decode() + one[-(8 << 20) :]
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.summary(docs).collect()}
    assert got[1].n_removed == got[2].n_removed == 8 << 20 and got[1].n_spans == got[2].n_spans == 1
    cut = {r.doc_id: r for r in lempel.cut(docs, with_text=False).collect()}
    n = len(one[-(8 << 20) :].split())
    assert cut[1].n_removed == 0 and n - 1 <= cut[2].n_removed <= n


def test_anchors_over_block_borders():
    values = words.mix(np.arange(5000, dtype=np.uint64))
    at = words.anchors(values, 50)
    for j in range(0, 4951, 13):
        part = values[j : j + 50] >> np.uint64(24)
        assert values[at[j]] >> np.uint64(24) == part.min() and j <= at[j] < j + 50


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.summary(docs).count() == 0 and lempel.cut(docs).count() == 0
    assert spans(docs, suffix.method()).count() == 0
