"""Encoding, decoding and counting against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokens

ALPHABET = [*" \n\tabcdefAB 0129'.,!<>|éßñ漢字 　\x1c\x85́", "  ", "<|endoftext|>", "aaaa", "    ", "'s", "\n\n"]


def odd_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [*texts, "", " ", "a" * 30_000, "the quick brown fox " * 3000]


def test_words_of_a_vocabulary_encode_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path), max_pieces=500)
    texts = odd_texts(3000) + list(library.get_vocab())[::23]
    for at in range(0, len(texts), 700):
        got = encoder.encode(texts[at : at + 700])
        want = library.encode_batch(texts[at : at + 700], add_special_tokens=False)
        assert got == [struct.pack(f"<{len(w.ids)}I", *w.ids) for w in want]


@pytest.mark.parametrize("extra", [False, True])
def test_encode_and_decode_tables(spark, extra):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, *odd_texts(40), "same", "same"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ("n_tokens string" if extra else "lang string"))
    got = bpe.encode(docs, path, digests=True).collect()
    assert len(got) == len(texts)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and back[r.doc_id] == decoded
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, *odd_texts(400), "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_bytes")
    got = {r.doc_id: r for r in tokens.count_tokens(docs, path, limit=20).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 20)


def test_counts_of_a_sentencepiece_model():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(50)
    assert tokens.Counter(path).count(texts) == [len(model.encode(t)) for t in texts]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
