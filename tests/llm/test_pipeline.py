"""Each stage of the pipeline on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from test_decontaminate import brute as contaminated
from test_minhash import brute as grouped
from test_repeats import brute_bytes
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidemark.llm import language
from tidemark.llm.store import settled


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "12 34", "en", "s", 5), (5002, "", "en", "s", 0)], docs.schema)
    docs = settled(docs.unionByName(odd), "documents")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        rows = [(d, r.text) for d, r in before.items()]
        found = language.identify(docs).collect() if name == "language" else []
        docs = settled(stage(spark, docs, data), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert after and len(after) == docs.count()
        if name != "encoding":
            assert docs.columns == columns
        if name == "language":
            assert set(after) == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5}
            assert not {5000, 5001, 5002} & set(after)
        elif name == "near-duplicates":
            assert set(after) == {d for d, x in grouped(rows).items() if x[2]}
        elif name == "repeated strings":
            for d, gone in brute_bytes(rows, 400).items():
                left = bytes(b for b, g in zip(before[d].text.encode(), gone, strict=True) if not g).decode("utf-8", "ignore")
                assert (after[d].text if d in after else "") == left
                if d in after:
                    assert after[d].n_chars == (len(left) if gone.any() else before[d].n_chars)
        elif name == "decontamination":
            assert set(after) == {x[0] for x in contaminated(rows, items) if not x[5]}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert set(after) == set(before)
            for d, r in after.items():
                assert list(r.ids) == library.encode(before[d].text, add_special_tokens=False).ids


def test_run_and_registration(spark, data):
    got = __spark_entry__.queries()["pipeline"](spark, data)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns) and got.count() > 50


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
