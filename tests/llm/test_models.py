"""Language and quality on held-out documents, and their odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import language, quality

ODD = [(10_000, None, None, None, 0), (10_001, "", "en", "x", 0), (10_002, " 12 ,.\n", "en", "x", 5), (None, "the of", "en", None, 1)]


@pytest.fixture(scope="module")
def documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = spark.createDataFrame(ODD, docs.schema)
    return docs.unionByName(odd).selectExpr("*", "'x' AS label", "1 AS score", "2 AS key")


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark, documents):
    got = {r.doc_id: r for r in language.identify(documents).collect()}
    known = [r for r in documents.collect() if r.doc_id is not None]
    assert len(got) == len(known) + 1
    held = [r for r in known if got[r.doc_id].held_out and r.lang and r.doc_id < 10_000]
    assert 0.2 < len(held) / len(known) < 0.5
    right = [r.lang == got[r.doc_id].lang_pred for r in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (10_000, 10_001, 10_002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].held_out
    # Calibration: the mean score is close to the share of right answers.
    assert abs(np.mean(right) - np.mean([got[r.doc_id].score for r in held])) < 0.03
    kept = {r.doc_id for r in language.keep_known(documents).collect()}
    assert not kept & {10_000, 10_001, 10_002} and len(kept) > 0.97 * len(known)


def test_language_with_nothing_or_one_thing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(i, f"word{i}", None) for i in range(9)], schema)
    assert {(r.lang_pred, r.score) for r in language.identify(none).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, f"word {i}", "xx") for i in range(9)], schema)
    assert {(r.lang_pred, r.score) for r in language.identify(one).collect()} == {("xx", 1.0)}
    assert language.identify(one.limit(0)).count() == 0


def test_regularised_weights_are_sparse():
    rnd = np.random.default_rng(0)
    rows = [(np.append(rnd.choice(500, 30, replace=False), 600 + k % 2), np.append(rnd.random(30), 3.0)) for k in range(200)]
    found = language.ftrl(rows, np.arange(200) % 2, 2, l1=0.5)
    assert (found != 0).mean() < 0.02 and found[0, 600] > 0 > found[1, 600]


def test_quality_of_held_out_documents(spark, documents, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (10_001, None, 0), (77_777, 1, 0)], labels.schema))
    got = {r.doc_id: r for r in quality.classify(documents, labels).collect()}
    assert len(got) == documents.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    held = [x for x in held if x[0].doc_id is not None]
    good = np.array([g.score for g, q in held if q == 1])
    bad = np.array([g.score for g, q in held if q == 0])
    assert len(bad) > 3 and (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([g.predicted == q for g, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(documents.limit(20), labels).collect()} == {0.5}
    assert quality.classify(documents.limit(0), labels).count() == 0


def test_sum_of_squares_equals_all_pairs():
    rnd = np.random.default_rng(2)
    machine = quality.Machine(0.3, rnd.normal(size=50), rnd.normal(size=(50, 4)))
    rows, columns, values = np.repeat([0, 1], [6, 3]), rnd.choice(50, 9, replace=False), rnd.random(9)
    raw, _ = machine.parts(rows, columns, values, 2)
    for r in (0, 1):
        at = np.flatnonzero(rows == r)
        want = 0.3 + sum(machine.weights[columns[i]] * values[i] for i in at)
        for x, i in enumerate(at):
            for j in at[x + 1 :]:
                want += machine.factors[columns[i]] @ machine.factors[columns[j]] * values[i] * values[j]
        assert abs(raw[r] - want) < 1e-9
