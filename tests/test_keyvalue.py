"""Lookups by key read the folders of their keys alone."""

from __future__ import annotations

from tidemark.sources.keyvalue import KeyValue


def test_gets_and_lookups(spark, folder, capsys):
    rows = spark.range(5000).selectExpr("concat('k', id) AS k", "id AS v")
    values = KeyValue(f"{folder}/kv", "k", rows.schema, parts=16)
    values.write(rows)
    got = values.get(spark, ["k7", "k4999", "none", "k7"])
    assert {(r.k, r.v) for r in got.collect()} == {("k7", 7), ("k4999", 4999)}
    assert got.columns == ["k", "v"] and values.get(spark, []).count() == 0
    one = values.get(spark, ["k42"])
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "part#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0] and "Exchange" not in plan
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,), ("x",)], "k string")
    assert sorted(r.v for r in values.lookup(spark, wanted).collect()) == [1, 2]
