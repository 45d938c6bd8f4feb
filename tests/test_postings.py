"""The stored search index against the index built per search."""

from __future__ import annotations

import pytest
from test_events import click, clicks

from tidemark.operators import search
from tidemark.streaming import postings

FIRST = [
    click(0, 0, url="/product/42"),
    click(1, 1, url="/product/421"),
    click(2, 2, url=None, props='{"note":"Blue shoe","n":42}'),
    click(3, 3_000_000, kind="purchase", url="/x", name="big_sale"),
]
SECOND = [click(1, 9, url="/blue/thing"), click(4, 10, url="/product/7"), click(2, 2, url=None, props='{"note":"Red shoe"}')]
THIRD = [click(1, 11, url="/again")]
WHOLE = [FIRST[0], FIRST[3], SECOND[1], SECOND[2], THIRD[0]]
QUERIES = ["42", "SHOE purchase", "blue", "product", "again thing", "", "nothing", "page_view"]


@pytest.mark.parametrize("compacted", [False, True])
def test_stored_index(spark, folder, compacted):
    root = f"{folder}/index"
    for n, rows in enumerate((FIRST, SECOND, THIRD)):
        assert postings.index_batch(clicks(spark, rows), root, n)
    assert not postings.index_batch(clicks(spark, FIRST), root, 1)
    schema = clicks(spark, []).schema
    if compacted:
        assert postings.compact(spark, root, schema) == 2 and postings.compact(spark, root, schema) is None
        assert postings.index_batch(clicks(spark, [click(4, 10, url="/product/8")]), root, 3)
        assert postings.index_batch(clicks(spark, [SECOND[1]]), root, 4)
    index = search.search_index(clicks(spark, WHOLE))
    for q in QUERIES:
        want = [r.event_id for r in search.search_page(search.search(index, q), size=3).collect()]
        got = postings.page(spark, root, q, schema, size=3)
        assert got.columns == schema.names and [r.event_id for r in got.collect()] == want, q
        total = search.search_total(search.search(index, q)).head()[0]
        assert postings.total(spark, root, q).head()[0] == total == postings.hits(spark, root, q).count()
    docs = {r.event_id: r for r in postings.documents(spark, root, schema).collect()}
    assert docs["e00001"].url == "/again" and len(docs) == len(WHOLE)


def test_search_reads_only_its_words(spark, folder, capsys):
    root = f"{folder}/index"
    rows = [click(i, i, url=f"/word{i:05d}") for i in range(2000)]
    postings.index_batch(clicks(spark, rows), root, 0)
    found = postings.hits(spark, root, "word00007")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "word00007" in plan.split("PushedFilters", 1)[1]
    assert "properties" not in plan and [r.event_id for r in found.collect()] == ["e00007"]
