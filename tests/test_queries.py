import pytest

import __spark_entry__ as entry
from feedloom.plans import catalog, oracle
from tests.oracle import SF, same

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "entry_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_needs_no_full_sort(spark):
    plan = catalog.QUERIES["bm25_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark):
    from feedloom.operators.entries import EntryQuery
    from feedloom.sources.corpus import corpus

    plan = EntryQuery(corpus(spark, SF)).without_content().id_after(10).ids_only()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,10)" in plan
    assert "text" not in plan.split("ReadSchema")[1].split(">")[0]
