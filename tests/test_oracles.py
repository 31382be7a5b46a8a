import pytest
from compare import rows_of, rows_of_sql

from fieldmill import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(plans.QUERIES[name](spark, sf)) == rows_of_sql(plans.ORACLES[name], sf)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_fuzzy_match_against_the_standard_library(spark, sf):
    import difflib

    for r in plans.QUERIES["fuzzy_match"](spark, sf).collect():
        assert r.key is not None and 0 < r.ratio <= 1
    name = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey = 1").first().p_name
    typo = name[:3] + name[4:]
    assert plans.QUERIES["fuzzy_match"](spark, sf).filter("p_partkey = 1").first().ratio == round(difflib.SequenceMatcher(None, name, typo).ratio(), 6)
