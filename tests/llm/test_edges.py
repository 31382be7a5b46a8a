"""Every operator on odd documents and on an empty table."""

import pytest
from pyspark.sql import functions as F

from fieldmill.llm import decontaminate, fingerprint, html_extract, jaccard_join, langid, packing, substring_dedup, token_counts, token_store, url_filter
from fieldmill.llm.common import scratch


def store(df):
    spark = df.sparkSession
    folder = scratch(spark, "edge")
    return token_store.read_store(spark, folder, token_store.write_store(df, folder))


OPERATORS = {
    "token_counts": token_counts.token_counts,
    "language": lambda df: langid.identify(df, langid.train(df.withColumn("lang", F.when(F.col("doc_id") > 4, "en").when(F.col("doc_id") == 9, "ja")))),
    "packing": packing.pack,
    "substrings": substring_dedup.remove_repeats,
    "jaccard": lambda df: jaccard_join.link_components(df, 3, 90),
    "store": store,
    "fingerprints": fingerprint.fingerprint_neighbours,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(odd, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) >= odd.count()
    if name != "packing":
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_decontamination_of_odd_tables(spark, odd):
    items = spark.createDataFrame([(1, "the CAT sat, on the mat it was the best"), (2, None), (None, "the cat sat on the mat it"), (3, "too short")], "item_id long, text string")
    got = decontaminate.contaminated(odd, items).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_equal) for r in got) == [(7, 1, 0, 10), (8, 1, 0, 10)]
    assert decontaminate.decontaminate(odd, items).count() == odd.count() - 2
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "http://a.net", "<p>"), (2, "x", "")], "page_id long, url string, html string")
    assert [r.n_chars for r in html_extract.extract(pages).collect()] == [0] * 4 and html_extract.extract(pages.limit(0)).count() == 0
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.net", "", None, "allow")} and url_filter.judge(pages.limit(0)).count() == 0
