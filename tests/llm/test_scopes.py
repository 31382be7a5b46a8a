"""Tables in the shared folder belong to the call that wrote them."""

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from fieldmill.llm import jaccard_join, registry
from fieldmill.llm.common import CLEANUP, cut, kept, scope, scratch
from fieldmill.sources.paths import children, exists, shared_dir


def there(spark):
    """Tables and checkpoints in the shared folder; Spark makes a folder of checkpoints a session."""
    top = shared_dir(spark)
    return {f"{top}/{n}" for n in children(spark, top)} | {f"{top}/{n}/{m}" for n in children(spark, top) for m in children(spark, f"{top}/{n}") if m.startswith("rdd-")}


def test_scopes_nest_and_leave_others_alone(spark):
    outside, path = kept(spark.range(3), "outside")
    with scope(spark) as own:
        first, _ = kept(spark.range(4), "first")
        with scope(spark) as inner:
            second, two = kept(first, "second")
            third, fourth = cut(second.selectExpr("id + 1 AS id")), cut(second)
            inner.keep(two, third)
            gone = fourth._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        assert not exists(spark, gone) and second.count() == 4 and third.agg({"id": "sum"}).first()[0] == 10
        with ThreadPoolExecutor(1) as pool:  # another thread's table isn't this scope's
            other = pool.submit(lambda: kept(spark.range(5), "other")).result()
        mine = scratch(spark, "never-written")
        assert mine in own.paths
    assert not exists(spark, two) and other[0].count() == 5 and outside.count() == 3


def test_two_joins_at_once_leave_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = there(spark)

    def run(k):
        with scope(spark):
            return sorted(map(tuple, jaccard_join.link_components(docs, k=3, percent=90).collect()))

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(run, range(2))
    assert a == b and len(a) == docs.count()
    with scope(spark):
        for name in ("op11_spelling_variants", "op12_warc", "op13_importance_resampling", "op10_decontamination"):
            registry.QUERIES[name](spark, sf).collect()
    assert there(spark) == before


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    before, was = files(), spark.conf.get(CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    with scope(spark):
        one, two = kept(rows, "counts")[0], cut(rows)
        until = time.time() + 20
        while files() - before and time.time() < until:  # they are removed without waiting
            time.sleep(0.1)
        assert not files() - before and one.count() == two.count() == 10 and spark.conf.get(CLEANUP) == was


def test_rows_without_those_gone(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "none"), (7, "again")], "k long, t string")
    with scope(spark):
        gone, _ = kept(spark.range(0, 60, 7).toDF("k"), "gone")
        left = jaccard_join.without(docs, "k", gone)
        assert sorted(map(str, left.collect())) == sorted(map(str, docs.filter("k is null or k % 7 <> 0").collect())) and left.columns == ["k", "t"]
        rest = left.filter("k % 7 <> 0")
        plan = jaccard_join.without(docs, "k", gone)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Union") and plan.count("Join LeftAnti") == 1 and rest.count() == 42
