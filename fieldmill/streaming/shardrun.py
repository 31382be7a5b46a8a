"""A run over shards that goes on where it stopped: a shard a batch, and its manifest entry after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.softlabel import shard_of
from ..sources.paths import children, exists
from ..sources.writers import FileShards, ShardWriter

ENTRY = "shard_index long, example_start long, example_end long, row_count long"


def stage(df: DataFrame, path: str, size: int, index: str = "example_index") -> None:
    """Examples as the source of a run: a file a shard."""
    df.withColumn("shard_index", shard_of(F.col(index), size)).repartition("shard_index").write.partitionBy("shard_index").parquet(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest entries of a run so far, one a shard: what the last batch that made it has told."""
    done = [f"{path}/entries/{b}" for b in children(spark, f"{path}/entries") if exists(spark, f"{path}/entries/{b}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], ENTRY)
    told = spark.read.schema(ENTRY).option("basePath", f"{path}/entries").json(done)
    return told.groupBy("shard_index").agg(F.max_by(F.struct("example_start", "example_end", "row_count"), "batch").alias("e")).select("shard_index", "e.*")


def manifest(spark: SparkSession, path: str, header: dict | None = None) -> DataFrame:
    """The manifest of a run so far, as writers.manifest has it."""
    entry = F.struct("shard_index", F.format_string("shards/shard_index=%d", "shard_index").alias("path"), "example_start", "example_end", "row_count")
    one = entries(spark, path).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_examples"), F.count(F.lit(1)).alias("total_shards"), F.array_sort(F.collect_list(entry)).alias("shards"))
    return one.select(*(F.lit(v).alias(k) for k, v in (header or {}).items()), "*")


#: Spark's setting for how many tasks list folders; it takes one a folder, and a stream lists its source for every batch.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def make_shards(spark: SparkSession, source: str, schema: str, path: str, make: Callable[[DataFrame], DataFrame], index: str = "example_index", files: int = 1, writer: ShardWriter | None = None) -> None:
    """Make the shards of the staged examples in source (columns of schema) that this run hasn't made.

    make turns a batch of examples, with shard_index, into the rows of its shards. A batch writes its
    shards under path/shards and then their entry of the manifest; the stream's checkpoint beside them
    remembers the batch as done. A run that broke off, wherever, goes on with the batch that isn't:
    its shards and its entry are written again in place. Files that are added to source are new batches.
    A batch takes so many files at most; each costs a few jobs and a listing of source, so give more of
    them where shards are many.
    """
    stream = spark.readStream.schema(f"{schema}, shard_index long").option("maxFilesPerTrigger", files).parquet(source)
    out = writer or FileShards()

    def each(batch: DataFrame, number: int) -> None:
        out.write_records(make(batch), f"{path}/shards")
        shard_plan_of(batch, index).coalesce(1).write.mode("overwrite").json(f"{path}/entries/batch={number}")

    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(spark.sparkContext.defaultParallelism))
    try:
        run = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/mark").trigger(availableNow=True).start()
    finally:
        spark.conf.set(LISTING, before)
    run.awaitTermination()


def shard_plan_of(batch: DataFrame, index: str) -> DataFrame:
    """The entries of a batch's shards."""
    return batch.groupBy("shard_index").agg(F.min(index).alias("example_start"), (F.max(index) + 1).alias("example_end"), F.count(F.lit(1)).alias("row_count"))
