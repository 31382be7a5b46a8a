"""Asking a teacher in micro-batches of a bounded size, each kept when it is answered.

A run that breaks off keeps the batches before: the next one reads from the answers which ids are
done and asks for the rest alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import missing_from_cache
from ..sources.paths import children, exists, remove


def answers(spark: SparkSession, cache: str, schema: str) -> DataFrame:
    """What was answered so far: schema, run and batch. Only batches count that were written to the end."""
    done = [f"{cache}/answers/{r}/{b}" for r in children(spark, f"{cache}/answers") for b in children(spark, f"{cache}/answers/{r}") if exists(spark, f"{cache}/answers/{r}/{b}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], f"{schema}, run string, batch int")
    return spark.read.schema(f"{schema}, run string, batch int").option("basePath", f"{cache}/answers").parquet(*done)


def ask_rest(samples: DataFrame, cache: str, key: str, backend: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 1000, files: int = 1) -> None:
    """Ask the backend for the samples that cache has no answer to, each key once.

    The rest is written to work files of at most rows samples, in order of the key, and a stream takes
    files of them a batch. A batch's answers are a folder of their own, which a batch that is done
    again replaces. backend takes an iterator of pandas frames and gives frames of schema; where it
    fails, this fails, and what batches before have given stays. Null keys can't be told apart and
    aren't asked for; of samples that repeat a key one is.
    """
    spark = samples.sparkSession
    run = uuid.uuid4().hex
    work = f"{cache}/work-{run}"
    rest = missing_from_cache(samples.filter(F.col(key).isNotNull()).dropDuplicates([key]), answers(spark, cache, schema), key)
    rest.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows).parquet(f"{work}/samples")
    stream = spark.readStream.schema(rest.schema).option("maxFilesPerTrigger", files).parquet(f"{work}/samples")

    def each(batch: DataFrame, number: int) -> None:
        batch.mapInPandas(backend, schema).write.mode("overwrite").parquet(f"{cache}/answers/run={run}/batch={number}")

    try:
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        remove(spark, work)
