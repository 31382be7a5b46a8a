"""Sinks. All go through Spark's writers and their commit protocol."""

from __future__ import annotations

import time
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.history import to_wide, upsert
from .paths import children, claim, exists, move, remove, text_of


#: How long a claimed version may lack its place.
PATIENCE = 60.0


class ShardWriter(Protocol):
    """What writes soft-label shards: a folder for each shard_index, and the suffix of its files."""

    suffix: str

    def write_records(self, df: DataFrame, path: str) -> None: ...


class FileShards:
    """A writer of one of Spark's file formats; only the shards that df holds are overwritten."""

    def __init__(self, kind: str = "parquet"):
        self.kind, self.suffix = kind, f".{kind}"

    def write_records(self, df: DataFrame, path: str) -> None:
        df.repartition("shard_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_index").format(self.kind).save(path)


def shards(df: DataFrame, path: str, size: int, index: str = "example_index", writer: ShardWriter | None = None) -> None:
    """Rows by shard_index, through a writer (Parquet if none is given)."""
    (writer or FileShards()).write_records(df.withColumn("shard_index", F.floor(F.col(index) / size).cast("long")), path)


def manifest(df: DataFrame, path: str, header: dict | None = None, index: str = "example_index") -> None:
    """What the shards of df hold, derived from them, as one row: the header's fields (source, its
    digest, teacher, sizes, template fingerprint), total_examples, total_shards and the shards."""
    rows = df.groupBy("shard_index").agg(F.min(index).alias("example_start"), (F.max(index) + 1).alias("example_end"), F.count(F.lit(1)).alias("row_count"))
    entry = F.struct("shard_index", F.format_string("shards/shard_index=%d", "shard_index").alias("path"), "example_start", "example_end", "row_count")
    one = rows.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_examples"), F.count(F.lit(1)).alias("total_shards"), F.array_sort(F.collect_list(entry)).alias("shards"))
    fixed = {"created_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")} | {k: F.lit(v) for k, v in (header or {}).items()}
    one.select(*(c.alias(k) for k, c in fixed.items()), *(c for c in one.columns if c not in fixed)).coalesce(1).write.mode("overwrite").json(path)


def kd_table(df: DataFrame, path: str, meta: dict) -> None:
    """The training table, and a table of one row that tells how it was made."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def step_summary(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").partitionBy("step").json(path)


def samples(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("step").json(path)


def history(new: DataFrame, path: str) -> int:
    """Upsert the steps of new (step, metric, value) into the history under path; gives the version written.

    Every write makes a new version: the long table, and its wide form as CSV with sorted columns.
    What is read is never written over, a version without its mark of success doesn't count, and all
    but the last two are removed. Several may write at once: a version is made aside, from the last
    one, and claimed by its number; who comes second makes it anew from the version that won. A claim
    names what was made, so that the next call puts it in place if its writer broke off. Only where a
    folder without the mark of success is in the way its claimant alone may remove it: if that one broke
    off too, this fails after PATIENCE seconds and names it.
    """
    spark, since, last = new.sparkSession, time.monotonic(), None
    while True:
        _settle(spark, path)
        have = versions(spark, path)
        now, made = have[-1] + 1 if have else 0, f"{path}/made-{uuid.uuid4().hex}"
        if now != last:
            since, last = time.monotonic(), now
        if exists(spark, f"{path}/claims/{now}"):
            if time.monotonic() - since > PATIENCE:
                raise RuntimeError(f"{path}/v={now} is claimed and not complete")
            time.sleep(0.2)
            continue
        try:
            old = spark.read.parquet(f"{path}/v={have[-1]}/long") if have else new.limit(0)
            upsert(old, new).write.parquet(f"{made}/long")
            wide = to_wide(spark.read.parquet(f"{made}/long"))
            wide.select("step", *sorted(c for c in (f"`{x}`" for x in wide.columns if x != "step"))).coalesce(1).write.option("header", True).csv(f"{made}/wide")
        except Exception:
            remove(spark, made)
            if versions(spark, path)[-1:] == have[-1:]:
                raise
            continue  # others have gone on, and removed what was read
        if claim(spark, f"{path}/claims/{now}", made):
            break
        remove(spark, made)
    if exists(spark, f"{path}/v={now}") and now not in versions(spark, path):
        remove(spark, f"{path}/v={now}")
    _settle(spark, path)
    for v in [v for v in versions(spark, path) if v <= now][:-2]:
        remove(spark, f"{path}/v={v}")
    return now


def _settle(spark: SparkSession, path: str) -> None:
    """Put what was claimed after the last complete version in its place."""
    have = versions(spark, path)
    for n in sorted(int(c) for c in children(spark, f"{path}/claims") if c.isdigit()):
        made = text_of(spark, f"{path}/claims/{n}") if n > (have[-1] if have else -1) else None
        if made:
            move(spark, made, f"{path}/v={n}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a history, ascending."""
    found = sorted(int(n[2:]) for n in children(spark, path) if n.startswith("v=") and n[2:].isdigit())
    return [v for v in found if exists(spark, f"{path}/v={v}/wide/_SUCCESS")]


def kept_rows(df: DataFrame, length: str, most: int, path: str) -> tuple[int, int]:
    """Write the rows no longer than most; how many were kept and dropped, as the job that writes counts them."""
    seen = Observation()
    told = df.observe(seen, F.count_if(F.col(length) <= most).alias("kept"), F.count_if(F.col(length) > most).alias("dropped"))
    told.filter(F.col(length) <= most).write.mode("overwrite").parquet(path)
    return seen.get["kept"], seen.get["dropped"]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def subsets(samples_by_size: dict[int, DataFrame], path: str, by: str) -> None:
    """A folder for each size, and a manifest of the strata's counts."""
    for size, df in samples_by_size.items():
        df.write.mode("overwrite").json(f"{path}/size={size}")
        df.groupBy(by).count().withColumn("size", F.lit(size)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/size={size}")


def report(df: DataFrame, path: str) -> None:
    """Benchmark rows; nullable metrics stay as nulls."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
