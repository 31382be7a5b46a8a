"""A step-keyed metric history: long inside, wide only where exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str = "step") -> DataFrame:
    """old without the steps of new, and new; columns of either."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value; null values are dropped."""
    return df.unpivot(keys, [F.col(f"`{m}`").cast("double").alias(m) for m in metrics], "metric", "value").filter("value is not null")


def to_wide(df: DataFrame, key: str = "step") -> DataFrame:
    """A column for every metric, in their order, sorted by key."""
    return df.groupBy(key).pivot("metric").agg(F.first("value")).orderBy(key)


def logged_steps(df: DataFrame, key: str = "step") -> DataFrame:
    """Distinct steps; what is no whole number is left out."""
    return df.select(F.col(key).try_cast("long").alias(key)).filter(f"{key} is not null").distinct()


def unlogged(df: DataFrame, history: DataFrame, key: str = "step") -> DataFrame:
    """Rows of steps that history lacks."""
    return df.join(logged_steps(history, key), key, "left_anti")


def with_pending_loss(metrics: DataFrame, losses: DataFrame, key: str = "step") -> DataFrame:
    return metrics.join(losses, key, "left")


def series(df: DataFrame, required: list[str], step: str = "step", position: str | None = None) -> DataFrame:
    """required columns as numbers, rows with one that isn't dropped, sorted by step, ties by position."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"history lacks columns {lacking}")
    out = df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) for c in required), *([position] if position else []))
    out = out.dropna(subset=required).filter(~F.isnan(F.col(step)))
    return out.orderBy(step, *([position] if position else []))


def missing_from_cache(samples: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return samples.join(cache.select(key).distinct(), key, "left_anti")


def with_cache(samples: DataFrame, cache: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Samples with the last cached row of their key, in the samples' order."""
    return samples.join(last_wins(cache, [key], order), key).orderBy(key)


def last_checkpoints(df: DataFrame, run: str, name: str) -> DataFrame:
    """run and last, the checkpoint- name of the greatest number, for runs that have one."""
    number = F.regexp_extract(name, r"^checkpoint-([0-9]+)$", 1).try_cast("decimal(38,0)")
    return df.select(run, F.col(name).alias("last"), number.alias("_n")).filter("_n is not null").groupBy(run).agg(F.max_by("last", "_n").alias("last"))
