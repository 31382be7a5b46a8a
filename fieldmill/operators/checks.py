"""Checks that give the rows or names that break them, never a silent pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(template: Column) -> Column:
    """sha256 of a template's text."""
    return F.sha2(template, 256)


def differing(df: DataFrame, left: str, right: str, index: str, first: int | None = None) -> DataFrame:
    """Rows (of the first by index, if given) whose two columns differ, nulls being equal."""
    rows = df.orderBy(index).limit(first) if first is not None else df
    return rows.filter(~F.col(left).eqNullSafe(F.col(right)))


def unequal_fingerprints(df: DataFrame, column: str, expected: str) -> DataFrame:
    return df.filter(~F.col(column).eqNullSafe(F.lit(expected)))


def positive(**numbers: int) -> None:
    """Raises for numbers that aren't positive."""
    bad = [k for k, v in numbers.items() if v <= 0]
    if bad:
        raise ValueError(f"must be positive: {', '.join(sorted(bad))}")


def one_mode(overwrite: bool, resume: bool) -> None:
    """Raises if both are asked for, before anything is deleted."""
    if overwrite and resume:
        raise ValueError("overwrite and resume exclude each other")


def batch_faults(df: DataFrame, batch: str, k: int) -> DataFrame:
    """Batches with rows of another candidate width, without span, or with a span beyond the ids."""
    return df.groupBy(batch).agg(
        F.count_if(F.exists("topk_ids", lambda r: F.size(r) != k)).alias("bad_width"), F.count_if(F.col("assistant_len") <= 0).alias("empty_span"),
        F.count_if((F.col("assistant_start") < 1) | (F.col("assistant_start") + F.col("assistant_len") > F.size("input_ids"))).alias("bad_span"),
    ).filter("bad_width + empty_span + bad_span > 0")


def setting_faults(s: Column) -> Column:
    """What is wrong with the settings of a run (struct of top_k, shard_size, batch_size, alpha,
    temperature, overwrite, resume), as an array of names in order; null settings aren't wrong."""
    rules = {
        "alpha": (s["alpha"] < 0) | (s["alpha"] > 1), "batch_size": s["batch_size"] <= 0, "overwrite and resume": s["overwrite"] & s["resume"], "shard_size": s["shard_size"] <= 0,
        "temperature": s["temperature"] <= 0, "top_k": s["top_k"] <= 0,
    }
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
