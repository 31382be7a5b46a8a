"""Distillation examples from a cached teacher, with a tokenizer that the caller brings."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from .kd import labels, truncate
from .scoring import once

IDS = T.ArrayType(T.IntegerType())


@lru_cache(maxsize=8)
def _tokenizer(factory: Callable):
    """The tokenizer that a worker keeps; a factory is told by what it is, a class or function."""
    return factory()


def encoder(factory: Callable):
    """An Arrow UDF text -> ids. factory() makes a tokenizer with encode(text) and decode(ids), once a worker."""

    @F.pandas_udf(IDS)
    def encode(s: pd.Series) -> pd.Series:
        tok = _tokenizer(factory)
        return s.map(lambda t: None if t is None else [int(i) for i in tok.encode(t)])

    return encode


def single_id(factory: Callable):
    """An Arrow UDF text -> its id where it is one token, else null."""

    @F.pandas_udf(T.IntegerType())
    def one(s: pd.Series) -> pd.Series:
        tok = _tokenizer(factory)
        found = [tok.encode(t) if t is not None else [] for t in s]
        return pd.Series([int(f[0]) if len(f) == 1 else None for f in found], dtype="Int64")

    return one


def decoder(factory: Callable):
    """An Arrow UDF id -> its text, null as empty."""

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        tok = _tokenizer(factory)
        return s.map(lambda i: "" if pd.isna(i) else tok.decode([int(i)]))

    return decode


def _looked_up(df: DataFrame, column: str, known: DataFrame, rest: Callable[[], Column], out: str) -> DataFrame:
    """df with out, known's value for column; the distinct values that known lacks go through rest. Where
    it lacks none, the plan has no Python in it."""
    distinct = df.select(F.col(column).alias("_c")).filter("_c IS NOT NULL").distinct()
    lacking = distinct.join(known, "_c", "left_anti")
    told = distinct.join(known, "_c")
    if not lacking.isEmpty():
        told = told.unionByName(lacking.withColumn("_v", rest()))
    return df.join(told, F.col(column) == F.col("_c"), "left").select(*df.columns, F.col("_v").alias(out))


def ids_by_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, factory: Callable, out: str = "token_id") -> DataFrame:
    """df with the id of column where it is one token: from vocabulary (id, token; a token once), and
    from the tokenizer that factory makes for the distinct texts that it lacks. As single_id has it."""
    known = vocabulary.select(F.col("token").alias("_c"), F.col("id").cast("int").alias("_v"))
    return _looked_up(df, column, known, lambda: single_id(factory)("_c"), out)


def texts_by_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, factory: Callable, out: str = "token") -> DataFrame:
    """df with the text of the id in column, as decoder has it: from vocabulary, and from the tokenizer
    for the distinct ids that it lacks; null as empty."""
    known = vocabulary.select(F.col("id").cast("int").alias("_c"), F.col("token").alias("_v"))
    return _looked_up(df, column, known, lambda: decoder(factory)("_c"), out).withColumn(out, F.coalesce(out, F.lit("")))


def hard_examples(df: DataFrame, key: str, length: int, prompt: str = "prompt_ids", full: str = "hard_ids") -> DataFrame:
    """key, hard_input_ids, hard_attention_mask, hard_labels (nothing to learn in the prompt), cut to length."""
    ids = truncate(F.col(full), length)
    return df.select(key, ids.alias("hard_input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("hard_attention_mask"), labels(ids, F.least(F.size(prompt), F.lit(length))).alias("hard_labels"))


def distillation_examples(df: DataFrame, targets: DataFrame, key: str, k: int, length: int) -> DataFrame:
    """The hard example's columns, and soft_input_ids, soft_attention_mask, soft_target_ids,
    soft_target_probs (k wide, -1 and 0 where there is no candidate), soft_target_mask.

    df holds key, prompt_ids, hard_ids, soft_ids; targets holds key, step, token_id, prob: what the
    teacher gave at each step of its answer, merged (fieldmill.operators.kd.merged_candidates). The
    target of step s stands one before the token it tells; steps beyond the cut text are dropped.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("m"), "token_id")))
    steps = targets.groupBy(key, "step").agg(F.slice(order, 1, k).alias("c"))
    maps = steps.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("steps"))
    all_ = df.join(maps, key, "left")
    prompt = F.least(F.size("prompt_ids"), F.lit(length))
    soft = truncate(F.col("soft_ids"), length)
    places = F.when(F.size(soft) > 1, F.sequence(F.lit(0), F.size(soft) - 2)).otherwise(F.array().cast(IDS))

    def at(i: Column) -> Column:
        return F.when(i - prompt + 1 >= 0, F.element_at("steps", i - prompt + 1))

    def wide(values: Column, pad) -> Column:
        return F.slice(F.concat(F.coalesce(values, F.array().cast(IDS if pad == -1 else T.ArrayType(T.DoubleType()))), F.array_repeat(F.lit(pad), k)), 1, k)

    hard = once(all_, soft_input_ids=soft, hard_input_ids=truncate(F.col("hard_ids"), length), t=F.transform(places, at))
    ones = lambda c: F.transform(c, lambda _: F.lit(1))
    return hard.select(
        key, "hard_input_ids", ones("hard_input_ids").alias("hard_attention_mask"), labels(F.col("hard_input_ids"), prompt).alias("hard_labels"),
        "soft_input_ids", ones("soft_input_ids").alias("soft_attention_mask"), F.transform("t", lambda c: wide(F.transform(c, lambda x: x["token_id"]), -1)).alias("soft_target_ids"),
        F.transform("t", lambda c: let(F.aggregate(c, F.lit(0.0), lambda s, x: s - x["m"]), lambda total: wide(F.transform(c, lambda x: -x["m"] / total), 0.0))).alias("soft_target_probs"),
        F.transform("t", lambda c: c.isNotNull().cast("int")).alias("soft_target_mask"),
    )
