"""Seeded, stratified and nested samples. An md5 of seed and id orders rows the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def strata(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def allocate(weights: DataFrame, key: str, weight: str, total: Column, within: list[str] | None = None) -> DataFrame:
    """weights with take: total slots shared out in proportion, the largest remainders rounded up,
    ties by key; each group of within by itself. There is a row per stratum, so one window is small."""
    part = W.partitionBy(*(within or [F.lit(1)]))
    sum_ = F.sum(weight).over(part)
    out = weights.withColumn("_raw", total * F.col(weight)).withColumn("_sum", sum_)
    out = out.withColumn("_floor", F.floor(F.col("_raw") / F.col("_sum"))).withColumn("_rest", F.col("_raw") % F.col("_sum"))
    left = total - F.sum("_floor").over(part)
    place = F.row_number().over(part.orderBy(F.desc("_rest"), key))
    return out.withColumn("take", (F.col("_floor") + (place <= left).cast("int")).cast("long")).drop("_raw", "_sum", "_floor", "_rest")


def stratified_sample(df: DataFrame, by: str, key: str, total: int, seed: int | str) -> DataFrame:
    """total rows of df, strata of by in proportion, in each a prefix of the seeded order. Larger
    totals take longer prefixes. The bound by total lets every task drop all but its own first rows
    of a stratum before the shuffle."""
    takes = allocate(strata(df, [by]), by, "n", F.lit(total)).select(by, "take")
    placed = df.join(F.broadcast(takes), by) if takes.limit(100_001).count() <= 100_000 else df.join(takes, by)
    place = F.row_number().over(W.partitionBy(by).orderBy(seeded(seed, key), key))
    return placed.withColumn("_p", place).filter((F.col("_p") <= total) & (F.col("_p") <= F.col("take"))).drop("_p", "take")


def allocate_subsets(weights: DataFrame, sizes: list[int], corpus: str, category: str, split: str) -> DataFrame:
    """size, corpus, category, take: every size shared out over the corpora, and the share of the
    corpus split over its categories. weights holds a row per corpus and category with its count n;
    other corpora have one row, of category ''."""
    each = weights.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    by_corpus = allocate(each.groupBy("size", corpus).agg(F.sum("n").alias("n")), corpus, "n", F.col("size"), ["size"])
    inner = each.filter(F.col(corpus) == split).join(by_corpus.filter(F.col(corpus) == split).select("size", F.col("take").alias("_share")), "size")
    inner = allocate(inner, category, "n", F.col("_share"), ["size"]).select("size", corpus, category, "take")
    return by_corpus.filter(F.col(corpus) != split).select("size", corpus, F.lit("").alias(category), "take").union(inner)


def nested_subsets(df: DataFrame, key: str, corpus: str, category: str, split: str, sizes: list[int], seed: int | str) -> DataFrame:
    """key, corpus, category and size for every row of every subset: the strata are the corpora, and
    the categories of the corpus split (others' are taken as ''); in each a prefix of the seeded
    order. A stratum that has fewer rows than its share gives them all. Nulls count as ''."""
    rows = df.select(key, F.coalesce(F.col(corpus), F.lit("")).alias(corpus), F.when(F.col(corpus) == split, F.coalesce(F.col(category), F.lit(""))).otherwise("").alias(category))
    takes = allocate_subsets(strata(rows, [corpus, category]), sizes, corpus, category, split)
    place = F.row_number().over(W.partitionBy(corpus, category).orderBy(seeded(seed, key), key))
    first = rows.withColumn("_p", place).filter(F.col("_p") <= max(sizes))
    return first.join(takes, [corpus, category]).filter(F.col("_p") <= F.col("take")).drop("_p", "take")


def not_nested(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """Rows of small that large lacks: none if small is nested in large."""
    return small.join(large, key, "left_anti")


def split(df: DataFrame, key: str, n_eval: int, seed: int | str) -> DataFrame:
    """df with fold: eval for the last n_eval rows of the seeded order, train for others. The eval
    rows are found by a bounded top-k, not by a sort of all rows in one task."""
    if n_eval <= 0:
        return df.withColumn("fold", F.lit("train"))
    if df.limit(n_eval + 1).count() <= n_eval:
        raise ValueError("n_eval must be smaller than the number of rows")
    last = df.select(key, seeded(seed, key).alias("_h")).orderBy(F.desc("_h"), F.desc(key)).limit(n_eval).select(F.col(key).alias("_k"))
    return df.join(last, F.col(key) == F.col("_k"), "left").withColumn("fold", F.when(F.col("_k").isNotNull(), "eval").otherwise("train")).drop("_k")


def head(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.orderBy(index).limit(n)
