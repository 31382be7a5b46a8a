"""Fuzzy keys by a dictionary: each distinct pair of a key and a record's keys is matched once.

Records of one kind have the same keys, so the distinct pairs are few. They are found by aggregation,
which begins before the shuffle; a pair with an equal plain key is decided natively, one whose keys
are all too short, too long or made of other letters has no match, and only what is left is held
against each other by likeness. The dictionary is joined back on a hash of the pair and the pair itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import closest_key, plain_key_lists, plain_keys
from .scoring import once

CUTOFF = 0.8
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def may_match(a: Column, b: Column, cutoff: float = CUTOFF) -> Column:
    """Whether two plain keys can be as alike as cutoff, by their lengths and by how many letters they share."""
    both = F.length(a) + F.length(b)
    many = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    shared = F.aggregate(F.array(*map(F.lit, _LETTERS)), F.lit(0), lambda n, x: n + F.least(many(a, x), many(b, x)))
    return (2 * F.least(F.length(a), F.length(b)) >= cutoff * both) & (2 * shared >= cutoff * both)


def pairs_of(df: DataFrame, target: str, names: str) -> DataFrame:
    """The distinct pairs of a key (column target) and a record's keys in order (column names)."""
    return df.select(F.col(target).alias("target"), F.col(names).alias("names")).filter("target IS NOT NULL AND names IS NOT NULL").distinct()


def open_pairs(pairs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """pairs with their plain forms (want, plain), the name that has the same one (name), and whether
    likeness is to decide (open)."""
    told = once(pairs, want=plain_keys(F.col("target")), plain=plain_key_lists(F.col("names")))
    same = F.array_position("plain", F.col("want")).cast("int")
    near = F.exists("plain", lambda p: may_match(F.col("want"), p, cutoff))
    return told.select("target", "names", "want", "plain", F.when(same > 0, F.get("names", same - 1)).alias("name"), ((same == 0) & near).alias("open"))


def dictionary(pairs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """target, names and name: the key among names that matches target, null if none does."""
    told = open_pairs(pairs, cutoff)
    decided = told.filter("NOT open").select("target", "names", "name")
    return decided.unionByName(told.filter("open").select("target", "names", closest_key("target", "names").alias("name")))


def with_matched_keys(df: DataFrame, target: str, names: str, out: str = "pred_key") -> DataFrame:
    """df with the name among names that matches target, as similarity.choose_key finds it; null for
    null and for none. What is joined back is as small as the number of distinct pairs."""
    hashed = lambda t, n: F.xxhash64(F.col(t), F.col(n))
    told = dictionary(pairs_of(df, target, names)).select(hashed("target", "names").alias("_h"), F.col("target").alias("_t"), F.col("names").alias("_n"), F.col("name").alias(out))
    keyed = df.withColumn("_k", hashed(target, names))
    return keyed.join(told, (F.col("_k") == F.col("_h")) & (F.col(target) == F.col("_t")) & (F.col(names) == F.col("_n")), "left").select(*df.columns, out)
