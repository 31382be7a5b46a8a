"""Losses from logits that are held in blocks, so that no row holds the vocabulary.

A table of logits has a row for every position and block: keys, first (the id of the block's first
entry) and values. A block gives its maximum and the sum of exponentials scaled by it, at both
temperatures; these merge into a position's log-sum-exp. The ids that a position asks for, its gold
id and the teacher's candidates, meet the block that holds them on keys and block number, and what
leaves a block's row is a few numbers. So what is grouped by position is as wide as the number of
blocks, and the logits themselves are moved once at most: not at all where the ids asked for are a
table that Spark broadcasts by its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .kd import softmax, scaled


def in_blocks(df: DataFrame, keys: list[str], logits: str = "logits", size: int = 4096) -> DataFrame:
    """keys, first and values of a table that has the logits of a position in one array."""
    cut = F.transform(F.sequence(F.lit(0), F.size(logits) - 1, F.lit(size)), lambda i: F.struct(i.cast("long").alias("first"), F.slice(logits, i + 1, F.lit(size)).alias("values")))
    return df.filter(F.size(logits) > 0).select(*keys, F.explode(cut).alias("b")).select(*keys, "b.first", "b.values")


def _top_and_sum(v: Column, temperature: float) -> Column:
    """struct(top, sum): the maximum at a temperature, and the sum of exponentials over that maximum's; null without entries."""
    powers = lambda top: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))
    return let(F.array_max(v), lambda top: F.when(top.isNotNull(), F.struct((top / temperature).alias("top"), powers(top).alias("sum"))))


def _merged(parts: Column) -> Column:
    """The log-sum-exp of blocks from their (top, sum)."""
    return let(F.array_max(F.transform(parts, lambda p: p["top"])), lambda top: top + F.ln(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["sum"] * F.exp(p["top"] - top))))


def gathered(blocks: DataFrame, wanted: DataFrame, keys: list[str], size: int, temperature: float = 1.0, vocabulary: int | None = None) -> DataFrame:
    """One row a position of blocks: keys, norm and norm_t (the log-sum-exp at temperature 1 and at
    temperature) and found, an array of struct(id, z): the logits of the ids in wanted (keys, id; ids
    that no block holds, and null ones, give nothing). first must be a multiple of size; entries from
    vocabulary on don't exist. A position without entries has null norms."""
    asked = wanted.filter("id >= 0").select(*keys, (F.floor(F.col("id") / size) * size).cast("long").alias("first"), "id")
    asked = asked.groupBy(*keys, "first").agg(F.collect_set("id").alias("ids"))
    values = F.transform("values", lambda x: x.cast("double"))
    if vocabulary is not None:
        values = F.slice(values, F.lit(1), F.greatest(F.lit(0), F.least(F.size("values"), F.lit(vocabulary) - F.col("first"))).cast("int"))
    one = F.explode(F.array(F.struct(values.alias("v"))))
    rows = blocks.join(asked, [*keys, "first"], "left").select(*keys, "first", "ids", one.alias("o")).select(*keys, "first", "ids", "o.v")
    hits = F.filter(F.transform("ids", lambda i: F.struct(i.alias("id"), F.get(F.col("v"), (i - F.col("first")).cast("int")).alias("z"))), lambda h: h["z"].isNotNull())
    small = rows.select(*keys, _top_and_sum(F.col("v"), 1.0).alias("n"), _top_and_sum(F.col("v"), temperature).alias("t"), hits.alias("h"))
    grouped = small.groupBy(*keys).agg(F.collect_list("n").alias("n"), F.collect_list("t").alias("t"), F.flatten(F.collect_list("h")).alias("found"))
    return grouped.select(*keys, _merged(F.col("n")).alias("norm"), _merged(F.col("t")).alias("norm_t"), "found")


def position_losses(blocks: DataFrame, targets: DataFrame, keys: list[str], size: int, temperature: float, vocabulary: int, valid: str | None = None) -> DataFrame:
    """targets (keys, gold, topk_ids, topk_logprobs and, named by valid, which candidates count) with ok
    (the gold id is within the vocabulary), hard, soft (without the squared temperature) and inside, as
    kd.losses has them for logits in one array. A position without logits has null losses."""
    small = F.lit(vocabulary)
    ids = F.transform("topk_ids", lambda i: F.coalesce(F.when(i < small, i), F.lit(0)))
    usable = F.transform("topk_ids", lambda i: F.coalesce(i < small, F.lit(False)))
    usable = usable if valid is None else F.zip_with(usable, F.col(valid), lambda a, b: F.coalesce(a & b, F.lit(False)))
    gold = F.when(F.col("gold") < small, F.col("gold"))
    told = targets.select("*", gold.alias("_gold"), ids.alias("_ids"), usable.alias("_use"))
    wanted = told.select(*keys, F.explode(F.array_distinct(F.concat(F.transform("_ids", lambda i: i.cast("long")), F.array(F.col("_gold").cast("long"))))).alias("id"))
    both = told.join(gathered(blocks, wanted, keys, size, temperature, vocabulary), keys, "left")
    z = lambda i: F.get(F.filter("found", lambda f: f["id"] == i), F.lit(0))["z"]
    weights = softmax(scaled(F.col("topk_logprobs"), temperature), F.col("_use"))
    gain = F.aggregate(F.zip_with(weights, F.col("_ids"), lambda w, i: F.when(w > 0, w * (z(i) / temperature - F.col("norm_t"))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    soft = F.when(F.col("norm_t").isNotNull(), -gain)
    return both.select(*targets.columns, F.col("_gold").isNotNull().alias("ok"), (F.col("norm") - z(F.col("_gold"))).alias("hard"), soft.alias("soft"), F.array_contains("_ids", F.col("gold")).alias("inside"))


def losses(blocks: DataFrame, targets: DataFrame, keys: list[str], by: list[str], size: int, alpha: float, temperature: float, vocabulary: int, valid: str | None = None) -> DataFrame:
    """What kd.losses gives, from logits in blocks: hard_loss, soft_loss (times temperature squared), loss, frac_hard_in_topk and tokens by group."""
    if not 0 <= alpha <= 1 or temperature <= 0:
        raise ValueError("alpha must be within 0 and 1, temperature positive")
    each = position_losses(blocks, targets, keys, size, temperature, vocabulary, valid)
    n = F.greatest(F.count_if("ok"), F.lit(1))
    out = each.groupBy(*by).agg((F.sum(F.when(F.col("ok"), F.col("hard")).otherwise(0.0)) / n).alias("hard_loss"), (F.sum(F.when(F.col("ok"), F.col("soft")).otherwise(0.0)) / n * temperature**2).alias("soft_loss"), (F.count_if(F.col("ok") & F.col("inside")) / n).alias("frac_hard_in_topk"), F.count_if("ok").alias("tokens"))
    return out.withColumn("loss", (1 - alpha) * F.col("hard_loss") + alpha * F.col("soft_loss"))
