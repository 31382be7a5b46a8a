"""Distillation tables and losses as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .scoring import once

MISSING = -1e30
IGNORED = -100


def ids_or_zero(ids: Column) -> tuple[Column, Column]:
    """Ids with 0 for null, and which were there."""
    return F.transform(ids, lambda i: F.coalesce(i, F.lit(0))), F.transform(ids, lambda i: i.isNotNull())


def logprobs_or_least(values: Column) -> Column:
    """Null and NaN as MISSING."""
    return F.transform(values, lambda v: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(MISSING)))


def labels(ids: Column, start: Column) -> Column:
    """IGNORED before start (at most as many as ids), the ids from there."""
    start = F.least(start, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), start), F.slice(ids, start + 1, F.greatest(F.size(ids) - start, F.lit(0))))


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def planned_rows(manifest: DataFrame, most: int | None = None) -> DataFrame:
    """One row, rows: what the shards of a manifest hold together, no more than most."""
    total = manifest.select(F.explode("shards").alias("s")).agg(F.coalesce(F.sum("s.row_count"), F.lit(0)).alias("rows"))
    return total if most is None else total.select(F.least("rows", F.lit(most)).alias("rows"))


def kd_records(df: DataFrame, index: str = "example_index") -> DataFrame:
    """Training rows from soft-label rows with input_ids."""
    fixed = lambda c: F.transform(c, lambda row: ids_or_zero(row)[0])
    return df.select(
        F.col(index).cast("long").alias("example_index"), F.col("input_ids").cast("array<int>").alias("input_ids"), F.col("assistant_token_start").cast("int").alias("assistant_start"), F.size("assistant_token_ids").alias("assistant_len"),
        F.col("assistant_token_ids").cast("array<int>").alias("gold_ids"), fixed(F.col("topk_token_ids")).cast("array<array<int>>").alias("topk_ids"),
        F.transform("topk_logprobs", logprobs_or_least).cast("array<array<float>>").alias("topk_logprobs"), F.transform("topk_token_ids", lambda row: ids_or_zero(row)[1]).alias("topk_valid_mask"), "hard_label_in_topk",
    )


def violations(df: DataFrame, k: int) -> DataFrame:
    """Training rows that break a rule: example_index and rule."""
    n = F.col("assistant_len")
    rules = {
        "empty span": n <= 0, "start": F.col("assistant_start") < 1, "span end": F.col("assistant_start") + n > F.size("input_ids"),
        "gold": F.slice("input_ids", F.col("assistant_start") + 1, F.greatest(n, F.lit(0))) != F.col("gold_ids"),
        "lengths": (F.size("gold_ids") != n) | (F.size("topk_ids") != n) | (F.size("topk_logprobs") != n) | (F.size("topk_valid_mask") != n),
        "width": F.exists("topk_ids", lambda r: F.size(r) != k),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return df.select("example_index", F.explode(found).alias("rule"))


def shifted_targets(ids: Column, start: Column) -> Column:
    """struct(position, target): the position whose logits predict each id from start on."""
    return let(ids, lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i >= start) & (i >= 1)), lambda i: F.struct((i - 1).alias("position"), F.get(v, i).alias("target"))))


# --- losses from logits; one row is one position -----------------------------------------------


def log_sum_exp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))


def scaled(z: Column, temperature: float) -> Column:
    return F.transform(z, lambda x: x.cast("double") / F.lit(float(temperature)))


def softmax(z: Column, valid: Column | None = None) -> Column:
    """Softmax over the entries that valid (array of boolean) allows, 0 at others, and all 0 where it
    allows none."""
    masked = z if valid is None else F.zip_with(z, valid, lambda x, v: F.when(v, x))

    def shares(v: Column) -> Column:
        powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))))
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
        return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda x: F.when(t > 0, x / t).otherwise(0.0))))

    return let(masked, shares)


def hard_ce(z: Column, gold: Column) -> Column:
    return let(z, lambda v: log_sum_exp(v) - F.get(v, gold))


def _gain(v: Column, norm: Column, ids: Column, weights: Column) -> Column:
    """The mean log-probability of ids under logits v with the log-sum-exp norm; entries without weight don't count."""
    return F.aggregate(F.zip_with(weights, ids, lambda w, i: F.when(w > 0, w * (F.get(v, i) - norm)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def soft_ce(z: Column, ids: Column, teacher: Column, temperature: float, valid: Column | None = None) -> Column:
    """Cross-entropy of the student at temperature against the teacher's renormalised top candidates,
    those that valid allows; 0 where it allows none."""
    weights = softmax(scaled(teacher, temperature), valid)
    return let(scaled(z, temperature), lambda v: let(log_sum_exp(v), lambda norm: -_gain(v, norm, ids, weights)))


def within_vocabulary(ids: Column, size: int | Column) -> Column:
    return F.transform(ids, lambda i: i < size)


def losses(df: DataFrame, by: list[str], alpha: float, temperature: float, vocabulary: int | None = None, valid: str | None = None) -> DataFrame:
    """hard_loss, soft_loss (times temperature squared), loss, frac_hard_in_topk and tokens by group.

    df has a row per position: logits, gold, topk_ids, topk_logprobs, and, named by valid, which
    candidates have an id (all, if not given); a candidate without id takes no teacher mass even if
    it has a logprob. A gold id beyond the vocabulary takes the position out of both losses;
    candidates beyond it are masked and, as those without id, stand as id 0 where the gold id is
    looked for.
    """
    if not 0 <= alpha <= 1 or temperature <= 0:
        raise ValueError("alpha must be within 0 and 1, temperature positive")
    z = scaled(F.col("logits"), 1)
    size = F.lit(vocabulary) if vocabulary is not None else F.size("logits")
    ids = F.transform("topk_ids", lambda i: F.coalesce(F.when(i < size, i), F.lit(0)))
    inside = within_vocabulary(F.col("topk_ids"), size)
    usable = inside if valid is None else F.zip_with(inside, F.col(valid), lambda a, b: a & b)
    student = z if vocabulary is None else F.slice(z, 1, vocabulary)
    gold = F.when(F.col("gold") < size, F.col("gold"))
    each = df.select(*by, gold.isNotNull().alias("ok"), hard_ce(student, gold).alias("h"), soft_ce(student, ids, F.col("topk_logprobs"), temperature, F.transform(usable, lambda u: F.coalesce(u, F.lit(False)))).alias("s"), F.array_contains(ids, F.col("gold")).alias("inside"))
    n = F.greatest(F.count_if("ok"), F.lit(1))
    out = each.groupBy(*by).agg((F.sum(F.when(F.col("ok"), F.col("h")).otherwise(0.0)) / n).alias("hard_loss"), (F.sum(F.when(F.col("ok"), F.col("s")).otherwise(0.0)) / n * temperature**2).alias("soft_loss"), (F.count_if(F.col("ok") & F.col("inside")) / n).alias("frac_hard_in_topk"), F.count_if("ok").alias("tokens"))
    return out.withColumn("loss", (1 - alpha) * F.col("hard_loss") + alpha * F.col("soft_loss"))


def cached_soft_loss(df: DataFrame, by: list[str], temperature: float) -> DataFrame:
    """soft_loss by group for targets from a cached teacher: target_ids (-1: none), target_probs and
    selected (whether the position counts) beside logits. Probabilities are divided by their sum,
    or by 1e-8 if that is more; the mean over selected positions is multiplied by the squared
    temperature, and is 0 without any."""
    good = F.transform("target_ids", lambda i: i >= 0)
    mass = F.zip_with("target_probs", good, lambda p, g: F.when(g, p.cast("double")).otherwise(0.0))
    weights = let(mass, lambda m: let(F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), F.lit(1e-8)), lambda t: F.transform(m, lambda x: x / t)))
    each = df.select(*by, F.col("selected").cast("boolean").alias("ok"), let(scaled(F.col("logits"), temperature), lambda v: let(log_sum_exp(v), lambda norm: -_gain(v, norm, F.col("target_ids"), weights))).alias("s"))
    return each.groupBy(*by).agg((F.coalesce(F.avg(F.when(F.col("ok"), F.col("s"))), F.lit(0.0)) * temperature**2).alias("soft_loss"))


def merged_candidates(df: DataFrame, by: list[str], k: int, order: str | None = None) -> DataFrame:
    """Candidate mass by token id at each position, the k greatest, renormalised to 1 (by, token_id,
    prob); null ids and positions without mass give nothing. Repeated ids add up. Of equal masses the
    id that was met first wins, by the column order, or the smaller id where none is given."""
    first = [F.min(order).alias("_o")] if order else []
    mass = df.filter("token_id is not null").groupBy(*by, "token_id").agg(F.sum("prob").alias("mass"), *first)
    ties = ["_o"] if order else []
    top = mass.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("mass"), *ties, "token_id"))).filter(F.col("_r") <= k)
    total = F.sum("mass").over(W.partitionBy(*by))
    return top.withColumn("_t", total).filter("_t > 0").select(*by, "token_id", (F.col("mass") / F.col("_t")).alias("prob"))


def weighted_loss(df: DataFrame, by: list[str], loss: str, weight: str) -> DataFrame:
    """Mean loss by weight; rows without a loss don't count."""
    w = F.when(F.col(loss).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(loss) * w), F.sum(w)).alias("loss"))


def supervised_tokens(df: DataFrame, length: str) -> DataFrame:
    return df.agg(F.greatest(F.coalesce(F.sum(length), F.lit(0)), F.lit(1)).alias("tokens"))


def length_filter(df: DataFrame, length: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows no longer than most, and one row with the counts kept and dropped."""
    return df.filter(F.col(length) <= most), df.agg(F.count_if(F.col(length) <= most).alias("kept"), F.count_if(F.col(length) > most).alias("dropped"))


# --- batches -----------------------------------------------------------------------------------


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def _filled(values: Column, pad: Column, width: Column) -> Column:
    return F.concat(values, F.array_repeat(pad, width - F.size(values)))


def pad_batch(df: DataFrame, batch: str, ids: str, pad: int = 0) -> DataFrame:
    """ids padded on the right to the longest of their batch, with the attention mask."""
    out = df.withColumn("_w", F.max(F.size(ids)).over(W.partitionBy(batch)))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    return out.withColumn("attention_mask", _filled(ones, F.lit(0), F.col("_w"))).withColumn(ids, _filled(F.col(ids), F.lit(pad), F.col("_w"))).drop("_w")


def training_batch(df: DataFrame, batch: str, pad: int, k: int, label_pad: int = IGNORED) -> DataFrame:
    """Training rows (see kd_records) as padded arrays of their batch's widths: input_ids,
    attention_mask, labels (label_pad outside the span), gold_ids, topk_ids, topk_logprobs (MISSING
    where not valid), topk_valid, span_mask, assistant_start, assistant_len; batch and example_index.

    A span that begins before 1 or ends beyond the ids, or candidates that aren't k wide, fail the job.
    """
    df = once(df, **{c: F.col(c) for c in df.columns})
    length, start, n = F.size("input_ids"), F.col("assistant_start"), F.col("assistant_len")
    fault = (
        F.when(start < 1, "span begins before 1").when(start + n > length, "span ends beyond the ids").when(F.exists("topk_ids", lambda r: F.size(r) != k), "candidates of another width")
    )
    checked = df.withColumn("_fault", F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("example "), F.col("example_index").cast("string"), F.lit(": "), fault)).cast("boolean")))
    part = W.partitionBy(batch)
    wide = checked.filter(F.col("_fault").isNull()).withColumn("_t", F.max(length).over(part)).withColumn("_n", F.max("assistant_len").over(part))
    t, w = F.col("_t"), F.col("_n")
    label = F.concat(F.array_repeat(F.lit(label_pad), start), F.col("gold_ids"))
    row = lambda x: F.array_repeat(F.lit(x), k)
    logprobs = F.zip_with("topk_logprobs", "topk_valid_mask", lambda p, v: F.zip_with(p, v, lambda x, ok: F.when(ok, x).otherwise(F.lit(MISSING).cast("float"))))
    return wide.select(
        batch, "example_index", _filled(F.col("input_ids"), F.lit(pad), t).alias("input_ids"), _filled(F.array_repeat(F.lit(1), length), F.lit(0), t).alias("attention_mask"), _filled(label, F.lit(label_pad), t).alias("labels"),
        _filled(F.col("gold_ids"), F.lit(0), w).alias("gold_ids"), _filled(F.col("topk_ids"), row(0), w).alias("topk_ids"), _filled(logprobs, row(MISSING).cast("array<float>"), w).alias("topk_logprobs"), _filled(F.col("topk_valid_mask"), row(False), w).alias("topk_valid"),
        _filled(F.array_repeat(F.lit(True), n), F.lit(False), w).alias("span_mask"), "assistant_start", "assistant_len",
    )


def distillation_batch(df: DataFrame, batch: str, pad: int, k: int, label_pad: int = IGNORED) -> DataFrame:
    """Distillation examples (see distill.distillation_examples; of hard examples only the hard
    columns) padded to their batch's widths: ids with pad, masks with 0, labels with label_pad,
    candidates with -1 and probabilities with 0; rows of fewer than k candidates are filled up."""
    hard = {"hard_input_ids": F.lit(pad), "hard_attention_mask": F.lit(0), "hard_labels": F.lit(label_pad)}
    soft = {"soft_input_ids": F.lit(pad), "soft_attention_mask": F.lit(0), "soft_target_ids": F.array_repeat(F.lit(-1), k), "soft_target_probs": F.array_repeat(F.lit(0.0), k), "soft_target_mask": F.lit(0)}
    pads = hard | soft if "soft_input_ids" in df.columns else hard
    out = once(df, **{c: F.col(c) for c in df.columns})
    for name, fill in (("soft_target_ids", -1), ("soft_target_probs", 0.0)):
        if name in pads:
            out = out.withColumn(name, F.transform(name, lambda r, f=fill: _filled(r, F.lit(f), F.lit(k))))
    widths = {name: f"_w{i}" for i, name in enumerate(pads)}
    for name, w in widths.items():
        out = out.withColumn(w, F.max(F.size(name)).over(W.partitionBy(batch)))
    return out.select(batch, *(c for c in df.columns if c != batch and c not in pads), *(_filled(F.col(c), f, F.col(widths[c])).alias(c) for c, f in pads.items()))
