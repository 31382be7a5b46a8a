"""Per-token teacher candidates as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import printable_token
from .scoring import once

CANDIDATE = "struct<id:int,text:string,logprob:double>"


def assistant_span(full: Column, prefix: Column) -> Column:
    """struct(ids, start, length) of what follows the prompt's ids in the full text's ids; null where
    the prompt isn't a proper prefix."""
    n = F.size(prefix)
    ok = (F.size(full) > n) & (F.slice(full, F.lit(1), n) == prefix)
    return F.when(ok, F.struct(F.slice(full, n + 1, F.size(full) - n).alias("ids"), n.alias("start"), (F.size(full) - n).alias("length")))


def aligned(logprobs: Column, tokens: Column) -> Column:
    """Positions aligned with tokens: as they are if equally many, a null put in front if one is
    lacking; any other length fails the job."""
    lacking = F.size(tokens) - F.size(logprobs)
    fault = F.raise_error(F.concat(F.lit("candidates for "), F.size(logprobs).cast("string"), F.lit(" positions, tokens for "), F.size(tokens).cast("string")))
    none = F.array_repeat(F.get(logprobs, F.lit(-1)), 1)
    return F.when(lacking == 0, logprobs).when(lacking == 1, F.concat(none, logprobs)).otherwise(F.when(fault.cast("boolean"), logprobs))


def ranked(candidates: Column, k: int) -> Column:
    """The k candidates of greatest logprob, null the least; of equal ones those that were given first."""
    keyed = F.transform(candidates, lambda c, i: F.struct(F.coalesce(-c["logprob"], F.lit(float("inf"))).alias("least"), i.alias("at"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["c"])


def padded(candidates: Column, k: int) -> Column:
    """Exactly k candidates: cut, or filled up by an empty one (null id, empty text, null logprob)."""
    pad = F.expr(f"CAST(named_struct('id', NULL, 'text', '', 'logprob', NULL) AS {CANDIDATE})")
    return F.slice(F.concat(F.coalesce(candidates, F.array().cast(f"array<{CANDIDATE}>")), F.array_repeat(pad, k)), 1, k)


def gold_in_top(candidates: Column, gold: Column) -> Column:
    """For every position whether its token is among the candidates."""
    return F.zip_with(candidates, gold, lambda c, g: F.coalesce(F.exists(c, lambda x: x["id"] == g), F.lit(False)))


def records(df: DataFrame, k: int) -> DataFrame:
    """Soft-label columns from candidates (array by position of arrays) and assistant_token_ids."""
    top = F.transform("candidates", lambda c: padded(ranked(c, k), k))
    out = once(df, _top=top)
    return out.select(
        "*", F.transform("_top", lambda c: F.transform(c, lambda x: x["id"])).alias("topk_token_ids"), F.transform("_top", lambda c: F.transform(c, lambda x: x["text"])).alias("topk_token_text"),
        F.transform("_top", lambda c: F.transform(c, lambda x: x["logprob"])).alias("topk_logprobs"), gold_in_top(F.col("_top"), F.col("assistant_token_ids")).alias("hard_label_in_topk"),
    ).drop("_top")


def soft_label_records(df: DataFrame, k: int, source: str, digest: str, teacher: str, template: str) -> DataFrame:
    """The whole record of every example, in the order of its columns.

    df holds example_index, instruction, input, output, full_chat_text, full_token_ids,
    prompt_token_ids, prompt_logprobs (array by position of arrays of candidates, one position
    lacking at the front at most) and assistant_token_text. Ids that differ from the teacher's, a
    prompt that isn't a proper prefix, and a position of the answer without candidates fail the job.
    """
    span = assistant_span(F.col("full_token_ids"), F.col("prompt_token_ids"))
    lined = once(once(df, **{c: F.col(c) for c in df.columns}), _s=span, _c=aligned(F.col("prompt_logprobs"), F.col("full_token_ids")))
    answer = F.slice("_c", F.col("_s.start") + 1, F.col("_s.length"))
    fault = F.when(F.col("_s").isNull(), "the prompt is no proper prefix").when(F.exists(answer, lambda c: c.isNull()), "a position without candidates")
    if "teacher_token_ids" in df.columns:
        fault = F.when(F.col("teacher_token_ids").isNotNull() & (F.col("teacher_token_ids") != F.col("full_token_ids")), "other ids than the teacher's").otherwise(fault)
    checked = lined.withColumn("_f", F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("example "), F.col("example_index").cast("string"), F.lit(": "), fault)).cast("boolean"))).filter(F.col("_f").isNull())
    made = records(checked.withColumn("candidates", answer).withColumn("assistant_token_ids", F.col("_s.ids")), k)
    return made.select(
        F.col("example_index").cast("long").alias("example_index"), F.lit(source).alias("source_path"), F.lit(teacher).alias("teacher_model"), F.lit(k).cast("long").alias("top_k"), "instruction", "input", "output", "full_chat_text",
        F.col("_s.start").cast("long").alias("assistant_token_start"), F.col("_s.length").cast("long").alias("assistant_token_count"), "assistant_token_ids", "assistant_token_text",
        "topk_token_ids", "topk_token_text", "topk_logprobs", "hard_label_in_topk", F.sha2(F.lit(template), 256).alias("chat_template_fingerprint"), F.lit(digest).alias("source_dataset_sha256"),
    )


def with_teacher(rendered: DataFrame, teacher: DataFrame, key: str = "example_index") -> DataFrame:
    """Rendered examples with the teacher's results; an example or a result without its partner fails the job."""
    both = rendered.withColumn("_r", F.lit(True)).join(teacher.withColumn("_t", F.lit(True)), key, "full_outer")
    complete = F.when(F.col("_r") & F.col("_t"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no partner for example "), F.col(key).cast("string"))).cast("boolean"))
    return both.filter(complete).drop("_r", "_t")


def shard_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def shard_plan(df: DataFrame, index: str, size: int) -> DataFrame:
    """shard_index, example_start, example_end (exclusive) and row_count."""
    return df.groupBy(shard_of(F.col(index), size).alias("shard_index")).agg(F.min(index).alias("example_start"), (F.max(index) + 1).alias("example_end"), F.count(F.lit(1)).alias("row_count"))


def open_shards(plan: DataFrame, done: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Shards that are still to be made: those not done, and those done whose file is gone (files
    holds the shard_index of every file that is there)."""
    finished = done.select("shard_index").distinct()
    if files is not None:
        finished = finished.join(files.select("shard_index").distinct(), "shard_index", "left_semi")
    return plan.join(finished, "shard_index", "left_anti")


def logprob_steps(df: DataFrame, keys: list[str], steps: str = "steps") -> DataFrame:
    """A row for every step with a logprob: keys, position (counted before others are dropped),
    token, logprob, prob, top_candidates (those with a logprob)."""
    out = df.select(*keys, F.posexplode(steps).alias("position", "s")).filter("s.logprob is not null")
    top = F.transform(F.filter(F.coalesce("s.top_logprobs", F.array().cast("array<struct<token:string,logprob:double>>")), lambda c: c["logprob"].isNotNull()), lambda c: F.struct(F.coalesce(c["token"], F.lit("")).alias("token"), c["logprob"].alias("logprob"), F.exp(c["logprob"]).alias("prob")))
    return out.select(*keys, "position", F.coalesce("s.token", F.lit("")).alias("token"), F.col("s.logprob").alias("logprob"), F.exp("s.logprob").alias("prob"), top.alias("top_candidates"))


def preview(df: DataFrame, keys: list[str], rows: int = 20, top: int = 10) -> DataFrame:
    """The first rows steps of each record: keys, position, teacher_token, teacher_prob, and their
    first top candidates as text."""
    shown = F.array_join(F.transform(F.slice("top_candidates", 1, top), lambda c: F.format_string("%s (%.4f)", printable_token(c["token"]), c["prob"])), " | ")
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("position"))).filter(F.col("_r") <= rows)
    return first.select(*keys, "position", printable_token(F.col("token")).alias("teacher_token"), F.round("prob", 6).alias("teacher_prob"), shown.alias("top_candidates"))
