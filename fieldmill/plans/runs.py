"""Queries over losses in blocks, runs that break off and go on, and writers at once."""

from __future__ import annotations

import contextlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfix
from ..operators import blocked, distill, history, keymatch, scoring
from ..sources import paths, readers, shardsource, writers
from ..streaming import asked, shardrun
from . import sql
from .records import Chars
from .queries import _CE, _KEYED, _RECORDS, GT, PRED, orders, positions, query, table

# --- losses from logits in blocks ---------------------------------------------------------------

BLOCK = 16


def blocks_and_targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Logits of the positions in blocks of 16, and their targets; no row has the vocabulary of 64."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return blocked.in_blocks(e, ["vec_id"], "embedding", BLOCK), positions(spark, sf).drop("logits")


@query(_CE + "SELECT vec_id, round(hard, 6) AS hard, round(soft, 6) AS soft, inside > 0 AS inside FROM v")
def blocked_ce(spark, sf):
    blocks, targets = blocks_and_targets(spark, sf)
    each = blocked.position_losses(blocks, targets, ["vec_id"], BLOCK, 2.0, 64)
    return each.select("vec_id", F.round("hard", 6).alias("hard"), F.round("soft", 6).alias("soft"), "inside")


@query(_CE + "SELECT label, round(avg(hard), 6) AS hard_loss, round(avg(soft) * 4, 6) AS soft_loss, round(0.3 * avg(hard) + 0.7 * avg(soft) * 4, 6) AS loss, round(avg(inside), 6) AS frac_hard_in_topk, count(*) AS tokens FROM v GROUP BY label")
def blocked_loss(spark, sf):
    out = blocked.losses(*blocks_and_targets(spark, sf), ["vec_id"], ["label"], BLOCK, 0.7, 2.0, 64)
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("hard_loss", "soft_loss", "loss", "frac_hard_in_topk")), "tokens")


# --- runs that go on ----------------------------------------------------------------------------

ANSWER = "_sample_id long, teacher_output string"


@query("SELECT c_custkey AS _sample_id, upper(c_name) AS teacher_output, 1::BIGINT AS n_answers, 2::BIGINT AS n_runs FROM customer")
def broken_teacher(spark, sf):
    """A teacher that fails half way, and a second run that asks for the rest alone."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("_sample_id"), "c_name")
    cache, half = paths.fresh(spark, "asked"), c.agg(F.percentile_approx("_sample_id", 0.5)).first()[0]

    def teacher(limit):
        def run(frames):
            for f in frames:
                if limit is not None and (f["_sample_id"] > limit).any():
                    raise ConnectionError("no answer")
                yield f[["_sample_id"]].assign(teacher_output=f["c_name"].str.upper())

        return run

    rows = max(1, c.count() // 8)
    with contextlib.suppress(Exception):
        asked.ask_rest(c.coalesce(1), cache, "_sample_id", teacher(half), ANSWER, rows=rows)
    asked.ask_rest(c, cache, "_sample_id", teacher(None), ANSWER, rows=rows)
    got = asked.answers(spark, cache, ANSWER)
    return got.groupBy("_sample_id", "teacher_output").agg(F.count(F.lit(1)).alias("n_answers")).crossJoin(F.broadcast(got.agg(F.count_distinct("run").alias("n_runs"))))


_BY_256 = "SELECT doc_id // 256 AS shard_index, min(doc_id) AS example_start, max(doc_id) + 1 AS example_end, count(*) AS row_count, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"


@query(_BY_256)
def resumed_shards(spark, sf):
    """A run over shards that stops at its third batch, and goes on there: entries and rows as of a whole run."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), "n_chars")
    source, out, made = paths.fresh(spark, "examples"), paths.fresh(spark, "run"), []
    shardrun.stage(docs, source, 256)
    files = max(1, math.ceil(docs.select(shardrun.shard_of(F.col("example_index"), 256)).distinct().count() / 8))  # eight batches, however many shards

    def stops(batch):
        made.append(1)
        if len(made) == 3:
            raise InterruptedError
        return batch

    schema = "example_index long, n_chars long"
    with contextlib.suppress(Exception):
        shardrun.make_shards(spark, source, schema, out, stops, files=files)
    shardrun.make_shards(spark, source, schema, out, lambda batch: batch, files=files)
    rows = spark.read.parquet(f"{out}/shards").groupBy(F.col("shard_index").cast("long").alias("shard_index")).agg(F.sum("n_chars").alias("chars"))
    return shardrun.entries(spark, out).join(rows, "shard_index", "full_outer")


@query("SELECT doc_id AS example_index, lang, doc_id // 64 AS shard_index FROM documents")
def shard_source(spark, sf):
    """A write of shards that fails leaves nothing, the next one is what is read."""
    shardsource.register(spark)
    path = paths.fresh(spark, "source")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), "lang")
    broken = docs.withColumn("lang", F.when(F.col("example_index") % 150 == 149, F.raise_error(F.lit("a bad row")).cast("string")).otherwise(F.lit("broken")))
    write = lambda df: df.write.format("fieldmill_shards").option("size", 64).mode("append").save(path)
    with contextlib.suppress(Exception):
        write(broken)
    write(docs)
    return shardsource.read_shards(spark, path, "example_index long, lang string")


@query("SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS step, 'n' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1")
def history_at_once(spark, sf):
    """Two writers of a history at once: the steps of both are there."""
    path = paths.fresh(spark, "history")
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").cast("long").alias("step")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = history.to_long(e, ["step"], ["n"])
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: writers.history(m.filter(F.col("step") % 2 == k), path), (0, 1)))
    return spark.read.parquet(f"{path}/v={writers.versions(spark, path)[-1]}/long").select("step", "metric", "value")


# --- scans and counts ---------------------------------------------------------------------------


@query("SELECT doc_id AS example_index, lang FROM documents ORDER BY doc_id LIMIT 100")
def capped_shard_scan(spark, sf):
    """The first rows of shards, whose last is told by the manifest; only shards up to it are read."""
    path, told = paths.fresh(spark, "shards"), paths.fresh(spark, "manifest")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), "lang")
    writers.shards(docs, path, 64)
    writers.manifest(docs.withColumn("shard_index", F.floor(F.col("example_index") / 64)), told)
    return readers.shards(spark, path, 100, readers.manifest(spark, told)).select("example_index", "lang")


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE n_chars <= 2000) AS kept, (SELECT count(*) FROM documents WHERE n_chars > 2000) AS dropped FROM documents WHERE n_chars <= 2000")
def length_filter_written(spark, sf):
    """Rows kept, and the counts that the job which wrote them has told."""
    path = paths.fresh(spark, "short")
    kept, dropped = writers.kept_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 2000, path)
    return spark.read.parquet(path).select("doc_id", F.lit(kept).cast("long").alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


# --- keys by dictionary ---------------------------------------------------------------------------


@query(f"WITH {sql.scores(_RECORDS, 'o_orderkey, corpus')} SELECT o_orderkey, key AS gt_key, pk AS pred_key FROM v")
def dictionary_keys(spark, sf):
    """The keys that field_verdicts pairs, matched once for each distinct key and set of keys."""
    rows = orders(spark, sf, gt=GT, pred=PRED)
    both = scoring.once(rows, g=jsonfix.parse_output(F.col("gt")), p=jsonfix.parse_output(F.col("pred")))
    keys = lambda c: F.transform(f"{c}.fields", lambda f: f["key"])
    each = both.select("o_orderkey", F.explode(keys("g")).alias("gt_key"), F.coalesce(keys("p"), F.array().cast("array<string>")).alias("names"))
    return keymatch.with_matched_keys(each, "gt_key", "names").select("o_orderkey", "gt_key", "pred_key")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN {_KEYED} END AS pred_key FROM part")
def dictionary_typos(spark, sf):
    """A key among others with typos, case and accents: one equal in plain form, one alike, none."""
    names = F.array(F.lit("other"), F.expr(_KEYED), F.lit("id"))
    rows = table(spark, sf, "part").select("p_partkey", F.lit("pröduct-name").alias("target"), names.alias("names"))
    return keymatch.with_matched_keys(rows, "target", "names").select("p_partkey", "pred_key")


# --- vocabulary -----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, unnest([left(text, 1), left(text, 2), right(text, 1), 'é']) AS token FROM documents)
SELECT token, CASE WHEN length(token) = 1 THEN unicode(token) END AS token_id, CASE WHEN length(token) = 1 THEN token ELSE '' END AS back, count(*) AS n FROM t GROUP BY token""")
def vocabulary_join(spark, sf):
    """Tokens by a vocabulary of ASCII, and by the tokenizer for what it lacks; and back."""
    ascii_ = spark.range(128).select("id", F.char("id").alias("token"))
    docs = table(spark, sf, "documents")
    rows = docs.select(F.explode(F.array(F.left("text", F.lit(1)), F.left("text", F.lit(2)), F.right("text", F.lit(1)), F.lit("é"))).alias("token"))
    there = distill.texts_by_vocabulary(distill.ids_by_vocabulary(rows, "token", ascii_, Chars), "token_id", ascii_, Chars, "back")
    return there.groupBy("token", "token_id", "back").agg(F.count(F.lit(1)).alias("n"))
