"""Queries over record files, soft labels, training batches, samples and streams.

Files are derived from the driver's tables, written to the shared folder by the library's writers
and read back by its readers; the SQL beside knows only the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import checks, distill, history, kd, sample, scoring, softlabel
from ..sources import paths, readers, writers
from ..streaming import inline, teacher
from . import sql
from .queries import GT, PRED, orders, positions, query, spans, table

# --- sources and sinks -------------------------------------------------------------------------


def json_file(df: DataFrame, path: str, single: bool = False) -> str:
    """df's few rows as one JSON array in a text file (or its first row as an object)."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("r"))
    rows.select(F.to_json(F.get("r", F.lit(0)) if single else F.col("r")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def nations(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.format_string("%04d", "n_nationkey").alias("instruction"), F.col("n_name").alias("input"), F.to_json(F.struct("n_regionkey")).alias("output"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.format_string("%04d", "r_regionkey").alias("instruction"), F.col("r_name").alias("input"), F.lit("{}").alias("output"))


_NATIONS = "SELECT printf('%04d', n_nationkey) AS instruction, n_name AS input, '{\"n_regionkey\":' || n_regionkey || '}' AS output FROM nation"
_REGIONS = "SELECT printf('%04d', r_regionkey) AS instruction, r_name AS input, '{}' AS output FROM region"


@query(_NATIONS)
def json_array_scan(spark, sf):
    return readers.json_array(spark, json_file(nations(spark, sf), paths.fresh(spark, "array"))).select("instruction", "input", "output")


@query(f"SELECT 'many' AS kind, instruction, input FROM ({_NATIONS}) UNION ALL SELECT 'one', instruction, input FROM ({_REGIONS}) WHERE instruction = '0000'")
def eval_scan(spark, sf):
    many, one = json_file(nations(spark, sf), paths.fresh(spark, "eval")), json_file(regions(spark, sf), paths.fresh(spark, "eval"), single=True)
    return readers.eval_dataset(spark, many).select(F.lit("many").alias("kind"), "instruction", "input").union(readers.eval_dataset(spark, one).select(F.lit("one"), "instruction", "input"))


@query("SELECT n_name AS input, n_regionkey AS region FROM nation")
def raw_json_scan(spark, sf):
    raw = readers.raw_json(spark, json_file(nations(spark, sf), paths.fresh(spark, "raw")))
    each = raw.select(F.explode(F.variant_get("value", "$", "array<variant>")).alias("v"))
    return each.select(F.variant_get("v", "$.input", "string").alias("input"), F.get_json_object(F.variant_get("v", "$.output", "string"), "$.n_regionkey").cast("long").alias("region"))


@query(f"SELECT 'nation' AS corpus, input FROM ({_NATIONS}) UNION ALL SELECT 'region', input FROM ({_REGIONS})")
def corpora_scan(spark, sf):
    files = {"nation": json_file(nations(spark, sf), paths.fresh(spark, "corpus")), "region": json_file(regions(spark, sf), paths.fresh(spark, "corpus"))}
    return readers.corpora(spark, files).select("corpus", "input")


@query(f"SELECT 0::INT AS file_index, CAST(instruction AS BIGINT) AS example_index, input FROM ({_REGIONS}) UNION ALL SELECT 1, CAST(instruction AS BIGINT), input FROM ({_NATIONS}) WHERE CAST(instruction AS INT) < 7")
def concatenated_scan(spark, sf):
    files = [json_file(regions(spark, sf), paths.fresh(spark, "part")), json_file(nations(spark, sf), paths.fresh(spark, "part")), json_file(nations(spark, sf), paths.fresh(spark, "part"))]
    return readers.concatenated(spark, files, 12).select("file_index", "example_index", "input")


@query(f"SELECT CAST(instruction AS BIGINT) AS example_index, input FROM ({_NATIONS}) WHERE CAST(instruction AS INT) < 3")
def fallback_scan(spark, sf):
    there = json_file(nations(spark, sf), paths.fresh(spark, "there"))
    return readers.first_existing(spark, [paths.fresh(spark, "missing"), there], 3).select("example_index", "input")


@query("SELECT doc_id AS example_index, CASE WHEN (doc_id // 64) % 2 = 0 THEN 'again' ELSE lang END AS lang FROM documents ORDER BY doc_id LIMIT 200")
def shard_scan(spark, sf):
    path = paths.fresh(spark, "shards")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), "lang")
    writers.shards(docs, path, 64)
    writers.shards(docs.filter("example_index div 64 % 2 = 0").withColumn("lang", F.lit("again")), path, 64)
    return readers.shards(spark, path, 200).select("example_index", "lang")


@query("SELECT doc_id AS example_index, lang FROM documents")
def shard_writer(spark, sf):
    path = paths.fresh(spark, "json-shards")
    writers.shards(table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), "lang"), path, 128, writer=writers.FileShards("json"))
    return spark.read.schema("example_index long, lang string").json(path).select("example_index", "lang")


_SHARDS = "SELECT CAST(doc_id // 64 AS INT) AS shard_index, CAST(min(doc_id) AS INT) AS example_start, CAST(max(doc_id) + 1 AS INT) AS example_end, CAST(count(*) AS INT) AS row_count FROM documents GROUP BY 1"


def manifest_of(spark: SparkSession, sf: str) -> str:
    path = paths.fresh(spark, "manifest")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"), F.floor(F.col("doc_id") / 64).cast("long").alias("shard_index"))
    writers.manifest(docs, path, {"source_path": "documents", "teacher_model": "none", "top_k": 8, "shard_size": 64})
    return path


@query(f"WITH s AS ({_SHARDS}) SELECT 8::INT AS top_k, (SELECT count(*)::INT FROM documents) AS total_examples, (SELECT count(*)::INT FROM s) AS total_shards, 'shards/shard_index=' || shard_index AS path, * FROM s")
def manifest_scan(spark, sf):
    m = readers.manifest(spark, manifest_of(spark, sf))
    none = readers.manifest(spark, paths.fresh(spark, "no-manifest"), strict=False)
    both = m.unionByName(none, allowMissingColumns=True)
    return both.select("top_k", "total_examples", "total_shards", F.explode("shards").alias("s")).select("top_k", "total_examples", "total_shards", "s.*")


@query("SELECT 'all' AS kind, count(*) AS rows FROM documents UNION ALL SELECT 'cut', least(count(*), 150) FROM documents")
def planned_rows(spark, sf):
    m = readers.manifest(spark, manifest_of(spark, sf))
    return kd.planned_rows(m).select(F.lit("all").alias("kind"), "rows").union(kd.planned_rows(m, 150).select(F.lit("cut"), "rows"))


@query("SELECT c_custkey AS _sample_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS teacher_output FROM customer")
def cache_scan(spark, sf):
    path = paths.fresh(spark, "cache")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("_sample_id"), F.col("c_name").alias("teacher_output"))
    twice = rows.select("_sample_id", F.lit("old").alias("teacher_output")).union(rows)
    writers.append_jsonl(twice.coalesce(1), path)
    writers.append_jsonl(rows.filter("_sample_id % 3 = 0").withColumn("teacher_output", F.lit("new")), path)
    empty = readers.jsonl_cache(spark, paths.fresh(spark, "no-cache")).select("_sample_id", "teacher_output")
    return readers.jsonl_cache(spark, path).select("_sample_id", "teacher_output").union(empty)


@query("SELECT c_custkey AS _sample_id, c_name AS teacher_output FROM customer WHERE c_custkey % 4 = 0")
def cache_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("_sample_id"), "c_name")
    cache = c.filter("_sample_id % 2 = 0").select("_sample_id", F.col("c_name").alias("teacher_output"), F.explode(F.array(F.lit(2), F.lit(1))).alias("n"))
    cache = cache.withColumn("teacher_output", F.when(F.col("n") == 2, F.col("teacher_output")).otherwise("older"))
    return history.with_cache(c.filter("_sample_id % 4 in (0, 1)").select("_sample_id"), cache, "_sample_id", ["n"]).select("_sample_id", "teacher_output")


_STEP = "CAST(strftime(ts, '%Y%m%d') AS BIGINT)"
_METRICS = f"SELECT {_STEP} AS step, 'gt_acc/' || event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").cast("long").alias("step"), F.concat(F.lit("gt_acc/"), F.col("event_type")).alias("metric"), "value")
    return e.groupBy("step", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"WITH m AS ({_METRICS}) SELECT CAST(step AS VARCHAR) AS step, round(CASE WHEN step % 2 = 0 THEN value + 1 ELSE value END, 4) AS click FROM m WHERE metric = 'gt_acc/click'")
def csv_history_scan(spark, sf):
    path = paths.fresh(spark, "history")
    m = metrics(spark, sf)
    writers.history(m, path)
    last = writers.history(m.filter("step % 2 = 0").withColumn("value", F.col("value") + 1), path)
    wide = readers.csv_history(spark, f"{path}/v={last}/wide").unionByName(readers.csv_history(spark, paths.fresh(spark, "no-history")), allowMissingColumns=True)
    return wide.filter("`gt_acc/click` is not null").select("step", F.round(F.col("`gt_acc/click`").cast("double"), 4).alias("click"))


@query("""SELECT step, value FROM (SELECT try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS step, try_cast(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events)
 WHERE step IS NOT NULL AND value IS NOT NULL""")
def rank_series(spark, sf):
    e = table(spark, sf, "events").select(F.expr("CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END").alias("step"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END").alias("value"))
    return history.series(e, ["step", "value"]).select("step", "value")


@query("SELECT vec_id, label, CAST(len(embedding) AS INT) AS n, 'embeddings' AS source FROM embeddings")
def kd_table_scan(spark, sf):
    path = paths.fresh(spark, "kd")
    writers.kd_table(table(spark, sf, "embeddings"), path, {"source": "embeddings"})
    return readers.kd_table(spark, f"{path}/data").join(F.broadcast(spark.read.json(f"{path}/meta")), how="cross").select("vec_id", "label", F.size("embedding").alias("n"), "source")


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_digests(spark, sf):
    path = paths.fresh(spark, "digests")
    table(spark, sf, "nation").select(F.col("n_name").alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = readers.digests(spark, f"{path}/n_nationkey=*")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("n_nationkey"), "sha256")


_GENERATED = f"SELECT o_orderkey % 3 AS step, 'c' || o_orderkey % 2 AS corpus, o_orderkey AS sample_idx, {GT} AS gt, {PRED} AS pred FROM orders"


def generations(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf, gt=GT, pred=PRED)
    return o.select((F.col("o_orderkey") % 3).alias("step"), F.concat(F.lit("c"), (F.col("o_orderkey") % 2).cast("string")).alias("corpus"), F.col("o_orderkey").alias("sample_idx"), "gt", "pred")


_STEPS = f"""WITH {sql.scores(_GENERATED, 'step, corpus, sample_idx')},
s AS (SELECT sample_idx, count(*) FILTER (kind <> 'mismatch') AS correct, count(*) AS total FROM v GROUP BY 1),
q AS (SELECT step, corpus, sample_idx, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, gok AND obj IS NOT NULL AS valid FROM j LEFT JOIN s USING (sample_idx))"""


@query(_STEPS + " SELECT step, corpus, sum(correct)::BIGINT AS matched_fields, sum(total)::BIGINT AS total_fields, count(*) AS examples FROM q GROUP BY 1, 2")
def step_summary(spark, sf):
    path = paths.fresh(spark, "summary")
    rolled = scoring.corpus_metrics(scoring.score(generations(spark, sf), ["step", "corpus", "sample_idx"])).filter("corpus is not null")
    writers.step_summary(rolled, path)
    return spark.read.json(path).select(F.col("step").cast("long").alias("step"), "corpus", "matched_fields", "total_fields", "examples")


@query(_STEPS + " SELECT step, corpus, sample_idx, CASE WHEN valid THEN round(100.0 * correct / total, 4) ELSE 0 END AS accuracy_pct, correct AS correct_fields, total AS total_fields, valid AS valid_json, total AS n_matches FROM q")
def step_samples(spark, sf):
    path = paths.fresh(spark, "samples")
    writers.samples(scoring.eval_samples(generations(spark, sf), ["step", "corpus", "sample_idx"], []), path)
    back = spark.read.json(path)
    return back.select(F.col("step").cast("long").alias("step"), "corpus", "sample_idx", F.round("accuracy_pct", 4).alias("accuracy_pct"), "correct_fields", "total_fields", "valid_json", F.size("field_matches").cast("long").alias("n_matches"))


@query("WITH s AS (SELECT unnest([50, 100]) AS size) SELECT CAST(size AS BIGINT) AS size, lang, count(*) AS count FROM s, documents WHERE doc_id < size GROUP BY 1, 2")
def subset_files(spark, sf):
    path = paths.fresh(spark, "subsets")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    writers.subsets({n: docs.filter(F.col("doc_id") < n) for n in (50, 100)}, path, "lang")
    rows = spark.read.json(f"{path}/size=*").groupBy("lang").count().select(F.lit("all").alias("kind"), "lang", "count")
    told = spark.read.json(f"{path}/manifest").select(F.col("size").cast("long").alias("size"), "lang", "count")
    seen = told.groupBy("lang").agg(F.sum("count").alias("n")).join(rows, "lang").filter("n = count").select("lang")
    return told.join(seen, "lang", "left_semi").union(told.join(seen, "lang", "left_anti").withColumn("count", F.lit(-1).cast("long")))


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN NULL ELSE round(sum(value), 2) END AS seconds FROM events GROUP BY event_type")
def report_file(spark, sf):
    path = paths.fresh(spark, "report")
    sums = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("seconds"))
    writers.report(sums.withColumn("seconds", F.when(F.col("event_type") != "click", F.col("seconds"))), path)
    return spark.read.json(path).select("event_type", "seconds")


@query("SELECT n_nationkey, trim(regexp_replace(lower('Run  ' || n_name || '/' || n_regionkey || ' !'), '[^a-z0-9._-]+', '-', 'g'), '-') AS slug FROM nation")
def slugs(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.slug(F.concat(F.lit("Run  "), "n_name", F.lit("/"), F.col("n_regionkey").cast("string"), F.lit(" !"))).alias("slug"))


@query("SELECT o_custkey AS run, 'checkpoint-' || max(o_orderkey) AS last FROM orders GROUP BY 1")
def last_checkpoint(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.explode(F.array(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")), F.lit("runs"), F.lit("checkpoint-x"))).alias("name"))
    return history.last_checkpoints(o, "run", "name")


# --- rendering, spans, soft labels -------------------------------------------------------------


@query("SELECT o_orderkey, '<|system|>order' || chr(10) || '<|user|>' || o_orderpriority || chr(10) || '<|assistant|>' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS text FROM orders")
def text_column(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("order").alias("instruction"), F.col("o_orderpriority").alias("input"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("output"))
    return text.with_text(rows).select("o_orderkey", "text")


@query("SELECT conv_id, turn, md5('[' || upper(role) || '] ' || coalesce(text, '')) AS shown FROM conversations")
def template_hook(spark, sf):
    shown = lambda role, content: F.concat(F.lit("["), F.upper(role), F.lit("] "), F.coalesce(content, F.lit("")))
    rows = table(spark, sf, "conversations").withColumn("m", F.array(F.struct("role", F.col("text").alias("content"))))
    return rows.select("conv_id", "turn", F.md5(text.chat(F.col("m"), template=shown)).alias("shown"))


class Chars:
    """A tokenizer of characters."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


@query("SELECT conv_id, turn, CAST(length(text) AS INT) AS n, CAST(coalesce(list_sum(list_transform(range(length(text)), lambda i: (i + 1) * unicode(text[i + 1]))), 0) AS BIGINT) AS checksum, left(text, 1) AS first, CASE WHEN length(text) = 1 THEN unicode(text) END AS one FROM conversations")
def tokenizer_hook(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("ids", distill.encoder(Chars)("text"))
    total = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), total.alias("checksum"), distill.decoder(Chars)(F.get("ids", F.lit(0))).alias("first"), distill.single_id(Chars)("text").alias("one"))


K = 3


def soft_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the conversations: the last turn is the answer, ids are code points, and a teacher
    gives two candidates a position (the id itself at odd ids, else the next one; and a null id),
    the best one last, and none for the first position."""
    c = spans(spark, sf)
    given = lambda i: F.array(
        F.struct(F.lit(None).cast("int").alias("id"), F.lit("?").alias("text"), F.lit(-3.0).alias("logprob")),
        F.struct(F.when(i % 2 == 1, i).otherwise(i + 1).alias("id"), F.lit("c").alias("text"), (-1.0 / (1 + i % 5)).cast("double").alias("logprob")),
    )
    rows = c.select(
        F.col("conv_id").alias("example_index"), F.lit("talk").alias("instruction"), F.lit("").alias("input"), F.get("turns", F.size("turns") - 1)["content"].alias("output"), text.chat(F.col("turns")).alias("full_chat_text"),
        F.col("ids").alias("full_token_ids"), F.slice("ids", F.lit(1), F.col("span.start")).alias("prompt_token_ids"), F.transform(F.slice("ids", F.lit(2), F.size("ids")), given).alias("prompt_logprobs"), F.transform("span.ids", lambda i: F.char(i)).alias("assistant_token_text"),
    ).filter("size(prompt_token_ids) > 0")
    return softlabel.soft_label_records(rows, K, "conversations", "0", "next", "chat")


_CHATS = """c AS (SELECT conv_id, turn, '<|' || role || '|>' || coalesce(text, '') AS t, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
g AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS whole, coalesce(string_agg(CASE WHEN turn < last THEN t END, chr(10) ORDER BY turn), '') AS front FROM c GROUP BY conv_id),
a AS (SELECT conv_id, whole, length(front) AS start, length(whole) - length(front) AS n, unnest(range(length(front), length(whole))) AS o FROM g WHERE front <> ''),
i AS (SELECT *, unicode(whole[o + 1]) AS id FROM a)"""


@query(f"""WITH {_CHATS} SELECT conv_id AS example_index, 'conversations' AS source_path, 'next' AS teacher_model, CAST({K} AS BIGINT) AS top_k, any_value(md5(whole)) AS chat, CAST(any_value(start) AS BIGINT) AS start, CAST(any_value(n) AS BIGINT) AS n,
 CAST(sum(id) AS BIGINT) AS ids, CAST(sum(CASE WHEN id % 2 = 1 THEN id ELSE id + 1 END) AS BIGINT) AS candidates, CAST(2 * count(*) AS INT) AS empty_slots, CAST(count(*) FILTER (id % 2 = 1) AS INT) AS inside, round(sum(-1.0 / (1 + id % 5)), 6) AS best, any_value(sha256('chat')) AS template,
 md5(concat_ws('|', string_agg(id::VARCHAR, ',' ORDER BY o), string_agg((CASE WHEN id % 2 = 1 THEN id ELSE id + 1 END) || ':-:-', ',' ORDER BY o), string_agg('c:?:', ',' ORDER BY o), string_agg(round(-1000000.0 / (1 + id % 5))::BIGINT || ':-3000000:-', ',' ORDER BY o), string_agg(CASE WHEN id % 2 = 1 THEN 'true' ELSE 'false' END, ',' ORDER BY o))) AS arrays FROM i GROUP BY conv_id""")
def soft_label_records(spark, sf):
    r = soft_labels(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.transform("topk_token_ids", lambda x: F.get(x, F.lit(0)).cast("long"))
    empty = F.aggregate(F.transform("topk_token_ids", lambda x: F.size(F.filter(x, lambda i: i.isNull()))), F.lit(0), lambda s, x: s + x)
    best = F.aggregate(F.transform("topk_logprobs", lambda x: F.get(x, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    return r.select(
        "example_index", "source_path", "teacher_model", "top_k", F.md5("full_chat_text").alias("chat"), F.col("assistant_token_start").alias("start"), F.col("assistant_token_count").alias("n"), total(F.transform("assistant_token_ids", lambda i: i.cast("long"))).alias("ids"),
        total(first).alias("candidates"), empty.alias("empty_slots"), F.size(F.filter("hard_label_in_topk", lambda x: x)).alias("inside"), F.round(best, 6).alias("best"), F.col("chat_template_fingerprint").alias("template"),
        digest("assistant_token_ids", "topk_token_ids", "topk_token_text", "topk_logprobs", "hard_label_in_topk", schema=r.schema).alias("arrays"),
    )


def digest(*names: str, schema) -> Column:
    """md5 of whole arrays as text: entries by comma, those of inner arrays by colon, null as -, floats in millionths."""

    def shown(c: Column, kind) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(c, lambda x: shown(x, kind.elementType)), ":")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(c < -1e29, "least").otherwise(F.round(c.cast("double") * 1e6).cast("long").cast("string"))
        return F.coalesce(c.cast("string"), F.lit("-"))

    entries = lambda kind: lambda x: shown(x, kind)
    return F.md5(F.concat_ws("|", *(F.array_join(F.transform(n, entries(schema[n].dataType.elementType)), ",") for n in names)))


def kd_rows(spark: SparkSession, sf: str) -> DataFrame:
    made = soft_labels(spark, sf)
    return kd.kd_records(scoring.once(made, **{c: F.col(c) for c in made.columns}, input_ids=text.chars(F.col("full_chat_text"))))


@query(f"""WITH {_CHATS} SELECT conv_id AS example_index, CAST(any_value(length(whole)) AS INT) AS n_ids, CAST(any_value(start) AS INT) AS assistant_start, CAST(any_value(n) AS INT) AS assistant_len, CAST(count(*) AS INT) AS valid, CAST(2 * count(*) AS INT) AS zeros,
 CAST(count(*) AS INT) AS least, md5(concat_ws('|', any_value(input), string_agg(id::VARCHAR, ',' ORDER BY o), string_agg((CASE WHEN id % 2 = 1 THEN id ELSE id + 1 END) || ':0:0', ',' ORDER BY o),
 string_agg(round(-1000000.0 / (1 + id % 5))::BIGINT || ':-3000000:least', ',' ORDER BY o), string_agg('true:false:false', ',' ORDER BY o), string_agg(CASE WHEN id % 2 = 1 THEN 'true' ELSE 'false' END, ',' ORDER BY o))) AS arrays
 FROM i JOIN (SELECT conv_id, array_to_string(list_transform(range(length(whole)), lambda j: unicode(whole[j + 1])), ',') AS input FROM g) USING (conv_id) GROUP BY conv_id""")
def kd_records(spark, sf):
    count = lambda c, f: F.aggregate(F.transform(c, lambda x: F.size(F.filter(x, f))), F.lit(0), lambda s, x: s + x)
    rows = kd_rows(spark, sf)
    arrays = digest("input_ids", "gold_ids", "topk_ids", "topk_logprobs", "topk_valid_mask", "hard_label_in_topk", schema=rows.schema)
    return rows.select(arrays.alias("arrays"), "example_index", F.size("input_ids").alias("n_ids"), "assistant_start", "assistant_len", count("topk_valid_mask", lambda v: v).alias("valid"), count("topk_ids", lambda i: i == 0).alias("zeros"), count("topk_logprobs", lambda p: p < -1e29).alias("least"))


@query("SELECT conv_id AS example_index, unnest(CASE conv_id % 4 WHEN 1 THEN ['gold'] WHEN 2 THEN ['start', 'gold'] WHEN 3 THEN ['width'] ELSE [] END) AS rule FROM (SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn <> c.turn))")
def kd_violations(spark, sf):
    r, which = kd_rows(spark, sf), F.col("example_index") % 4
    wrong = r.withColumn("gold_ids", F.when(which == 1, F.transform("gold_ids", lambda i: i + 1)).otherwise(F.col("gold_ids")))
    wrong = wrong.withColumn("assistant_start", F.when(which == 2, 0).otherwise(F.col("assistant_start")))
    wrong = wrong.withColumn("topk_ids", F.when(which == 3, F.transform("topk_ids", lambda x: F.slice(x, 1, 2))).otherwise(F.col("topk_ids")))
    return kd.violations(wrong, K)


@query(f"WITH {_CHATS}, e AS (SELECT DISTINCT conv_id, conv_id % 10 AS f FROM i) SELECT CAST(conv_id // 8 AS BIGINT) AS batch, count(*) FILTER (f = 3) AS bad_width, count(*) FILTER (f = 5) AS empty_span, count(*) FILTER (f = 7) AS bad_span FROM e GROUP BY 1 HAVING bad_width + empty_span + bad_span > 0")
def batch_faults(spark, sf):
    r, f = kd_rows(spark, sf).withColumn("batch", kd.batch_of(F.col("example_index"), 8)), F.col("example_index") % 10
    wrong = r.withColumn("topk_ids", F.when(f == 3, F.transform("topk_ids", lambda x: F.slice(x, 1, 1))).otherwise(F.col("topk_ids")))
    wrong = wrong.withColumn("assistant_len", F.when(f == 5, 0).otherwise(F.col("assistant_len"))).withColumn("assistant_start", F.when(f == 7, 0).otherwise(F.col("assistant_start")))
    return checks.batch_faults(wrong, "batch", K)


@query(f"""WITH {_CHATS}, e AS (SELECT conv_id, any_value(whole) AS whole, any_value(start) AS start, any_value(n) AS n, any_value(length(whole)) AS t, sum(id) AS s FROM i GROUP BY 1),
w AS (SELECT *, max(t) OVER p AS wt, max(n) OVER p AS wn FROM e WINDOW p AS (PARTITION BY conv_id // 8))
SELECT conv_id AS example_index, CAST(wt AS INT) AS width, CAST(wn AS INT) AS span_width, CAST(t AS INT) AS attended, CAST(s AS BIGINT) AS label_sum, CAST(wt - n AS INT) AS ignored, CAST(n AS INT) AS in_span, CAST(n AS INT) AS valid, CAST({K} * wn - n AS INT) AS masked,
 md5(concat_ws('|', array_to_string(list_transform(range(wt), lambda j: CASE WHEN j < t THEN unicode(whole[j + 1]) ELSE 0 END), ','), array_to_string(list_transform(range(wt), lambda j: CASE WHEN j < t THEN 1 ELSE 0 END), ','),
  array_to_string(list_transform(range(wt), lambda j: CASE WHEN j >= start AND j < t THEN unicode(whole[j + 1]) ELSE -100 END), ','), array_to_string(list_transform(range(wn), lambda j: CASE WHEN j < n THEN unicode(whole[start + j + 1]) ELSE 0 END), ','),
  array_to_string(list_transform(range(wn), lambda j: CASE WHEN j >= n THEN '0:0:0' WHEN unicode(whole[start + j + 1]) % 2 = 1 THEN unicode(whole[start + j + 1]) || ':0:0' ELSE unicode(whole[start + j + 1]) + 1 || ':0:0' END), ','),
  array_to_string(list_transform(range(wn), lambda j: CASE WHEN j < n THEN round(-1000000.0 / (1 + unicode(whole[start + j + 1]) % 5))::BIGINT || ':least:least' ELSE 'least:least:least' END), ','),
  array_to_string(list_transform(range(wn), lambda j: CASE WHEN j < n THEN 'true:false:false' ELSE 'false:false:false' END), ','), array_to_string(list_transform(range(wn), lambda j: CASE WHEN j < n THEN 'true' ELSE 'false' END), ','))) AS arrays FROM w""")
def training_batch(spark, sf):
    b = kd.training_batch(kd_rows(spark, sf).withColumn("batch", kd.batch_of(F.col("example_index"), 8)), "batch", 0, K)
    inner = lambda c, f: F.aggregate(F.transform(c, lambda x: F.size(F.filter(x, f))), F.lit(0), lambda s, x: s + x)
    good = F.filter("labels", lambda x: x != kd.IGNORED)
    arrays = digest("input_ids", "attention_mask", "labels", "gold_ids", "topk_ids", "topk_logprobs", "topk_valid", "span_mask", schema=b.schema)
    return scoring.once(b, **{c: F.col(c) for c in b.columns}).select(
        arrays.alias("arrays"), "example_index", F.size("input_ids").alias("width"), F.size("gold_ids").alias("span_width"), F.size(F.filter("attention_mask", lambda x: x == 1)).alias("attended"),
        F.aggregate(F.transform(good, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("label_sum"), F.size(F.filter("labels", lambda x: x == kd.IGNORED)).alias("ignored"),
        F.size(F.filter("span_mask", lambda x: x)).alias("in_span"), inner("topk_valid", lambda v: v).alias("valid"), inner("topk_logprobs", lambda p: p < -1e29).alias("masked"),
    )


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1")
def render_equality(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("a", F.col("text")).withColumn("b", F.when(F.col("turn") % 2 == 1, F.concat(F.col("text"), F.lit(" "))).otherwise(F.col("text")))
    return checks.differing(rows, "a", "b", "conv_id").select("conv_id", "turn")


# --- distillation from a cached teacher --------------------------------------------------------


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """API answers from embeddings: a step per entry, that of every fifth without a logprob."""
    e = table(spark, sf, "embeddings")
    step = lambda z, i: F.struct(
        F.concat(F.lit("t"), i.cast("string")).alias("token"), F.when(i % 5 != 4, -F.abs(z.cast("double"))).alias("logprob"),
        F.array(F.struct(F.lit("a\n").alias("token"), (-F.abs(z.cast("double"))).alias("logprob")), F.struct(F.lit("").alias("token"), F.when(i % 2 == 0, F.lit(-2.0)).alias("logprob"))).alias("top_logprobs"),
    )
    return e.select("vec_id", F.transform("embedding", step).alias("steps"))


_ENTRIES = "e AS (SELECT vec_id, CAST(i AS INT) AS position, -abs(CAST(embedding[i + 1] AS DOUBLE)) AS logprob FROM embeddings, unnest(range(len(embedding))) u(i)), s AS (SELECT * FROM e WHERE position % 5 <> 4)"


@query(f"WITH {_ENTRIES} SELECT vec_id, position, 't' || position AS token, round(logprob, 6) AS logprob, round(exp(logprob), 6) AS prob, CAST(CASE WHEN position % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_top FROM s")
def logprob_steps(spark, sf):
    return softlabel.logprob_steps(steps(spark, sf), ["vec_id"]).select("vec_id", "position", "token", F.round("logprob", 6).alias("logprob"), F.round("prob", 6).alias("prob"), F.size("top_candidates").alias("n_top"))


@query(f"""WITH {_ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY position) AS r FROM s)
SELECT vec_id, position, 't' || position AS teacher_token, round(exp(logprob), 6) AS teacher_prob, printf('a\\n (%.4f)', exp(logprob)) || CASE WHEN position % 2 = 0 THEN printf(' | <empty> (%.4f)', exp(-2.0)) ELSE '' END AS top_candidates FROM n WHERE r <= 20""")
def teacher_preview(spark, sf):
    return softlabel.preview(softlabel.logprob_steps(steps(spark, sf), ["vec_id"]), ["vec_id"])


CONTENT = """CASE event_id % 5 WHEN 0 THEN concat('"', event_type, '"') WHEN 1 THEN concat('["a", {"type": "text", "text": "', event_type, '"}, {"type": "image", "content": "b"}, {"type": "text", "text": 5}, 7]')
 WHEN 2 THEN concat('[{"type": "output_text", "text": "x"}, {"content": ', event_id, '}, {"type": "other", "text": "no", "content": "yes"}]') WHEN 3 THEN concat('', event_id) ELSE '[]' END"""


@query(f"""WITH c AS (SELECT event_id, CAST({CONTENT} AS JSON) AS j FROM events),
p AS (SELECT event_id, i, j -> ('$[' || i || ']') AS part FROM c, unnest(range(json_array_length(j)::BIGINT)) u(i) WHERE json_type(j) = 'ARRAY'),
t AS (SELECT event_id, string_agg(CASE WHEN json_type(part) = 'VARCHAR' THEN part ->> '$' WHEN (part ->> '$.type') IN ('text', 'output_text') AND json_type(part, '$.text') = 'VARCHAR' THEN part ->> '$.text'
  WHEN json_type(part, '$.content') = 'VARCHAR' THEN part ->> '$.content' ELSE '' END, '' ORDER BY i) AS joined FROM p GROUP BY 1)
SELECT event_id, CASE json_type(j) WHEN 'VARCHAR' THEN j ->> '$' WHEN 'ARRAY' THEN coalesce(joined, '') ELSE CAST(j AS VARCHAR) END AS message FROM c LEFT JOIN t USING (event_id)""")
def message_text(spark, sf):
    return table(spark, sf, "events").select("event_id", F.parse_json(F.expr(CONTENT)).alias("c")).select("event_id", text.message_text(F.col("c")).alias("message"))


def distilled(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of conversations: the last turn is both answers; at every even step of it the teacher
    gives the id itself twice (0.25 each) and the next id (0.25)."""
    c = spans(spark, sf).filter("span.start > 0")
    rows = c.select(F.col("conv_id").alias("_sample_id"), F.slice("ids", F.lit(1), F.col("span.start")).alias("prompt_ids"), F.col("ids").alias("hard_ids"), F.col("ids").alias("soft_ids"), F.col("span.ids").alias("answer"))
    told = rows.select("_sample_id", F.posexplode("answer").alias("step", "id")).filter("step % 2 = 0")
    mass = told.select("_sample_id", "step", F.explode(F.array("id", "id", F.col("id") + 1)).alias("token_id"), F.lit(0.25).alias("prob"))
    return distill.distillation_examples(rows, kd.merged_candidates(mass, ["_sample_id", "step"], 2), "_sample_id", 2, 700)


_DISTILLED = f"""WITH {_CHATS}, d AS (SELECT conv_id, any_value(whole) AS whole, any_value(length(whole)) AS t, any_value(start) AS start FROM i GROUP BY 1), l AS (SELECT *, least(t, 700) AS u FROM d),
m AS (SELECT conv_id, count(*) AS n, sum(id) AS s FROM i WHERE (o - start) % 2 = 0 AND o < 700 GROUP BY 1)"""


@query(_DISTILLED + """ SELECT conv_id AS _sample_id, CAST(u AS INT) AS n_ids, CAST(least(start, u) AS INT) AS ignored, CAST(greatest(u - 1, 0) AS INT) AS n_targets, CAST(coalesce(n, 0) AS INT) AS selected, CAST(coalesce(2 * s + n, 0) AS BIGINT) AS ids,
 round(coalesce(n, 0) * 1.0, 6) AS mass, round(coalesce(n, 0) * 2 / 3.0, 4) AS top,
 md5(concat_ws('|', array_to_string(list_transform(range(u), lambda j: unicode(whole[j + 1])), ','), array_to_string(list_transform(range(u), lambda j: CASE WHEN j < start THEN -100 ELSE unicode(whole[j + 1]) END), ','),
  array_to_string(list_transform(range(u - 1), lambda j: CASE WHEN j + 1 >= start AND start <= u AND (j + 1 - start) % 2 = 0 THEN unicode(whole[j + 2]) || ':' || unicode(whole[j + 2]) + 1 ELSE '-1:-1' END), ','),
  array_to_string(list_transform(range(u - 1), lambda j: CASE WHEN j + 1 >= start AND start <= u AND (j + 1 - start) % 2 = 0 THEN '666667:333333' ELSE '0:0' END), ','))) AS arrays FROM l LEFT JOIN m USING (conv_id)""")
def distillation_examples(spark, sf):
    flat = F.flatten("soft_target_ids")
    total = lambda c, zero: F.aggregate(c, zero, lambda s, x: s + x)
    rows = distilled(spark, sf)
    arrays = digest("soft_input_ids", "hard_labels", "soft_target_ids", "soft_target_probs", schema=rows.schema)
    return rows.select(
        arrays.alias("arrays"), "_sample_id", F.size("soft_input_ids").alias("n_ids"), F.size(F.filter("hard_labels", lambda x: x == kd.IGNORED)).alias("ignored"), F.size("soft_target_ids").alias("n_targets"), total("soft_target_mask", F.lit(0)).alias("selected"),
        total(F.transform(F.filter(flat, lambda i: i >= 0), lambda i: i.cast("long")), F.lit(0).cast("long")).alias("ids"), F.round(total(F.flatten("soft_target_probs"), F.lit(0.0)), 6).alias("mass"),
        F.round(total(F.transform("soft_target_probs", lambda p: F.get(p, F.lit(0))), F.lit(0.0)), 4).alias("top"),
    )


@query(_DISTILLED + """, w AS (SELECT *, max(u) OVER (PARTITION BY conv_id // 8) AS wide FROM l)
SELECT conv_id AS _sample_id, CAST(wide AS INT) AS width, CAST(u AS INT) AS attended, CAST(wide - u + least(start, u) AS INT) AS ignored, CAST(wide - 1 AS INT) AS n_targets, CAST(2 * (wide - 1 - coalesce(n, 0)) AS INT) AS padded, round(coalesce(n, 0) * 1.0, 6) AS mass FROM w LEFT JOIN m USING (conv_id)""")
def distillation_batch(spark, sf):
    b = kd.distillation_batch(distilled(spark, sf).withColumn("batch", kd.batch_of(F.col("_sample_id"), 8)), "batch", 0, 2)
    return b.select("_sample_id", F.size("hard_input_ids").alias("width"), F.size(F.filter("soft_attention_mask", lambda x: x == 1)).alias("attended"), F.size(F.filter("hard_labels", lambda x: x == kd.IGNORED)).alias("ignored"), F.size("soft_target_mask").alias("n_targets"),
                    F.size(F.filter(F.flatten("soft_target_ids"), lambda i: i == -1)).alias("padded"), F.round(F.aggregate(F.flatten("soft_target_probs"), F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))


_LOGITS = "e AS (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS z FROM embeddings, unnest(range(len(embedding))) u(i))"


@query(f"""WITH {_LOGITS}, n AS (SELECT vec_id, label, max(z / 2) + ln(sum(exp(z / 2 - m / 2))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM e) GROUP BY 1, 2),
s AS (SELECT n.vec_id, n.label, -sum((e.z / 2 - lse) * (CASE e.i WHEN 3 THEN 0.5 ELSE 0.25 END)) / 0.75 AS s FROM n JOIN e ON e.vec_id = n.vec_id AND e.i IN (3, 5) GROUP BY 1, 2)
SELECT label, round(coalesce(avg(CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 0 ELSE s END), 0) * 4, 6) AS soft_loss FROM s GROUP BY label""")
def cached_soft_loss(spark, sf):
    """Positions: every third isn't selected, every third has no candidate, the rest have two and an empty slot."""
    which = F.col("vec_id") % 3
    ids = F.when(which == 2, F.array(F.lit(3), F.lit(5), F.lit(-1))).otherwise(F.array(F.lit(-1), F.lit(-1), F.lit(-1)))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"), ids.alias("target_ids"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.9)).alias("target_probs"), (which != 0).alias("selected"))
    return kd.cached_soft_loss(rows, ["label"], 2.0).select("label", F.round("soft_loss", 6).alias("soft_loss"))


@query(f"""WITH {_LOGITS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) AS r FROM e) WHERE r <= 8),
n AS (SELECT vec_id, label, max(z / 2) + ln(sum(exp(z / 2 - m / 2))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM e) GROUP BY 1, 2),
u AS (SELECT vec_id, i, z, r, exp(z) AS w FROM t WHERE r % 2 = 1 AND vec_id % 4 <> 0 AND i < 60),
s AS (SELECT n.vec_id, n.label, coalesce(-sum(w * (u.z / 2 - lse)) / sum(w), 0) AS soft FROM n LEFT JOIN u ON u.vec_id = n.vec_id GROUP BY 1, 2),
f AS (SELECT vec_id, max(CASE WHEN i = label OR (label = 0 AND i >= 64) THEN 1 ELSE 0 END) AS inside FROM t GROUP BY 1)
SELECT label, round(avg(soft) * 4, 6) AS soft_loss, round(avg(inside), 6) AS frac_hard_in_topk FROM s JOIN f USING (vec_id) GROUP BY label""")
def masked_loss(spark, sf):
    """Candidates at even places and all of every fourth vector have no id though they have a logprob, and ids from 60 on aren't allowed either."""
    p = positions(spark, sf)
    valid = F.transform("topk_ids", lambda i, k: (k % 2 == 0) & (F.col("vec_id") % 4 != 0) & (i < 60))
    out = kd.losses(p.withColumn("topk_valid_mask", valid), ["label"], 1.0, 2.0, valid="topk_valid_mask")
    return out.select("label", F.round("soft_loss", 6).alias("soft_loss"), F.round("frac_hard_in_topk", 6).alias("frac_hard_in_topk"))


# --- keys, values, history ---------------------------------------------------------------------


@query("SELECT o_orderkey, matched FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS matched FROM orders)")
def nested_values(spark, sf):
    pairs = [('[1, "a", null]', '[1.0, " A ", ""]'), ("[1, 2]", "[1]"), ("[1, 2]", "[2, 1]"), ('{"a": {"b": [1]}}', '{"A": {"B": ["1"]}, "c": 0}'), ('{"a": null}', "{}"), ('{"a": "x"}', '["x"]')]
    pick = lambda j: F.element_at(F.array(*(F.lit(p[j]) for p in pairs)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", pick(0).alias("a"), pick(1).alias("b"))
    return scoring.compare_json(rows, ["o_orderkey"], [("a", "b")]).select("o_orderkey", "v.matched")


@query("SELECT event_id, json_extract_string(j, '$.\"' || list_filter(json_keys(j), lambda q: starts_with(regexp_replace(strip_accents(lower(q)), '[^a-z]', '', 'g'), 'total'))[1] || '\"') AS value FROM (SELECT event_id, '{\"' || CASE event_id % 3 WHEN 0 THEN 'Tötal HT' WHEN 1 THEN 'total_ttc' ELSE 'other' END || '\": ' || event_id || '}' AS j FROM events)")
def value_by_key(spark, sf):
    j = F.expr("""concat('{"', CASE event_id % 3 WHEN 0 THEN 'Tötal HT' WHEN 1 THEN 'total_ttc' ELSE 'other' END, '": ', event_id, '}')""")
    parsed = scoring.parse_column(table(spark, sf, "events").select("event_id", j.alias("j")), "j")
    return parsed.select("event_id", scoring.value_by_key(F.col("parsed.fields"), F.lit("total_ht")).alias("value"))


@query("SELECT event_id, 'ab:' || event_id || ',c:' || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'null' END AS keys FROM events")
def normalized_keys(spark, sf):
    j = F.expr("""concat('{"A b": 1, "c": ', CASE WHEN event_id % 2 = 0 THEN '"x"' ELSE 'null' END, ', "á_B": ', event_id, '}')""")
    parsed = scoring.parse_column(table(spark, sf, "events").select("event_id", j.alias("j")), "j")
    made = parsed.select("event_id", F.map_entries(scoring.normalized_keys(F.col("parsed.fields"))).alias("m"))
    return made.select("event_id", F.array_join(F.transform(F.array_sort("m"), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",").alias("keys"))


@query(f"WITH d AS (SELECT {_STEP} AS step, count(*) AS n, avg(value) AS l FROM events GROUP BY 1) SELECT step, n, CASE WHEN step % 2 = 0 THEN round(l, 6) END AS loss FROM d")
def pending_loss(spark, sf):
    d = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("loss"))
    return history.with_pending_loss(d.select("step", "n"), d.filter("step % 2 = 0").select("step", "loss"))


@query(f"SELECT event_id, {_STEP} AS step FROM events WHERE {_STEP} % 3 <> 0")
def unlogged_steps(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd").cast("long").alias("step"))
    done = e.filter("step % 3 = 0").select(F.col("step").cast("string").alias("step")).union(spark.createDataFrame([("none",)], "step string"))
    return history.unlogged(e, done).select("event_id", "step")


@query("SELECT d.doc_id, 'both' AS kind FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'alone' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def generation_join(spark, sf):
    docs, made = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    both, rest = scoring.join_generations(docs, made, ["doc_id"])
    return both.select("doc_id", F.lit("both").alias("kind")).union(rest.select("doc_id", F.lit("alone")))


@query("SELECT vec_id AS example_index, label, label * 2 AS answer FROM embeddings")
def teacher_join(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("example_index"), "label")
    return softlabel.with_teacher(e, e.select("example_index", (F.col("label") * 2).alias("answer"))).select("example_index", "label", "answer")


@query(f"SELECT * FROM ({_SHARDS}) WHERE shard_index % 3 <> 0 OR shard_index % 2 = 0")
def resume_with_files(spark, sf):
    path = paths.fresh(spark, "resumed")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("example_index"))
    plan = softlabel.shard_plan(docs, "example_index", 64)
    writers.shards(docs.filter("example_index div 64 % 2 = 1"), path, 64)
    left = softlabel.open_shards(plan, plan.filter("shard_index % 3 = 0"), readers.shard_files(spark, path))
    return left.select(*(F.col(c).cast("int").alias(c) for c in ("shard_index", "example_start", "example_end", "row_count")))


@query("SELECT o_orderkey, unnest(CASE o_orderkey % 5 WHEN 0 THEN ['top_k'] WHEN 1 THEN ['alpha', 'overwrite and resume'] WHEN 2 THEN ['temperature'] WHEN 3 THEN ['batch_size', 'shard_size'] ELSE [] END) AS fault FROM orders")
def refused_settings(spark, sf):
    which = F.col("o_orderkey") % 5
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(which == 0, 0).otherwise(8).alias("top_k"), F.when(which == 3, -1).otherwise(64).alias("shard_size"), F.when(which == 3, 0).otherwise(4).alias("batch_size"),
        F.when(which == 1, 1.5).otherwise(1.0).alias("alpha"), F.when(which == 2, 0.0).otherwise(2.0).alias("temperature"), (which == 1).alias("overwrite"), F.col("o_orderkey").isNotNull().alias("resume"),
    )
    return rows.select("o_orderkey", F.explode(checks.setting_faults(F.struct(*rows.columns[1:]))).alias("fault"))


# --- subsets -----------------------------------------------------------------------------------

#: The corpus rules of the volume subsets, and instructions that fit them.
RULES = [("vehicle", [["VEHICLE automotive documents"]]), ("order", [["numero_expedition"], ["numero_commande"]]), ("invoice", [['"recipient"', '"total_ht"']])]
ASKED = """CASE o_orderkey % 8 WHEN 0 THEN 'VEHICLE automotive documents' WHEN 1 THEN 'VEHICLE automotive documents: numero_commande' WHEN 2 THEN 'numero_expedition' WHEN 3 THEN 'x numero_commande y'
 WHEN 4 THEN 'give "recipient" and "total_ht"' WHEN 5 THEN 'give "recipient"' WHEN 6 THEN '"total_ht" only' ELSE 'give "total_ht", "recipient"' END"""
ANSWERED = "CASE o_orderkey % 5 WHEN 0 THEN '{\"category\": \"car\"}' WHEN 1 THEN '{\"category\": \"truck\"}' WHEN 2 THEN '{}' WHEN 3 THEN 'bad' ELSE '{\"category\": \"bus\", \"n\": 1}' END"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(ASKED).alias("input"), F.expr(ANSWERED).alias("output"))
    return rows.select("o_orderkey", text.corpus_of(F.col("input"), RULES, "unknown").alias("corpus"), text.category_of(F.col("output")).alias("category"))


_ASKED = f"""q AS (SELECT o_orderkey, {ASKED} AS i, {ANSWERED} AS o FROM orders),
b AS (SELECT o_orderkey, CASE WHEN contains(i, 'VEHICLE automotive documents') THEN 'vehicle' WHEN contains(i, 'numero_expedition') OR contains(i, 'numero_commande') THEN 'order'
  WHEN contains(i, '"recipient"') AND contains(i, '"total_ht"') THEN 'invoice' ELSE 'unknown' END AS corpus, CASE WHEN json_valid(o) THEN coalesce(json_extract_string(o, '$.category'), 'autre') ELSE 'autre' END AS category FROM q),
t AS (SELECT o_orderkey, corpus, CASE WHEN corpus = 'vehicle' THEN category ELSE '' END AS category FROM b)"""
SIZES = [50, 100, 500]
_SHARES = """w AS (SELECT corpus, category, count(*) AS n FROM t GROUP BY 1, 2), z AS (SELECT unnest([50, 100, 500]) AS size),
c AS (SELECT size, corpus, sum(n) AS n FROM w, z GROUP BY 1, 2), c1 AS (SELECT *, (size * n) // sum(n) OVER (PARTITION BY size) AS fl, (size * n) % sum(n) OVER (PARTITION BY size) AS rest FROM c),
c2 AS (SELECT size, corpus, fl + CASE WHEN row_number() OVER (PARTITION BY size ORDER BY rest DESC, corpus) <= size - sum(fl) OVER (PARTITION BY size) THEN 1 ELSE 0 END AS take FROM c1),
v1 AS (SELECT size, category, (take * n) // sum(n) OVER (PARTITION BY size) AS fl, (take * n) % sum(n) OVER (PARTITION BY size) AS rest, take FROM c2 JOIN w USING (corpus) WHERE corpus = 'vehicle'),
v2 AS (SELECT size, 'vehicle' AS corpus, category, fl + CASE WHEN row_number() OVER (PARTITION BY size ORDER BY rest DESC, category) <= take - sum(fl) OVER (PARTITION BY size) THEN 1 ELSE 0 END AS take FROM v1),
a AS (SELECT * FROM v2 UNION ALL SELECT size, corpus, '', take FROM c2 WHERE corpus <> 'vehicle')"""


@query(f"WITH {_ASKED} SELECT o_orderkey, corpus, category FROM t")
def stratum_keys(spark, sf):
    return asked(spark, sf).select("o_orderkey", "corpus", F.when(F.col("corpus") == "vehicle", F.col("category")).otherwise("").alias("category"))


@query(f"WITH {_ASKED}, {_SHARES} SELECT CAST(size AS INT) AS size, corpus, category, CAST(take AS BIGINT) AS take FROM a")
def subset_allocation(spark, sf):
    rows = asked(spark, sf).withColumn("category", F.when(F.col("corpus") == "vehicle", F.col("category")).otherwise(""))
    return sample.allocate_subsets(sample.strata(rows, ["corpus", "category"]), SIZES, "corpus", "category", "vehicle")


@query(f"""WITH {_ASKED}, {_SHARES}, p AS (SELECT *, row_number() OVER (PARTITION BY corpus, category ORDER BY md5('20260419-' || o_orderkey), o_orderkey) AS r FROM t)
SELECT CAST(size AS INT) AS size, o_orderkey, corpus, category FROM p JOIN a USING (corpus, category) WHERE r <= take""")
def volume_subsets(spark, sf):
    return sample.nested_subsets(asked(spark, sf), "o_orderkey", "corpus", "category", "vehicle", SIZES, 20260419).select("size", "o_orderkey", "corpus", "category")


@query(f"SELECT o_orderkey AS index, CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN length(t) > 40 THEN left(t, 37) || '...' ELSE t END AS generated_snippet, CASE WHEN length(g) > 40 THEN left(g, 37) || '...' ELSE g END AS expected_snippet FROM (SELECT o_orderkey, {PRED} AS t, {GT} AS g FROM orders ORDER BY o_orderkey LIMIT 3)")
def sample_preview(spark, sf):
    rows = orders(spark, sf, gt=GT, pred=PRED).withColumn("sample_id", F.col("o_orderkey").cast("string"))
    return scoring.sample_generations(rows, "o_orderkey", ["sample_id"], length=40)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def head_rows(spark, sf):
    return sample.head(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 25)


# --- streams -----------------------------------------------------------------------------------


@query(_STEPS + """, m AS (SELECT step, coalesce(corpus, 'overall') AS corpus, CAST(sum(correct) AS DOUBLE) AS matched_fields, CAST(count(*) FILTER (NOT valid) AS DOUBLE) AS parse_errors FROM q GROUP BY GROUPING SETS ((step, corpus), (step)))
SELECT step, corpus, unnest(['matched_fields', 'parse_errors']) AS metric, unnest([matched_fields, parse_errors]) AS value FROM m UNION ALL SELECT DISTINCT step, coalesce(corpus, 'overall'), 'loss', 0.5 FROM m WHERE step = 1""")
def scored_stream(spark, sf):
    """Three drops of generation files, the second with rows of a step that is scored already."""
    source, hist, mark = (paths.fresh(spark, n) for n in ("generations", "scores", "mark"))
    g, losses, new = generations(spark, sf), spark.createDataFrame([(1, 0.5)], "step long, loss double"), []
    for part in (g.filter("step = 0"), g.filter("step = 1").unionByName(g.filter("step = 0").limit(5)), g.filter("step = 2")):
        part.write.mode("append").json(source)
        inline.score_stream(spark, source, hist, mark, losses, lambda df, n: new.append(n)).awaitTermination()
    return inline.latest(spark, hist, len(new)).filter("metric in ('matched_fields', 'parse_errors', 'loss')")


@query("SELECT c_custkey AS _sample_id, upper(c_name) AS teacher_output FROM customer WHERE c_custkey % 2 = 1")
def teacher_backend(spark, sf):
    """Only what the cache lacks is asked for."""

    def ask(frames):
        for f in frames:
            yield f[["_sample_id"]].assign(teacher_output=f["c_name"].str.upper())

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("_sample_id"), "c_name")
    return inline.teacher_rows(c, c.filter("_sample_id % 2 = 0"), "_sample_id", ask, "_sample_id long, teacher_output string")


@query("SELECT c_custkey, 'http://h' || c_custkey || CASE WHEN c_custkey % 4 = 2 THEN '/x' ELSE '' END || '/v1/chat/completions' AS url FROM customer")
def teacher_urls(spark, sf):
    tails = F.element_at(F.array(*map(F.lit, ("/", "/v1/", "/x/v1/chat/completions", ""))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", teacher.completions_url(F.concat(F.lit("http://h"), F.col("c_custkey").cast("string"), tails)).alias("url"))
