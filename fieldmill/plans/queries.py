"""Queries over whole driver tables, each with its DuckDB SQL where SQL can express it.

The tables hold no model outputs, so numbers, dates, JSON texts and predictions are derived from
them by expressions that both engines read alike. Floats are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfix, text, values
from ..functions.similarity import closest_key, similarity
from ..operators import checks, distill, history, kd, sample, scoring, softlabel
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- derived inputs: SQL that both engines read ------------------------------------------------

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
WHOLE, PART = f"CAST(floor({CENTS} / 100) AS BIGINT)", f"lpad(CAST({CENTS} % 100 AS STRING), 2, '0')"
THOUSANDS = f"CASE WHEN {WHOLE} >= 1000 THEN concat(CAST(CAST(floor({WHOLE} / 1000) AS BIGINT) AS STRING), '{{sep}}', lpad(CAST({WHOLE} % 1000 AS STRING), 3, '0')) ELSE CAST({WHOLE} AS STRING) END"
PLAIN = f"concat(CAST({WHOLE} AS STRING), '.', {PART})"
PRICE = f"""CASE o_orderkey % 6 WHEN 0 THEN {PLAIN} WHEN 1 THEN concat({THOUSANDS.format(sep=' ')}, ',', {PART}, ' €')
 WHEN 2 THEN concat({THOUSANDS.format(sep=',')}, '.', {PART}) WHEN 3 THEN concat('$', {THOUSANDS.format(sep='.')}, ',', {PART})
 WHEN 4 THEN concat('about ', CAST({WHOLE} AS STRING), ' units') ELSE 'n/a' END"""
DAY, MONTH, YEAR = ("CAST(day(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS STRING)")
DATE = f"concat(lpad({DAY}, 2, '0'), '/', lpad({MONTH}, 2, '0'), '/', {YEAR})"
DATES = f"""CASE o_orderkey % 5 WHEN 0 THEN {DATE} WHEN 1 THEN concat({DAY}, '-', {MONTH}, '-', right({YEAR}, 2))
 WHEN 2 THEN concat(' ', {DAY}, '.', {MONTH}, '.', {YEAR}, ' noon') WHEN 3 THEN concat({YEAR}, '-', {MONTH}, '-', {DAY}) ELSE '45/13/2020' END"""
GT = f"concat('{{\"order\": \"', CAST(o_orderkey AS STRING), '\", \"total\": ', {PLAIN}, ', \"date\": \"', {DATE}, '\", \"status\": \"', o_orderstatus, '\", \"note\": null}}')"
PRED = f"""CASE o_orderkey % 6
 WHEN 0 THEN {GT}
 WHEN 1 THEN concat('{{\"order\": \"', CAST(o_orderkey AS STRING), '\", \"Tötal\": ', {PLAIN}, ', \"DATE\": \"', {DAY}, '-', {MONTH}, '-', right({YEAR}, 2), '\", \"status\": \"', o_orderstatus, '\"}}')
 WHEN 2 THEN concat('<think>hm</think> Here: {{\"order\": \"', CAST(o_orderkey AS STRING), '\", \"total\": ', {PLAIN}, ', \"status\": \"', o_orderstatus, '\"')
 WHEN 3 THEN concat('```json {{\"order\": \"x', CAST(o_orderkey AS STRING), '\", \"total\": 1.5, \"date\": \"', {DATE}, '\", \"status\": \"', o_orderstatus, '\",}} ```')
 WHEN 4 THEN 'no answer'
 ELSE concat('[', {GT}, ']') END"""


def orders(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", *(F.expr(v).alias(k) for k, v in columns.items()))


PROPS = """CASE event_id % 5 WHEN 0 THEN concat('Sure: ', props, ' done') WHEN 1 THEN concat('```json ', props, ' ```') WHEN 2 THEN concat('<think>a {b</think>  ', props)
 WHEN 3 THEN 'nothing' ELSE props END"""
DAMAGED = "CASE event_id % 5 WHEN 0 THEN replace(props, '}', ',}') WHEN 1 THEN replace(props, '}', '') WHEN 2 THEN concat('{\"a\": [1, 2, ], \"b\": \"', event_type) WHEN 3 THEN concat('{\"a\": [1, 2', ', {\"c\": 3]') ELSE props END"
LOGITS = "e AS (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS z FROM embeddings, unnest(range(len(embedding))) u(i))"
TOP = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) AS r FROM e) WHERE r <= 8)"


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """A position per vector: its entries are logits, its label the gold id, and the teacher's eight
    candidates have twice the logits as log-probabilities."""
    z = F.transform("embedding", lambda x: x.cast("double"))
    entry = F.transform(z, lambda x, i: F.struct((-x).alias("m"), i.cast("int").alias("id")))
    df = table(spark, sf, "embeddings").select("vec_id", "label", z.alias("logits"), F.slice(F.array_sort(entry), 1, 8).alias("top"))
    return df.select("vec_id", "label", F.col("label").alias("gold"), "logits", F.transform("top", lambda t: t["id"]).alias("topk_ids"), F.transform("top", lambda t: -2 * t["m"]).alias("topk_logprobs"))


# --- sampling ----------------------------------------------------------------------------------

_ALLOC = """w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
f AS (SELECT *, ({total} * n) // sum(n) OVER () AS fl, ({total} * n) % sum(n) OVER () AS rest FROM w),
a AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= {total} - sum(fl) OVER () THEN 1 ELSE 0 END AS take FROM f)"""
_SAMPLE = _ALLOC + """, p AS (SELECT d.doc_id, d.lang, take, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42-' || d.doc_id), d.doc_id) AS r FROM documents d JOIN a USING (lang))
SELECT doc_id, lang FROM p WHERE r <= take"""


@query("WITH " + _SAMPLE.format(total=100))
def stratified_sample(spark, sf):
    return sample.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100, 42)


@query("WITH " + _ALLOC.format(total=1000) + " SELECT lang, n, CAST(take AS BIGINT) AS take FROM a")
def largest_remainder(spark, sf):
    return sample.allocate(sample.strata(table(spark, sf, "documents"), ["lang"]), "lang", "n", F.lit(1000))


_NEST = " UNION ALL ".join(f"SELECT {n} AS size, doc_id FROM (WITH {_SAMPLE.format(total=n)})" for n in (50, 100, 150))


@query(f"""WITH m AS ({_NEST}) SELECT a.size AS small, CAST(count(*) AS INT) AS n_small, CAST(count(*) FILTER (b.doc_id IS NULL) AS INT) AS n_missing
 FROM m a LEFT JOIN m b ON b.doc_id = a.doc_id AND b.size = a.size + 50 WHERE a.size < 150 GROUP BY 1""")
def nested_subset_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = {n: sample.stratified_sample(docs, "lang", "doc_id", n, 42) for n in (50, 100, 150)}

    def count(a, b):
        lost = sample.not_nested(parts[a], parts[b], "doc_id").select("doc_id", F.lit(1).alias("lost"))
        return parts[a].join(lost, "doc_id", "left").agg(F.lit(a).alias("small"), F.count(F.lit(1)).cast("int").alias("n_small"), F.count("lost").cast("int").alias("n_missing"))

    return count(50, 100).union(count(100, 150))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7-' || doc_id) DESC, doc_id DESC) <= 100 THEN 'eval' ELSE 'train' END AS fold FROM documents")
def shuffle_split(spark, sf):
    return sample.split(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 7)


# --- text --------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS key FROM documents")
def normalize_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("key"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), '[^\\x00-\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def normalize_string(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_string(F.col("text"))).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS snippet FROM (SELECT doc_id, replace(text, chr(10), '\\n') AS t FROM documents)")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncated(F.col("text"), 80).alias("snippet"))


@query("SELECT conv_id, turn, CASE WHEN text = '' THEN '<empty>' ELSE replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') END AS shown FROM conversations")
def printable_token(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.printable_token(F.col("text")).alias("shown"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'rights reserved') THEN 'license' WHEN (contains(text, '|') AND contains(text, '-')) OR contains(text, ' | ') THEN 'table'
 WHEN contains(text, '!!') THEN 'loud' ELSE 'other' END AS corpus FROM documents""")
def corpus_rules(spark, sf):
    rules = [("license", [["rights reserved"]]), ("table", [["|", "-"], [" | "]]), ("loud", [["!!"]])]
    return table(spark, sf, "documents").select("doc_id", text.corpus_of(F.col("text"), rules, "other").alias("corpus"))


_CHAT = "'<|' || role || '|>' || coalesce(text, '')"


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query(f"SELECT conv_id, count(*) AS n, md5(string_agg({_CHAT}, chr(10) ORDER BY turn)) AS chat FROM conversations GROUP BY conv_id")
def chat_render(spark, sf):
    return conversations(spark, sf).select("conv_id", F.size("turns").cast("long").alias("n"), F.md5(text.chat(F.col("turns"))).alias("chat"))


@query(f"SELECT conv_id, turn, md5('<|system|>answer' || chr(10) || '<|user|>' || coalesce(text, '') || chr(10) || '<|assistant|>') AS prompt FROM conversations WHERE role = 'user'")
def prompt_render(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.md5(text.prompt(F.lit("answer"), F.coalesce("text", F.lit("")))).alias("prompt"))


_SPAN = f"""WITH c AS (SELECT conv_id, turn, {_CHAT} AS t, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
g AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS whole, coalesce(string_agg(CASE WHEN turn < last THEN t END, chr(10) ORDER BY turn), '') AS front FROM c GROUP BY conv_id)
SELECT conv_id, CAST(length(front) AS INT) AS start, CAST(length(whole) - length(front) AS INT) AS length{{more}} FROM g"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    c = scoring.once(conversations(spark, sf), ids=text.chars(text.chat(F.col("turns"))), _front=text.chars(text.chat(F.slice("turns", 1, F.size("turns") - 1))))
    return scoring.once(c, span=softlabel.assistant_span(F.col("ids"), F.col("_front"))).drop("_front")


@query(_SPAN.format(more=""))
def assistant_span(spark, sf):
    return spans(spark, sf).select("conv_id", "span.start", "span.length")


@query(_SPAN.format(more=", CAST(length(whole) AS INT) AS n_labels, CAST(length(front) AS INT) AS n_ignored"))
def span_labels(spark, sf):
    made = spans(spark, sf).withColumn("labels", kd.labels(F.col("ids"), F.col("span.start")))
    return made.select("conv_id", "span.start", "span.length", F.size("labels").alias("n_labels"), F.size(F.filter("labels", lambda x: x == kd.IGNORED)).alias("n_ignored"))


@query(_SPAN.format(more="").replace("CAST(length(front) AS INT) AS start, CAST(length(whole) - length(front) AS INT) AS length", "CAST(least(length(whole), 512) AS INT) AS n_ids, CAST(least(length(front), 512) AS INT) AS n_ignored"))
def hard_examples(spark, sf):
    made = spans(spark, sf).select("conv_id", F.col("ids").alias("hard_ids"), F.slice("ids", F.lit(1), F.col("span.start")).alias("prompt_ids"))
    out = distill.hard_examples(made, "conv_id", 512)
    return out.select("conv_id", F.size("hard_input_ids").alias("n_ids"), F.size(F.filter("hard_labels", lambda x: x == kd.IGNORED)).alias("n_ignored"))


# --- JSON --------------------------------------------------------------------------------------


TYPED = "concat('{\"z\": ', props, ', \"a\": [', event_id, '], \"m\": ', CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE '\"x\"' END, '}')"
_KIND = "CASE json_type(j, '$.m') WHEN 'NULL' THEN 'VOID' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(j, '$.m') END"


@query(f"SELECT event_id, array_to_string(json_keys(j), ',') AS keys, 'a:' || json_type(j, '$.a') || ',m:' || {_KIND} || ',z:' || json_type(j, '$.z') AS kinds FROM (SELECT event_id, {TYPED} AS j FROM events)")
def json_field(spark, sf):
    j = F.col("j")
    return table(spark, sf, "events").select("event_id", F.expr(TYPED).alias("j")).select("event_id", F.array_join(text.json_keys(j), ",").alias("keys"), F.array_join(F.transform(text.json_kinds(j), lambda k: F.concat(k["key"], F.lit(":"), k["kind"])), ",").alias("kinds"))


@query(f"SELECT event_id, {sql.candidate(PROPS)} AS candidate FROM events")
def json_candidate(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_candidate(F.expr(PROPS)).alias("candidate"))


@query(f"SELECT event_id, {sql.repaired(DAMAGED)} AS repaired FROM events")
def json_repair(spark, sf):
    return table(spark, sf, "events").select("event_id", jsonfix.repair(F.expr(DAMAGED)).alias("repaired"))


@query(f"""WITH o AS (SELECT event_type, {sql.candidate(DAMAGED)} AS c FROM events), f AS (SELECT *, {sql.repaired('c')} AS fixed FROM o),
p AS (SELECT event_type, CASE WHEN {sql.strict('c')} THEN json_type(c) = 'OBJECT' ELSE false END AS plain, CASE WHEN {sql.strict('c')} THEN false WHEN json_valid(fixed) THEN json_type(fixed) = 'OBJECT' ELSE false END AS fix FROM f)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT plain AND NOT fix) AS parse_errors, count(*) FILTER (plain OR fix) AS valid_json, count(*) FILTER (fix) AS repaired FROM p GROUP BY event_type""")
def parse_error_counts(spark, sf):
    parsed = scoring.parse_column(table(spark, sf, "events").select("event_type", F.expr(DAMAGED).alias("out")), "out")
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parsed.error").isNotNull()).alias("parse_errors"), F.count_if(F.col("parsed.error").isNull()).alias("valid_json"), F.count_if(F.col("parsed.used_repair") & F.col("parsed.error").isNull()).alias("repaired"))


# --- values ------------------------------------------------------------------------------------

@query(f"SELECT o_orderkey, {sql.number(PRICE)} AS number FROM orders")
def number_parse(spark, sf):
    return orders(spark, sf, t=PRICE).select("o_orderkey", values.extract_number(F.col("t")).alias("number"))


@query(f"SELECT o_orderkey, {sql.near(PRICE, PLAIN)} AS matched FROM orders")
def number_match(spark, sf):
    return orders(spark, sf, a=PRICE, b=PLAIN).select("o_orderkey", values.numbers_match(F.col("a"), F.col("b")).alias("matched"))


@query(f"SELECT o_orderkey, CAST({sql.date(DATES)} AS BIGINT) AS ymd FROM orders")
def date_parse(spark, sf):
    d = F.col("d")
    return orders(spark, sf, t=DATES).select("o_orderkey", values.parse_date(F.col("t")).alias("d")).select("o_orderkey", (d["year"] * 10000 + d["month"] * 100 + d["day"]).cast("long").alias("ymd"))


@query(f"SELECT o_orderkey, coalesce({sql.date(DATES)} = {sql.date(DATE)}, false) AS matched FROM orders")
def date_match(spark, sf):
    return orders(spark, sf, a=DATES, b=DATE).select("o_orderkey", values.dates_match(F.col("a"), F.col("b")).alias("matched"))


_COMPARED = f"""CASE o_orderkey % 7 WHEN 0 THEN {DATE} WHEN 1 THEN {PLAIN} WHEN 2 THEN o_orderpriority WHEN 3 THEN upper(concat(' ', o_orderpriority, ' é')) WHEN 4 THEN 'null' WHEN 5 THEN o_orderpriority ELSE 'x' END"""
_AGAINST = f"""CASE o_orderkey % 7 WHEN 0 THEN concat({DAY}, '.', {MONTH}, '.', right({YEAR}, 2)) WHEN 1 THEN concat({THOUSANDS.format(sep=' ')}, ',', {PART}) WHEN 2 THEN concat(o_orderpriority, ' ')
 WHEN 3 THEN lower(concat(o_orderpriority, '  E')) WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'y' END"""


@query(f"SELECT o_orderkey, m <> 'mismatch' AS matched, m AS match_type FROM (SELECT o_orderkey, {sql.verdict(_COMPARED, _AGAINST)} AS m FROM orders)")
def compare_values(spark, sf):
    return orders(spark, sf, a=_COMPARED, b=_AGAINST).select("o_orderkey", values.compare_texts(F.col("a"), F.col("b")).alias("v")).select("o_orderkey", "v.matched", "v.match_type")


# Words that only compatibility decomposition or nothing brings to ASCII, and the ASCII that is left of each.
FOREIGN = (("Nguyễn", "nguyen"), ("ﬁn", "fin"), ("３４x", "34x"), ("Straße", "strae"), ("œuvre", "uvre"), ("Ελλάδα", ""), ("İstanbul", "istanbul"), ("½ kg", "12 kg"), ("ＡＢＣ", "abc"), ("plain", "plain"))
_WORDS = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(FOREIGN)) + " END"
_KNOWN = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(FOREIGN)) + " END"


@query(f"""SELECT doc_id, {_KNOWN} || ' ' || doc_id AS plain, regexp_replace({_KNOWN}, '[^a-z0-9]', '', 'g') || doc_id AS key,
 CASE WHEN {_KNOWN} = 'nguyen' THEN 'normalized' WHEN {_KNOWN} = 'plain' THEN 'exact' ELSE 'mismatch' END AS verdict FROM documents""")
def foreign_forms(spark, sf):
    t = F.concat(F.expr(_WORDS), F.lit(" "), F.col("doc_id").cast("string"))
    word = F.expr(_WORDS)
    other = F.when(F.col("doc_id") % 10 == 0, "nguyen").when(F.col("doc_id") % 10 == 9, "plain").otherwise("nguyn")
    rows = table(spark, sf, "documents").select("doc_id", t.alias("t"), word.alias("w"), other.alias("o"))
    return rows.select("doc_id", text.normalize_string(F.col("t")).alias("plain"), text.normalize_key(F.col("t")).alias("key"), values.compare_texts(F.col("w"), F.col("o"))["match_type"].alias("verdict"))


_TYPO = "concat(substring(p_name, 1, 3), substring(p_name, 5))"
_KEY_OF = "regexp_replace(strip_accents(lower({})), '[^a-z0-9]', '', 'g')"


@query(f"""WITH RECURSIVE {sql.gestalt(f"SELECT p_partkey * 2 AS id, {sql.plain('p_name')} AS a, {sql.plain(_TYPO)} AS b FROM part UNION ALL SELECT p_partkey * 2 + 1, {_KEY_OF.format(_TYPO)}, {_KEY_OF.format('p_name')} FROM part")}
SELECT p_partkey, round(s.ratio, 6) AS ratio, CASE WHEN k.ratio >= 0.8 THEN {_TYPO} END AS key FROM part JOIN likeness s ON s.id = p_partkey * 2 JOIN likeness k ON k.id = p_partkey * 2 + 1""")
def fuzzy_match(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", F.expr(_TYPO).alias("typo"))
    return parts.select("p_partkey", F.round(similarity("p_name", "typo"), 6).alias("ratio"), closest_key("p_name", F.array(F.lit("zzz"), "typo", F.lit("unlike"))).alias("key"))


_NAMED = "concat(p_name, ' and ', p_name)"
_MISNAMED = f"CASE p_partkey % 5 WHEN 0 THEN {_NAMED} WHEN 1 THEN concat(substring({_NAMED}, 1, 3), substring({_NAMED}, 5)) WHEN 2 THEN p_name WHEN 3 THEN reverse({_NAMED}) ELSE concat(p_name, ' und ', p_name) END"
_KEYED = "CASE p_partkey % 3 WHEN 0 THEN 'product_name' WHEN 1 THEN 'Product Nam' ELSE 'title' END"


@query(f"""WITH RECURSIVE {sql.gestalt(f"SELECT p_partkey AS id, {sql.plain(_NAMED)} AS a, {sql.plain(_MISNAMED)} AS b FROM part")},
v AS (SELECT p_partkey, ratio, CASE WHEN p_partkey % 3 = 2 THEN 'mismatch' WHEN {_NAMED} = {_MISNAMED} THEN 'exact' WHEN ratio >= {values.FUZZY} THEN 'fuzzy' ELSE 'mismatch' END AS match_type, {_KEYED} AS k FROM part JOIN likeness ON id = p_partkey)
SELECT p_partkey, CASE WHEN k <> 'title' THEN k END AS pred_key, match_type <> 'mismatch' AS matched, match_type, CASE WHEN match_type = 'fuzzy' THEN round(ratio, 6) END AS similarity FROM v""")
def fuzzy_verdicts(spark, sf):
    """Values with typos, under keys with typos: the branches that only likeness decides."""
    text_of = lambda key, value: F.concat(F.lit('{"'), key, F.lit('": "'), value, F.lit('"}'))
    rows = table(spark, sf, "part").select("p_partkey", text_of(F.lit("product_name"), F.expr(_NAMED)).alias("gt"), text_of(F.expr(_KEYED), F.expr(_MISNAMED)).alias("pred"))
    return scoring.field_verdicts(rows, ["p_partkey"]).select("p_partkey", "pred_key", "matched", "match_type", F.round("similarity", 6).alias("similarity"))


# --- scoring -----------------------------------------------------------------------------------

_RECORDS = f"SELECT o_orderkey, o_orderpriority AS corpus, {GT} AS gt, {PRED} AS pred FROM orders"
_SCORED = f"""WITH {sql.scores(_RECORDS, 'o_orderkey, corpus')},
s AS (SELECT o_orderkey, count(*) FILTER (kind <> 'mismatch')::INT AS correct, count(*)::INT AS total FROM v GROUP BY 1),
q AS (SELECT j.o_orderkey, j.corpus, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, gok AND obj IS NOT NULL AS valid_json FROM j LEFT JOIN s USING (o_orderkey)) """


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf, gt=GT, pred=PRED).select("o_orderkey", F.col("o_orderpriority").alias("corpus"), "gt", "pred")
    return scoring.score(rows.withColumn("step", F.lit(10)), ["step", "corpus", "o_orderkey"])


@query(_SCORED + "SELECT o_orderkey, correct, total, CASE WHEN valid_json THEN round(correct / total, 6) ELSE 0 END AS accuracy, valid_json FROM q")
def field_accuracy(spark, sf):
    return scored(spark, sf).select("o_orderkey", "correct", "total", F.round("accuracy", 6).alias("accuracy"), "valid_json")


@query(f"WITH {sql.scores(_RECORDS, 'o_orderkey, corpus')} SELECT o_orderkey, key AS gt_key, pk AS pred_key, a AS gt_text, b AS pred_text, kind AS match_type FROM v")
def field_verdicts(spark, sf):
    rows = orders(spark, sf, gt=GT, pred=PRED)
    return scoring.field_verdicts(rows, ["o_orderkey"]).select("o_orderkey", "gt_key", "pred_key", "gt_text", "pred_text", "match_type")


@query(_SCORED + """SELECT corpus, CAST(sum(correct) AS BIGINT) AS matched_fields, CAST(sum(total) AS BIGINT) AS total_fields, count(*) FILTER (NOT valid_json) AS parse_errors,
 count(*) FILTER (valid_json) AS valid_json, count(*) AS examples, round(sum(correct) * 100.0 / sum(total), 6) AS accuracy_pct FROM q GROUP BY GROUPING SETS ((corpus), ())""")
def corpus_rollup(spark, sf):
    return scoring.corpus_metrics(scored(spark, sf)).select("corpus", "matched_fields", "total_fields", "parse_errors", "valid_json", "examples", F.round("accuracy_pct", 6).alias("accuracy_pct"))


@query(_SCORED + "SELECT round(sum(correct) * 100.0 / sum(total), 6) AS accuracy_pct FROM q")
def dataset_accuracy(spark, sf):
    return scoring.dataset_accuracy(scored(spark, sf)).select(F.round("accuracy_pct", 6).alias("accuracy_pct"))


_OLD = "regexp_replace(lower(trim(coalesce(json_extract_string({o}, '$.\"' || key || '\"'), ''))), '[€$£¥\\s]', '', 'g')"


@query(f"""WITH r AS (SELECT o_orderkey, {GT} AS gt, regexp_extract({PRED}, '(?s)\\{{.*\\}}') AS cut FROM orders),
p AS (SELECT o_orderkey, gt, CASE WHEN {sql.strict('cut')} THEN cut ELSE '{{}}' END AS obj FROM r), k AS (SELECT *, unnest(json_keys(gt)) AS key FROM p)
SELECT o_orderkey, count(*) FILTER ({_OLD.format(o='gt')} = {_OLD.format(o='obj')}) AS correct, count(*) AS total FROM k GROUP BY o_orderkey""")
def legacy_accuracy(spark, sf):
    return scoring.legacy_score(orders(spark, sf, gt=GT, pred=PRED), ["o_orderkey"])


# --- candidates and losses ---------------------------------------------------------------------


@query(f"WITH {LOGITS}, {TOP} SELECT vec_id, string_agg(i, ',' ORDER BY r) AS ids FROM t WHERE r <= 5 GROUP BY vec_id")
def topk_candidates(spark, sf):
    c = F.transform("embedding", lambda x, i: F.struct(i.cast("int").alias("id"), F.lit("").alias("text"), x.cast("double").alias("logprob")))
    top = softlabel.padded(softlabel.ranked(c, 5), 5)
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda t: t["id"].cast("string")), ",").alias("ids"))


@query(f"WITH {LOGITS}, {TOP} SELECT vec_id, round(max(p), 6) AS top, round(sum(p * r), 6) AS mean_rank FROM (SELECT vec_id, r, exp(z - max(z) OVER w) / sum(exp(z - mz)) OVER w AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mz FROM t) WINDOW w AS (PARTITION BY vec_id)) GROUP BY vec_id")
def topk_renormalize(spark, sf):
    p = positions(spark, sf).select("vec_id", kd.softmax(kd.scaled(F.col("topk_logprobs"), 2.0)).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("mean_rank"))


_CE = f"""WITH {LOGITS}, {TOP},
n AS (SELECT vec_id, label, max(z) + ln(sum(exp(z - mz))) AS lse, max(z / 2) + ln(sum(exp(z / 2 - mz / 2))) AS lse2, max(CASE WHEN i = label THEN z END) AS gz FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mz FROM e) GROUP BY vec_id, label),
q AS (SELECT vec_id, i, z, exp(z - max(z) OVER (PARTITION BY vec_id)) AS u FROM t),
s AS (SELECT q.vec_id, -sum(u * (q.z / 2 - n.lse2)) / sum(u) AS soft, count(*) FILTER (q.i = n.label) AS inside FROM q JOIN n USING (vec_id) GROUP BY q.vec_id),
v AS (SELECT n.vec_id, n.label, lse - gz AS hard, soft, inside FROM n JOIN s USING (vec_id))
"""


@query(_CE + "SELECT label, round(avg(hard), 6) AS hard_loss, round(avg(soft) * 4, 6) AS soft_loss, round(0.3 * avg(hard) + 0.7 * avg(soft) * 4, 6) AS loss, round(avg(inside), 6) AS frac_hard_in_topk, count(*) AS tokens FROM v GROUP BY label")
def mixed_loss(spark, sf):
    out = kd.losses(positions(spark, sf), ["label"], 0.7, 2.0)
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("hard_loss", "soft_loss", "loss", "frac_hard_in_topk")), "tokens")


@query(_CE + "SELECT vec_id, round(hard, 6) AS hard FROM v")
def hard_ce(spark, sf):
    return positions(spark, sf).select("vec_id", F.round(kd.hard_ce(F.col("logits"), F.col("gold")), 6).alias("hard"))


@query(_CE + "SELECT vec_id, round(soft, 6) AS soft FROM v")
def soft_ce(spark, sf):
    return positions(spark, sf).select("vec_id", F.round(kd.soft_ce(F.col("logits"), F.col("topk_ids"), F.col("topk_logprobs"), 2.0), 6).alias("soft"))


@query(f"WITH {LOGITS}, {TOP} SELECT label, count(*) FILTER (i >= 60) AS masked, count(*) AS candidates FROM t GROUP BY label")
def oov_mask(spark, sf):
    p = positions(spark, sf).select("label", F.explode(kd.within_vocabulary(F.col("topk_ids"), 60)).alias("ok"))
    return p.groupBy("label").agg(F.count_if(~F.col("ok")).alias("masked"), F.count(F.lit(1)).alias("candidates"))


@query(f"""WITH {LOGITS}, m AS (SELECT vec_id, i % 16 AS token_id, exp(z) AS prob FROM e UNION ALL SELECT vec_id, label AS token_id, 1.0 AS prob FROM embeddings),
g AS (SELECT vec_id, token_id, sum(prob) AS mass FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mass DESC, token_id) AS r FROM g)
SELECT vec_id, CAST(token_id AS INT) AS token_id, round(mass / sum(mass) OVER (PARTITION BY vec_id), 6) AS prob FROM k WHERE r <= 4""")
def candidate_merge(spark, sf):
    e = table(spark, sf, "embeddings")
    each = e.select("vec_id", F.posexplode("embedding").alias("i", "z")).select("vec_id", (F.col("i") % 16).alias("token_id"), F.exp(F.col("z").cast("double")).alias("prob"))
    merged = kd.merged_candidates(each.union(e.select("vec_id", "label", F.lit(1.0))), ["vec_id"], 4)
    return merged.select("vec_id", "token_id", F.round("prob", 6).alias("prob"))


@query("SELECT l.quality, round(sum(n_chars * toxic * 1.0) / sum(n_chars), 6) AS loss FROM documents JOIN labels l USING (doc_id) GROUP BY l.quality")
def weighted_loss(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    out = kd.weighted_loss(rows, ["quality"], "toxic", "n_chars")
    return out.select("quality", F.round("loss", 6).alias("loss"))


@query("SELECT greatest(sum(length(text)), 1)::BIGINT AS tokens FROM conversations WHERE role = 'assistant'")
def supervised_tokens(spark, sf):
    return kd.supervised_tokens(table(spark, sf, "conversations").filter("role = 'assistant'").select(F.length("text").cast("long").alias("n")), "n")


@query("SELECT count(*) FILTER (n_chars <= 2000) AS kept, count(*) FILTER (n_chars > 2000) AS dropped FROM documents")
def length_filter(spark, sf):
    return kd.length_filter(table(spark, sf, "documents").select("n_chars"), "n_chars", 2000)[1]


@query("""WITH c AS (SELECT conv_id, turn, text, unnest(range(greatest(length(text) - 1, 0))) AS i FROM conversations)
SELECT conv_id, turn, CAST(max(i) AS INT) AS last, CAST(sum((i + 1) * unicode(text[i + 2])) AS BIGINT) AS checksum FROM c GROUP BY conv_id, turn""")
def next_token_shift(spark, sf):
    made = table(spark, sf, "conversations").select("conv_id", "turn", kd.shifted_targets(text.chars(F.col("text")), F.lit(0)).alias("t")).filter("size(t) > 0")
    total = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + (x["position"] + 1).cast("long") * x["target"])
    return made.select("conv_id", "turn", F.array_max(F.transform("t", lambda x: x["position"])).alias("last"), total.alias("checksum"))


@query("""SELECT conv_id, turn, CAST(max(length(text)) OVER (PARTITION BY conv_id // 8) AS INT) AS width, CAST(length(text) AS INT) AS n FROM conversations""")
def pad_batch(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kd.batch_of(F.col("conv_id"), 8).alias("batch"), text.chars(F.col("text")).alias("ids"))
    out = kd.pad_batch(rows, "batch", "ids")
    return out.select("conv_id", "turn", F.size("ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("n"))


# --- shards, cache, history --------------------------------------------------------------------


@query("SELECT doc_id // 64 AS shard_index, min(doc_id) AS example_start, max(doc_id) + 1 AS example_end, count(*) AS row_count FROM documents GROUP BY 1")
def shard_plan(spark, sf):
    return softlabel.shard_plan(table(spark, sf, "documents"), "doc_id", 64)


@query("SELECT doc_id // 64 AS shard_index, min(doc_id) AS example_start, max(doc_id) + 1 AS example_end, count(*) AS row_count FROM documents WHERE (doc_id // 64) % 3 <> 0 GROUP BY 1")
def resume_anti_join(spark, sf):
    plan = softlabel.shard_plan(table(spark, sf, "documents"), "doc_id", 64)
    return softlabel.open_shards(plan, plan.filter("shard_index % 3 = 0"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").cast("long").alias("step"), F.col("event_type").alias("metric"), "value", "event_id")


_WIDE = "SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS step, round(avg(value), 6) AS mean, round(max(value), 6) AS most, CASE WHEN count(*) > 20 THEN CAST(count(*) AS DOUBLE) END AS many FROM events GROUP BY 1"


@query(f"WITH w AS ({_WIDE}) SELECT step, metric, value FROM (SELECT step, unnest(['mean', 'most', 'many']) AS metric, unnest([mean, most, many]) AS value FROM w) WHERE value IS NOT NULL")
def history_long(spark, sf):
    wide = daily(spark, sf).groupBy("step").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.when(F.count(F.lit(1)) > 20, F.count(F.lit(1))).alias("many"))
    return history.to_long(wide, ["step"], ["mean", "most", "many"])


@query(_WIDE)
def history_wide(spark, sf):
    return history.to_wide(history_long(spark, sf)).select("step", "mean", "most", "many")


@query("WITH d AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS step, value FROM events), o AS (SELECT step, count(*) AS n FROM d GROUP BY 1) SELECT step, CASE WHEN step % 2 = 0 THEN -1 ELSE n END AS n FROM o")
def history_upsert(spark, sf):
    old = daily(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return history.upsert(old, old.filter("step % 2 = 0").withColumn("n", F.lit(-1).cast("long")))


@query("SELECT DISTINCT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS step FROM events")
def logged_steps(spark, sf):
    return history.logged_steps(table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("step")))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def cache_last_wins(spark, sf):
    return history.last_wins(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 25 = 0)")
def cache_missing(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderkey % 25 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return history.missing_from_cache(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT event_type, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 6) AS per_second FROM events GROUP BY event_type")
def throughput(spark, sf):
    sums = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return sums.select("event_type", F.round(scoring.throughput(F.col("n"), F.col("s")), 6).alias("per_second"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def template_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", checks.fingerprint(F.col("text")).alias("sha256"))


@query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def fingerprint_mismatch(spark, sf):
    return checks.unequal_fingerprints(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "en").select("doc_id")

