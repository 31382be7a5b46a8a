"""Runs that break off and go on, writers at once, scans that prune, losses in blocks."""

import json
import os
import random
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fieldmill.functions.similarity import choose_key
from fieldmill.operators import blocked, distill, kd, keymatch, softlabel
from fieldmill.plans.records import Chars
from fieldmill.plans import runs
from fieldmill.plans.queries import positions
from fieldmill.sources import paths, readers, shardsource, writers
from fieldmill.streaming import asked, inline, listener, shardrun


def answering(limit, log):
    """A backend that notes whom it is asked for, and fails on ids from limit on."""

    def run(frames):
        for f in frames:
            if limit is not None and (f["i"] >= limit).any():
                raise ConnectionError("the teacher is gone")
            with open(f"{log}/{time.time_ns()}-{f['i'].iloc[0]}", "w") as out:
                out.write(",".join(map(str, f["i"])))
            yield f[["i"]].assign(answer=f["text"].str.upper())

    return run


def test_a_broken_teacher_run_goes_on(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), tmp_path / "log"
    log.mkdir()
    rows = [(i, f"t{i}") for i in range(100)] + [(7, "again"), (None, "none")]
    samples = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    with pytest.raises(Exception, match="teacher is gone|foreachBatch|FOREACH"):
        asked.ask_rest(samples, cache, "i", answering(50, log), "i long, answer string", rows=10)
    kept = {r.i for r in asked.answers(spark, cache, "i long, answer string").collect()}
    assert kept and max(kept) < 50
    asked.ask_rest(samples, cache, "i", answering(None, log), "i long, answer string", rows=10)
    got = asked.answers(spark, cache, "i long, answer string").collect()
    assert sorted(r.i for r in got) == list(range(100)) and all(r.answer.startswith(("T", "A")) for r in got) and len({r.run for r in got}) == 2
    said = Counter(int(x) for n in os.listdir(log) for x in (log / n).read_text().split(","))
    assert all(said[i] == 1 for i in kept | set(range(50, 100)))
    asked.ask_rest(samples, cache, "i", answering(0, log), "i long, answer string")  # nothing is left to ask for
    assert asked.answers(spark, cache, "i long, answer string").count() == 100
    assert not [n for n in os.listdir(tmp_path / "cache") if n.startswith("work")]
    assert asked.answers(spark, str(tmp_path / "none"), "i long, answer string").count() == 0


def test_a_shard_run_goes_on_where_it_stopped(spark, tmp_path):
    examples = spark.range(95).select(F.col("id").alias("example_index"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    source = str(tmp_path / "source")
    shardrun.stage(examples, source, 10)
    made = lambda b: b.select("example_index", F.upper("text").alias("text"), "shard_index")
    count = []

    def breaks(b):
        count.append(1)
        return made(b) if len(count) < 4 else b.select("example_index", F.raise_error(F.lit("power cut")).cast("string").alias("text"), "shard_index")

    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    shardrun.make_shards(spark, source, "example_index long, text string", whole, made)
    with pytest.raises(Exception):
        shardrun.make_shards(spark, source, "example_index long, text string", parts, breaks)
    assert shardrun.entries(spark, parts).count() == 3 and spark.read.parquet(f"{parts}/shards").count() in (25, 30)
    again = []
    shardrun.make_shards(spark, source, "example_index long, text string", parts, lambda b: (again.append(1), made(b))[1])
    assert len(again) == 7
    for path in (whole, parts):
        assert sorted(map(tuple, shardrun.entries(spark, path).collect())) == [(i, 10 * i, min(10 * i + 10, 95), min(10, 95 - 10 * i)) for i in range(10)]
        assert sorted((r.example_index, r.text) for r in spark.read.parquet(f"{path}/shards").collect()) == [(i, f"T{i}") for i in range(95)]
    told = shardrun.manifest(spark, parts, {"top_k": 3}).first()
    assert (told.top_k, told.total_examples, told.total_shards, told.shards[9].path) == (3, 95, 10, "shards/shard_index=9")
    shardrun.stage(examples.select((F.col("example_index") + 100).alias("example_index"), "text"), str(tmp_path / "more"), 10)
    assert shardrun.entries(spark, str(tmp_path / "nothing")).count() == 0


def test_shards_by_data_source(spark, tmp_path):
    shardsource.register(spark)
    path, schema = str(tmp_path / "shards"), "example_index long, text string"
    rows = spark.range(0, 95, 1, 4).select(F.col("id").alias("example_index"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    write = lambda df, mode="append": df.write.format("fieldmill_shards").option("size", 10).mode(mode).save(path)
    write(rows)
    back = shardsource.read_shards(spark, path, schema)
    assert sorted((r.example_index, r.text, r.shard_index) for r in back.collect()) == [(i, f"t{i}", i // 10) for i in range(95)]
    told = shardsource.committed(spark, path)
    assert sum(f["row_count"] for f in told) == 95 and {(f["example_start"] // 10) == f["shard_index"] == (f["example_end"] - 1) // 10 for f in told} == {True}
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part"))
    broken = rows.withColumn("text", F.when(F.col("example_index") == 90, F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="bad row"):
        write(broken)
    assert shardsource.committed(spark, path) == told
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part")) == before
    write(rows.filter("example_index < 10"), "overwrite")
    write(rows.filter("example_index >= 90"))
    assert sorted(r.example_index for r in shardsource.read_shards(spark, path, schema).collect()) == [*range(10), *range(90, 95)]
    assert shardsource.read_shards(spark, str(tmp_path / "none"), schema).count() == 0


def test_two_writers_of_a_history(spark, tmp_path):
    path = str(tmp_path / "history")
    one = lambda step: spark.createDataFrame([(step, "loss", float(step))], "step long, metric string, value double")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda s: writers.history(one(s), path), range(4)))
    assert sorted(made) == list(range(4)) and writers.versions(spark, path)[-1] == 3
    assert {r.step for r in spark.read.parquet(f"{path}/v=3/long").collect()} == set(range(4))
    assert not [n for n in os.listdir(path) if n.startswith("made")]


def test_a_claimed_version_is_put_in_place_by_the_next(spark, tmp_path):
    path = str(tmp_path / "history")
    one = lambda step: spark.createDataFrame([(step, "loss", float(step))], "step long, metric string, value double")
    writers.history(one(1), path)
    os.rename(tmp_path / "history" / "v=0", tmp_path / "history" / "made-x")  # as if the writer broke off behind its claim
    os.remove(tmp_path / "history" / "claims" / "0")
    assert paths.claim(spark, f"{path}/claims/0", f"{path}/made-x") and not paths.claim(spark, f"{path}/claims/0", "other")
    assert writers.history(one(2), path) == 1
    assert {r.step for r in spark.read.parquet(f"{path}/v=1/long").collect()} == {1, 2} and writers.versions(spark, path) == [0, 1]


def test_claims_at_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: paths.claim(spark, f"{tmp_path}/c/1", str(i)), range(8)))
    assert won.count(True) == 1 and paths.text_of(spark, f"{tmp_path}/c/1") == str(won.index(True)) and os.listdir(tmp_path / "c") == ["1"]


def test_capped_scan_reads_few_shards(spark, tmp_path):
    path, told = str(tmp_path / "shards"), str(tmp_path / "manifest")
    docs = spark.range(100).withColumnRenamed("id", "example_index")
    writers.shards(docs, path, 10)
    writers.manifest(docs.withColumn("shard_index", F.floor(F.col("example_index") / 10)), told)
    m = readers.manifest(spark, told)
    for rows, files in ((25, 3), (30, 3), (31, 4), (1, 1), (0, 0), (1000, 10)):
        df = readers.shards(spark, path, rows, m)
        assert [r.example_index for r in df.collect()] == list(range(min(rows, 100)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not rows or "PartitionFilters: [isnotnull(shard_index" in plan and "<=" in plan
        assert len({r[0] for r in spark.read.parquet(path).filter(F.col("shard_index") <= files - 1).select(F.input_file_name()).collect()}) == files


def test_counts_of_the_writing_job(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "n")
    assert writers.kept_rows(df, "n", 9, f"{tmp_path}/kept") == (10, 40) and spark.read.parquet(f"{tmp_path}/kept").count() == 10
    assert writers.kept_rows(df.limit(0), "n", 9, f"{tmp_path}/none") == (0, 0)


def test_listener_tells_each_step_once(spark, tmp_path):
    source, hist, mark = (str(tmp_path / n) for n in ("in", "history", "mark"))
    steps, failures = [], []
    told = listener.StepListener(steps.append, failures.append)
    spark.streams.addListener(told)
    try:
        row = lambda step: spark.createDataFrame([(step, "c", 0, '{"a": 1}', '{"a": 1}')], inline.GENERATION)
        for drop in ((1, 2), (2, 3)):
            for s in drop:
                row(s).coalesce(1).write.mode("append").json(source)
            inline.score_stream(spark, source, hist, mark, on_step=told.note).awaitTermination()

        def bad(df, n):
            raise RuntimeError("no disk")

        row(4).coalesce(1).write.mode("append").json(source)
        with pytest.raises(Exception):
            inline.score_stream(spark, source, hist, mark, on_step=bad).awaitTermination()
        until = time.time() + 20
        while time.time() < until and not (len(steps) >= 3 and failures):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(told)
    assert steps == [1, 2, 3] and len(failures) == 1 and "no disk" in failures[0]


def test_losses_in_blocks(spark, sf):
    """Equal to the losses from whole rows, with masks, other widths and a vocabulary that cuts a block."""
    p = positions(spark, sf).withColumn("valid", F.transform("topk_ids", lambda i, k: (k % 3 != 0) | (F.col("vec_id") % 4 == 0)))
    p = p.withColumn("gold", F.when(F.col("vec_id") % 9 == 0, F.lit(63)).otherwise(F.col("gold"))).withColumn("topk_ids", F.transform("topk_ids", lambda i, k: F.when(k != 5, i)))
    for size, vocabulary in ((16, 64), (7, 60), (64, 33)):
        want = kd.losses(p, ["label"], 0.3, 2.0, vocabulary=vocabulary, valid="valid").orderBy("label").collect()
        got = blocked.losses(blocked.in_blocks(p, ["vec_id"], "logits", size), p.drop("logits"), ["vec_id"], ["label"], size, 0.3, 2.0, vocabulary, "valid").orderBy("label").collect()
        assert [r.label for r in got] == [r.label for r in want]
        for a, b in zip(got, want):
            assert all(a[c] == pytest.approx(b[c], abs=1e-9) for c in ("hard_loss", "soft_loss", "loss", "frac_hard_in_topk", "tokens"))
    lone = blocked.losses(blocked.in_blocks(p, ["vec_id"], "logits", 16).limit(0), p.drop("logits"), ["vec_id"], ["label"], 16, 0.3, 2.0, 64).collect()
    assert {r.hard_loss for r in lone} <= {None, 0.0}
    with pytest.raises(ValueError):
        blocked.losses(p, p, ["vec_id"], ["label"], 16, 2.0, 1.0, 64)


# --- JSON arrays in splits ---------------------------------------------------------------------


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_arrays_in_splits(spark, tmp_path, size):
    """One file in many tasks, with brackets, quotes and escapes inside strings, nested and empty records, records longer than splits."""
    rng = random.Random(size)
    odd = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "漢", "x", " ", '\\"}', "\\\\", "\u2028"]
    rows = [{"a": i, "s": "".join(rng.choice(odd) for _ in range(rng.choice([0, 1, 5, 40]))), "o": {"k": [{"z": "}]{"}, {}] if i % 3 else [], "e": {}}} for i in range(24)]
    rows[7]["s"] = "}{" * 300
    for k, text in enumerate((json.dumps(rows, ensure_ascii=False), json.dumps(rows, indent=2), "\ufeff \n" + json.dumps(rows) + "\n\n")):
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    schema = "a long, s string, o struct<k:array<struct<z:string>>,e:struct<z:string>>"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        for k in range(3):
            df = readers.indexed(spark, f"{tmp_path}/f{k}.json", schema).orderBy("example_index")
            got = df.collect()
            assert [(r.example_index, r.a, r.s, [x.z for x in r.o.k]) for r in got] == [(i, i, r["s"], [x.get("z") for x in r["o"]["k"]]) for i, r in enumerate(rows)]
        whole = readers.json_array(spark, str(tmp_path), schema)
        assert whole.count() == 72 and (size > 1000 or readers.arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 8)
        for k, text in enumerate(() if size < 1000 else ('{"a": 1}', "", "[1, 2]", '[{"a": 1}, 5]', '[{"a": 1}', '[{"a": "x}]', '[{"a": 1}] 7', "[[{}]]")):
            (tmp_path / "bad").mkdir(exist_ok=True)
            (tmp_path / "bad" / f"{k}.json").write_text(text)
            with pytest.raises(Exception):
                readers.json_array(spark, f"{tmp_path}/bad/{k}.json", schema).collect()
        (tmp_path / "none.json").write_text(" [ ]\n")
        assert readers.json_array(spark, f"{tmp_path}/none.json", schema).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- keys by dictionary ------------------------------------------------------------------------


def test_keys_by_dictionary(spark):
    """Equal to choosing for each record anew; likeness sees the distinct pairs that bounds leave."""
    rng = random.Random(2)
    words = ["total_ht", "Total HT", "tötal-ht", "total_tcc", "totals", "date", "Datum", "d\u00e0te", "", "!!", "sender", "sendr", "a", "ab", "x1", "1x", "recipient_name"]
    sets = [[rng.choice(words) for _ in range(rng.randint(0, 5))] for _ in range(40)] + [None]
    rows = [(i, rng.choice([*words, None]), sets[rng.randrange(41)], "theirs") for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, target string, names array<string>, want string")
    got = {r.i: r.pred_key for r in keymatch.with_matched_keys(df, "target", "names").collect()}
    assert got == {i: choose_key(t, n) if t is not None and n is not None else None for i, t, n, _ in rows}
    pairs = keymatch.pairs_of(df, "target", "names")
    assert pairs.count() == len({(t, tuple(n)) for _, t, n, _ in rows if t is not None and n is not None})
    left = keymatch.open_pairs(pairs).filter("open").count()
    assert 0 < left < pairs.count() / 3
    assert keymatch.with_matched_keys(df.limit(0), "target", "names").count() == 0


# --- vocabulary and ties -----------------------------------------------------------------------


def test_vocabulary_and_tokenizer_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "é", "ab", "", None, "a", "漢", "~"])], "i int, t string")
    words = spark.range(128).select("id", F.char("id").alias("token"))
    got = distill.texts_by_vocabulary(distill.ids_by_vocabulary(rows, "t", words, Chars), "token_id", words, Chars)
    want = rows.withColumn("token_id", distill.single_id(Chars)("t")).withColumn("token", distill.decoder(Chars)("token_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = distill.ids_by_vocabulary(rows.filter("t IN ('a', '~')"), "t", words, Chars)
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString() and {r.token_id for r in plain.collect()} == {97, 126}


def test_ties_go_to_the_first_met(spark):
    c = "array<struct<id:int,text:string,logprob:double>>"
    df = spark.createDataFrame([([(9, "a", -1.0), (3, "b", -1.0), (7, "c", None), (5, "d", -0.5), (1, "e", None)],)], f"c {c}")
    assert [x.id for x in df.select(softlabel.ranked(F.col("c"), 4).alias("r")).first().r] == [5, 9, 3, 7]
    mass = spark.createDataFrame([(0, 9, 0.2, 1), (0, 3, 0.2, 2), (0, 4, 0.1, 0), (0, 4, 0.1, 5), (0, None, 1.0, 0)], "p int, token_id int, prob double, at int")
    assert {r.token_id for r in kd.merged_candidates(mass, ["p"], 2, order="at").collect()} == {4, 9}
    assert {r.token_id for r in kd.merged_candidates(mass, ["p"], 2).collect()} == {3, 4}


def test_a_shard_query_takes_few_batches(spark, tmp_path, monkeypatch):
    """resumed_shards makes about eight batches of any number of shards, not one a shard."""
    spark.range(0, 256 * 24, 64).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    batches, write = [], writers.FileShards.write_records
    monkeypatch.setattr(writers.FileShards, "write_records", lambda self, df, path: (batches.append(1), write(self, df, path))[1])
    got = sorted(map(tuple, runs.resumed_shards(spark, str(tmp_path)).collect()))
    assert got == [(i, 256 * i, 256 * i + 193, 4, 12) for i in range(24)] and len(batches) == 8
