import math

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import checks, distill, history, kd, sample, scoring, softlabel
from fieldmill.sources import readers, writers
from fieldmill.streaming import inline


def test_scores(spark):
    rows = [(1, '{"date": "03/01/2025", "total": "5944.05"}', '{"date": "3-1-25", "total": "5 944,05"}'), (2, '{"a": "x", "b": [1, 2], "c": null}', '{"a": "y", "b": [1, 2.0]}'), (3, '{"a": 1}', "no"), (4, "bad", "{}"), (5, "{}", "{}"), (6, None, None)]
    got = {r.id: r for r in scoring.score(spark.createDataFrame(rows, "id long, gt string, pred string"), ["id"]).collect()}
    assert [(got[i].correct, got[i].total, got[i].valid_json) for i in range(1, 7)] == [(2, 2, True), (2, 3, True), (0, 1, False), (0, 0, False), (0, 0, True), (0, 0, False)]
    assert got[5].accuracy == 1.0 and got[4].accuracy == 0.0


def test_micro_average(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (0, 3, 0.0)], "correct int, total int, accuracy double")
    assert scoring.dataset_accuracy(s).first()[0] == 25.0
    assert scoring.dataset_accuracy(s.limit(0)).first()[0] == 0.0
    assert scoring.dataset_accuracy(spark.createDataFrame([(0, 0, 1.0)], s.schema)).first()[0] == 100.0


def test_unmatched_generations_stay_visible(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, e string"), spark.createDataFrame([(2, "g"), (3, "h")], "i int, g string")
    both, rest = scoring.join_generations(a, b, ["i"])
    assert both.count() == 1 and {r.i for r in rest.collect()} == {1, 3}


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([1, None, 3], [-1.5, None, float("nan"), -0.1])], "i array<int>, p array<double>")
    ids, mask = kd.ids_or_zero(F.col("i"))
    r = df.select(ids.alias("i"), mask.alias("m"), kd.logprobs_or_least(F.col("p")).alias("p")).first()
    assert r.i == [1, 0, 3] and r.m == [True, False, True] and r.p == [-1.5, -1e30, -1e30, -0.1]
    batch = spark.createDataFrame([(0, [1, 2]), (0, [3]), (1, [4])], "b int, ids array<int>")
    assert sorted((r.ids, r.attention_mask) for r in kd.pad_batch(batch, "b", "ids").collect()) == [([1, 2], [1, 1]), ([3, 0], [1, 0]), ([4], [1])]


def test_records_and_checks(spark):
    c = "array<array<struct<id:int,text:string,logprob:double>>>"
    df = spark.createDataFrame([(0, [7, 8], [[(7, "a", -0.1), (9, "b", None)], [(1, "c", -2.0)]], [5, 6, 7, 8], 2)], f"example_index long, assistant_token_ids array<int>, candidates {c}, input_ids array<int>, assistant_token_start int")
    made = softlabel.records(df, 2)
    r = made.first()
    assert r.topk_token_ids == [[7, 9], [1, None]] and r.hard_label_in_topk == [True, False]
    rows = kd.kd_records(made)
    assert kd.violations(rows, 2).count() == 0 and {x.rule for x in kd.violations(rows, 3).collect()} == {"width"}
    assert {x.rule for x in kd.violations(rows.withColumn("gold_ids", F.array(F.lit(1))), 2).collect()} == {"gold", "lengths"}
    assert checks.batch_faults(rows.withColumn("batch", F.lit(0)), "batch", 2).count() == 0


def test_span(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2]), ([1, 2], [1, 2]), ([1, 2, 3], [2])], "f array<int>, p array<int>")
    got = [r.s for r in df.select(softlabel.assistant_span(F.col("f"), F.col("p")).alias("s")).collect()]
    assert tuple(got[0]) == ([3, 4], 2, 2) and got[1] is None and got[2] is None


def test_shards(spark):
    plan = softlabel.shard_plan(spark.range(5).withColumnRenamed("id", "i"), "i", 2)
    assert sorted(map(tuple, plan.collect())) == [(0, 0, 2, 2), (1, 2, 4, 2), (2, 4, 5, 1)]
    assert softlabel.open_shards(plan, plan.filter("shard_index = 1")).count() == 2
    with pytest.raises(Exception, match="no partner"):
        softlabel.with_teacher(spark.range(3).withColumnRenamed("id", "example_index"), spark.range(2).withColumnRenamed("id", "example_index")).count()


def test_losses_against_plain_arithmetic(spark):
    z, gold, ids, teacher, temp = [0.5, -1.0, 2.0, 0.0], 2, [2, 0], [-0.2, -1.5], 2.0
    df = spark.createDataFrame([(0, z, gold, ids, teacher), (0, z, 9, ids, teacher)], "g int, logits array<double>, gold int, topk_ids array<int>, topk_logprobs array<double>")
    r = kd.losses(df, ["g"], 0.25, temp, vocabulary=4).first()
    lse = lambda v: math.log(sum(map(math.exp, v)))
    hard = lse(z) - z[gold]
    w = [math.exp(p / temp) for p in teacher]
    soft = -sum(x / sum(w) * (z[i] / temp - lse([a / temp for a in z])) for x, i in zip(w, ids)) * temp**2
    assert r.tokens == 1 and math.isclose(r.hard_loss, hard, rel_tol=1e-9) and math.isclose(r.soft_loss, soft, rel_tol=1e-9) and math.isclose(r.loss, 0.75 * hard + 0.25 * soft)


def test_largest_remainder_and_nesting(spark):
    w = spark.createDataFrame([("a", 6), ("b", 6), ("c", 2)], "k string, n int")
    take = lambda n: [r.take for r in sample.allocate(w, "k", "n", F.lit(n)).orderBy("k").collect()]
    assert take(10) == [4, 4, 2] and take(11) == [5, 5, 1] and take(0) == [0, 0, 0]


def test_split(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert sample.split(df, "i", 3, 1).filter("fold = 'eval'").count() == 3 and sample.split(df, "i", 0, 1).filter("fold = 'eval'").count() == 0
    with pytest.raises(ValueError):
        sample.split(df, "i", 10, 1)


def test_history(spark):
    old, new = spark.createDataFrame([(10, 1.0), (20, 2.0)], "step long, x double"), spark.createDataFrame([(20, 5.0)], "step long, y double")
    got = {r.step: (r.x, r.y) for r in history.upsert(old, new).collect()}
    assert got == {10: (1.0, None), 20: (None, 5.0)}
    long = history.to_long(history.upsert(old, new), ["step"], ["x", "y"])
    assert history.to_wide(long).columns == ["step", "x", "y"]
    text = spark.createDataFrame([("1", "2.5"), ("x", "1"), ("3", "nan"), ("2", None)], "step string, m string")
    assert [r.step for r in history.logged_steps(text).orderBy("step").collect()] == [1, 2, 3]
    assert [(r.step, r.m) for r in history.series(text, ["step", "m"]).collect()][0] == (1.0, 2.5)


def test_candidate_merge(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25), (0, 2, 0.5), (0, 3, 0.1), (0, None, 9.0)], "p int, token_id int, prob double")
    assert [(r.token_id, round(r.prob, 6)) for r in kd.merged_candidates(df, ["p"], 2).orderBy("token_id").collect()] == [(1, 0.6), (2, 0.4)]


def test_modes():
    with pytest.raises(ValueError):
        checks.one_mode(True, True)
    with pytest.raises(ValueError):
        checks.positive(k=0, n=3)


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"instruction": "i", "input": "x", "output": "{}"}, {"instruction": "j", "input": "y", "output": "[]"}]')
    (tmp_path / "b.json").write_text('{"instruction": "i"}')
    assert readers.json_array(spark, str(p)).count() == 2 and readers.corpora(spark, {"a": str(p), "b": str(p)}).count() == 4
    with pytest.raises(ValueError):
        readers.json_array(spark, str(tmp_path / "b.json"))
    with pytest.raises(FileNotFoundError):
        readers.json_array(spark, str(tmp_path / "none.json"))
    assert readers.first_existing(spark, [str(tmp_path / "none.json"), str(p)], 1).count() == 1 and readers.concatenated(spark, [str(p), str(p)], 3).count() == 3
    assert readers.digests(spark, str(p)).count() == 1 and readers.raw_json(spark, str(p)).count() == 1
    (tmp_path / "c.jsonl").write_text('{"_sample_id": 1, "teacher_output": "old"}\n{"_sample_id": 1, "teacher_output": "new"}\n')
    assert [r.teacher_output for r in readers.jsonl_cache(spark, str(tmp_path / "c.jsonl")).collect()] == ["new"]
    assert readers.manifest(spark, str(tmp_path / "none"), strict=False).count() == 0
    df = spark.range(5).select(F.col("id").alias("example_index"))
    writers.shards(df, str(tmp_path / "s"), 2)
    writers.shards(df.filter("example_index >= 4"), str(tmp_path / "s"), 2)
    assert [r.example_index for r in readers.shards(spark, str(tmp_path / "s"), 3).collect()] == [0, 1, 2] and readers.shards(spark, str(tmp_path / "s")).count() == 5
    long = spark.createDataFrame([(10, "gt_acc/order", 90.0)], "step long, metric string, value double")
    h = str(tmp_path / "h")
    assert writers.history(long, h) == 0
    assert readers.csv_history(spark, f"{h}/v=0/wide").first().asDict() == {"step": "10", "gt_acc/order": "90.0"}
    (tmp_path / "h" / "v=1").mkdir()  # a write that broke off
    assert writers.history(long.withColumn("step", F.lit(20).cast("long")), h) == 1 and writers.history(long, h) == 2
    assert readers.csv_history(spark, f"{h}/v=2/wide").count() == 2 and writers.versions(spark, h) == [1, 2]


def test_stream_scores_each_step_once(spark, tmp_path):
    src, hist, ckpt = (str(tmp_path / n) for n in ("src", "hist", "ckpt"))
    row = lambda step, pred: (step, "c", 0, '{"a": "x"}', pred)
    schema = inline.GENERATION
    losses = spark.createDataFrame([(1, 0.5)], "step long, loss double")
    spark.createDataFrame([row(1, '{"a": "x"}')], schema).coalesce(1).write.mode("append").json(src)
    inline.score_stream(spark, src, hist, ckpt, losses).awaitTermination()
    spark.createDataFrame([row(1, "{}"), row(2, "{}")], schema).coalesce(1).write.mode("append").json(src)
    inline.score_stream(spark, src, hist, ckpt, losses).awaitTermination()
    got = {(r.step, r.metric): r.value for r in inline.latest(spark, hist, 2).filter("corpus = 'c'").collect()}
    assert got[(1, "accuracy_pct")] == 100.0 and got[(2, "accuracy_pct")] == 0.0 and got[(1, "loss")] == 0.5 and (2, "loss") not in got


def test_distillation_examples(spark):
    class Chars:
        """A tokenizer of characters."""

        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    ids = distill.encoder(Chars)
    df = spark.createDataFrame([(1, "ab", "abXY", "abcde"), (2, "ab", "ab", "ab")], "_sample_id long, p string, h string, s string")
    df = df.select("_sample_id", ids("p").alias("prompt_ids"), ids("h").alias("hard_ids"), ids("s").alias("soft_ids"))
    steps = spark.createDataFrame([(1, 0, 99, 0.6), (1, 0, 7, 0.3), (1, 0, 8, 0.1), (1, 2, 101, 0.5), (1, 9, 1, 1.0)], "_sample_id long, step int, token_id int, prob double")
    got = {r._sample_id: r for r in distill.distillation_examples(df, steps, "_sample_id", 2, 16).collect()}
    assert got[1].hard_labels == [-100, -100, ord("X"), ord("Y")] and got[1].soft_target_mask == [0, 1, 0, 1]
    assert got[1].soft_target_ids == [[-1, -1], [99, 7], [-1, -1], [101, -1]] and [round(x, 6) for x in got[1].soft_target_probs[1]] == [0.666667, 0.333333]
    assert got[2].soft_target_mask == [0] and got[2].hard_labels == [-100, -100]
    t = spark.createDataFrame([("a", 97), ("ab", None)], "t string, i int").select(distill.single_id(Chars)("t").alias("one"), distill.decoder(Chars)("i").alias("text")).collect()
    assert [(r.one, r.text) for r in t] == [(97, "a"), (None, "")]


def test_legacy_score_and_keys(spark):
    rows = [(1, '{"a": " 5 €", "b": 1}', '{"a": "5", "b": 2}'), (2, "{}", "{}"), (3, '{"a": 1}', "none"), (4, '{"a": "x"}', '{"a":"x",}'), (5, '{"a": "50%"}', '{"a": "50"}'), (6, '{"a": null}', "so {} it"), (7, '{"a": ["x", true]}', '{"a": ["X",  true]}')]
    got = scoring.legacy_score(spark.createDataFrame(rows, "id long, gt string, pred string"), ["id"])
    assert {r.id: (r.correct, r.total) for r in got.collect()} == {1: (1, 2), 2: (0, 0), 3: (0, 1), 4: (0, 1), 5: (0, 1), 6: (1, 1), 7: (1, 1)}
    parsed = scoring.parse_column(spark.createDataFrame([('{"A b": 1, "a_b": 2, "c": null}',)], "t string"), "t")
    assert parsed.select(scoring.normalized_keys(F.col("parsed.fields")).alias("m")).first().m == {"ab": "2", "c": None}


def test_ground_truth_is_not_repaired(spark):
    rows = [(1, '{"a": 1', '{"a": 1'), (2, "[1]", "{}"), (3, "{}", "none")]
    got = {r.id: r for r in scoring.score(spark.createDataFrame(rows, "id long, gt string, pred string"), ["id"]).collect()}
    assert [(got[i].correct, got[i].total, got[i].accuracy, got[i].parse_error) for i in (1, 2, 3)] == [(0, 0, 0.0, True)] * 3


def test_scoring_plan(spark):
    """One scan, one pass through Python, no shuffle before the roll-up."""
    df = spark.createDataFrame([(1, "c", 1, "{}", "{}")], "step int, corpus string, i int, gt string, pred string")
    plan = scoring.corpus_metrics(scoring.score(df, ["step", "corpus", "i"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_masked_candidates(spark):
    schema = "g int, logits array<double>, gold int, topk_ids array<int>, topk_logprobs array<double>, v array<boolean>"
    row = lambda g, v: (g, [0.5, -1.0, 2.0, 0.0], 2, [0, 2], [-0.2, -1.5], v)
    df = spark.createDataFrame([row(0, [True, True]), row(1, [False, True]), row(2, [False, False]), row(3, [True, True])], schema)
    df = df.withColumn("topk_logprobs", F.when(F.col("g") == 3, F.array(F.lit(-1e30), F.lit(-1e30))).otherwise(F.col("topk_logprobs")))
    got = {r.g: r.soft_loss for r in kd.losses(df, ["g"], 1.0, 1.0, valid="v").collect()}
    lse = math.log(sum(map(math.exp, [0.5, -1.0, 2.0, 0.0])))
    w = [math.exp(-0.2), math.exp(-1.5)]
    want = [-(w[0] * (0.5 - lse) + w[1] * (2.0 - lse)) / sum(w), lse - 2.0, 0.0, lse - 1.25]
    assert all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in range(4))


def test_whole_batches_and_their_faults(spark):
    schema = "batch int, example_index long, input_ids array<int>, assistant_start int, assistant_len int, gold_ids array<int>, topk_ids array<array<int>>, topk_logprobs array<array<float>>, topk_valid_mask array<array<boolean>>"
    rows = [(0, 1, [1, 2, 3, 4], 2, 2, [3, 4], [[3, 0], [4, 5]], [[-1.0, -2.0], [-1.0, -3.0]], [[True, False], [True, True]]), (0, 2, [7, 8], 1, 1, [8], [[8, 9]], [[-1.0, -1.5]], [[True, True]])]
    df = spark.createDataFrame(rows, schema)
    a, b = kd.training_batch(df, "batch", 0, 2).orderBy("example_index").collect()
    assert a.labels == [-100, -100, 3, 4] and b.labels == [-100, 8, -100, -100] and b.input_ids == [7, 8, 0, 0] and b.attention_mask == [1, 1, 0, 0]
    assert a.topk_logprobs[0][1] < -1e29 and b.topk_ids == [[8, 9], [0, 0]] and b.topk_valid == [[True, True], [False, False]] and b.span_mask == [True, False] and b.gold_ids == [8, 0]
    for wrong in (df.withColumn("assistant_start", F.lit(0)), df.withColumn("assistant_len", F.lit(9)), df):
        with pytest.raises(Exception, match="example [12]: "):
            kd.training_batch(wrong, "batch", 0, 3 if wrong is df else 2).collect()
    assert {(r.bad_width, r.empty_span, r.bad_span) for r in checks.batch_faults(df.withColumn("assistant_start", F.lit(0)), "batch", 3).collect()} == {(2, 0, 2)}


def test_alignment_of_teacher_positions(spark):
    c = "array<array<struct<id:int,text:string,logprob:double>>>"
    df = spark.createDataFrame([([[(1, "a", -1.0)]], [5, 6]), ([[(1, "a", -1.0)], [(2, "b", -1.0)]], [5, 6]), ([], [5])], f"p {c}, t array<int>")
    got = [r.a for r in df.select(softlabel.aligned(F.col("p"), F.col("t")).alias("a")).collect()]
    assert got[0][0] is None and got[0][1][0].id == 1 and got[1][0][0].id == 1 and got[2] == [None]
    with pytest.raises(Exception, match="candidates for"):
        spark.createDataFrame([([], [5, 6])], f"p {c}, t array<int>").select(softlabel.aligned(F.col("p"), F.col("t"))).collect()


def test_teacher_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from fieldmill.streaming.teacher import ANSWER, Teacher, backend

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            if len(seen) == 1:  # fails once
                self.send_error(500)
                return
            body = json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": "ok"}]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    teacher = Teacher(f"http://127.0.0.1:{server.server_port}/v1", "k", "m", tries=2, pause=0.0, json_only=True, extra={"seed": 1}, token_field="max_completion_tokens")
    examples = spark.createDataFrame([(1, "i", "x"), (2, "i", "y")], "_sample_id long, instruction string, input string").coalesce(1)
    rows = inline.teacher_rows(examples, examples.filter("_sample_id = 2"), "_sample_id", backend(teacher), ANSWER).collect()
    server.shutdown()
    assert [(r._sample_id, json.loads(r.teacher_output)[0]["text"]) for r in rows] == [(1, "ok")]
    assert len(seen) == 2 and seen[1][0] == "/v1/chat/completions" and seen[1][1]["seed"] == 1 and seen[1][1]["max_completion_tokens"] == 512 and seen[1][1]["response_format"] == {"type": "json_object"}
    with pytest.raises(RuntimeError):
        Teacher("http://127.0.0.1:9", "k", "m", tries=1, timeout=1.0).ask([])


def test_a_lost_version_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        inline.read_history(spark, str(tmp_path / "v=3"))


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from fieldmill.sources import paths

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        paths.shared_dir(Session())
