"""What Python workers keep from batch to batch is bounded."""

import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldmill.llm import common, packing
from fieldmill.llm.tokens import Encoder, default_path


def test_what_a_worker_remembers_is_bounded():
    """Also where the ids are zipped behind a list, so that nobody asks for more than there are."""
    enc = Encoder(default_path(), remembered=100)
    for b in range(9):
        texts = ["".join(chr(97 + int(c)) for c in str(10_000 + 1000 * b + i)) for i in range(200)]
        assert len(list(zip(texts, enc.batch(pa.array(texts))))) == 200
    assert len(enc.cache) + len(enc.cache.old) < 1000


def calls(run) -> int:
    """How many functions, of Python and of C, Python code calls in a run."""
    made = 0

    def count(frame, event, arg):
        nonlocal made
        made += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return made


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnoprstuvé", k=9)) for _ in range(n)]


def test_remembered_words_take_little_memory():
    """About fifty bytes of Python and numpy memory each at most, with their ids."""
    enc, texts = Encoder(default_path()), pa.array([" ".join(words(30_000, 1))])
    list(enc.batch(pa.array(["warm up"])))
    tracemalloc.start()
    try:
        list(enc.batch(texts))
        assert tracemalloc.get_traced_memory()[0] < 50 * 30_000
    finally:
        tracemalloc.stop()


def test_ids_after_words_are_forgotten():
    enc, rng = Encoder(default_path(), remembered=50), random.Random(2)
    few = words(40, 3) + ["x.", "1,5", "(a)", "isn't", ".", "", "漢字,", "a\tb"]
    for b in range(12):
        texts = [" ".join(rng.choices(few + words(9, b), k=rng.randint(0, 9))) for _ in range(20)] + [None]
        assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.batch(pa.array(texts))] == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_known_words_take_no_step_of_python():
    enc, texts = Encoder(default_path()), pa.array([" ".join(words(20_000, 4))])
    list(enc.batch(texts))
    assert calls(lambda: list(enc.batch(texts))) < 5_000


def test_cuts_take_few_steps_a_candidate():
    rng = np.random.default_rng(5)
    at = np.cumsum(rng.integers(5, 35, 10_000))
    assert calls(lambda: packing.cuts(at, rng.integers(0, 2, 10_000))) < 40_000


def test_packing_takes_little_memory_of_arrow(spark, monkeypatch):
    """Over batches of the size that is asked of Spark."""
    asked = {}
    monkeypatch.setattr(packing, "mapped", lambda df, run, schema, most=None: asked.update(run=run, most=most or common.BATCH) or df)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    some, size = words(5_000, 6), int(asked["most"].removesuffix("m")) << 20
    text = " ".join(some)
    before = pa.default_memory_pool()
    counted = pa.proxy_memory_pool(before)
    pa.set_memory_pool(counted)
    try:
        batches = (pa.RecordBatch.from_arrays([pa.array(range(size // len(text))), pa.array([text] * (size // len(text)))], names=["_k", "_t"]) for _ in range(3))
        assert sum(pa.compute.sum(x.column(2)).as_py() for x in asked["run"](batches)) == 3 * (size // len(text)) * (len(Encoder.of(default_path()).tok.encode(text).ids) + 1)
    finally:
        pa.set_memory_pool(before)
    assert counted.max_memory() < 20 << 20


def test_a_batch_of_texts_takes_little_memory(spark):
    """20 MB of texts in one partition: no batch holds much more than one of the 4 MB of Arrow's pools."""
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("t"))

    def taken(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    sizes = [r.n for r in common.mapped(texts, taken, "n long").collect()]
    assert sum(sizes) >= 20_000_000 and max(sizes) < 3 << 20
