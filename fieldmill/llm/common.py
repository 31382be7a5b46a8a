"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import fresh, remove, shared_dir


_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


class Scope:
    """What a block of calls has written to the shared folder."""

    def __init__(self):
        self.paths: list[str] = []
        self.passed: list[str] = []

    def keep(self, *what: str | DataFrame) -> None:
        """Leave paths, or tables that cut() made, to the scope around this one."""
        self.passed += [w if isinstance(w, str) else _checkpoint(w) for w in what]


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Owns the tables and checkpoints that calls within the block write, and removes them at its end,
    so results that read them must be written or collected inside. Scopes nest, and each thread has
    its own: none touches what another call has written. Without a scope, they stay where they are."""
    mine, around = Scope(), _OWNED.get()
    token = _OWNED.set(mine.paths)
    try:
        yield mine
    finally:
        _OWNED.reset(token)
        for path in mine.paths:
            if path not in mine.passed:
                remove(spark, path)
            elif around is not None:
                around.append(path)


def _own(path: str) -> str:
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


def _checkpoint(df: DataFrame) -> str:
    """The folder of a table that cut() made."""
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


#: Spark's setting by which a query removes its shuffle files at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables written within the block leave no shuffle files: what reads them needs none. Where they
    were lost, Spark would run their stages again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage."""
    shared_dir(df.sparkSession)
    with released(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)  # a query of its own, as the setting counts when one is made
    if _OWNED.get() is not None:
        _own(_checkpoint(out))
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, owned by the scope that is open."""
    return _own(fresh(spark, name))


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table of the shared folder, smaller than a checkpoint where rows are many; and its path."""
    path = scratch(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


#: Rows are sifted by so many cells at most, and at least.
CELLS, CELLS_LEAST = 1 << 20, 1 << 12


def sifted(rows: DataFrame, id: str, keys: DataFrame, outside: bool = False) -> DataFrame:
    """Rows whose id may be in keys (one column, materialised), or, for outside, those whose id can't
    be, before any shuffle. Ids fall into hash cells, and the cells of keys, a bounded table, are
    broadcast; there are eight times as many cells as keys as long as the bound allows it, beyond
    that more rows pass. Null ids are outside."""
    many = min(CELLS, max(CELLS_LEAST, 1 << (8 * keys.count()).bit_length()))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(many))
    cells = keys.select(cell(F.col(keys.columns[0])).alias("__cell")).distinct()
    at = F.when(F.col(id).isNotNull(), cell(F.col(id).cast(keys.schema[0].dataType)))
    return rows.join(F.broadcast(cells), at == F.col("__cell"), "left_anti" if outside else "left_semi")


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, most: str | None = None) -> DataFrame:
    """df.mapInArrow(fn, schema) in batches of at most BATCH bytes, or most; a worker that has done a task
    gives free memory back, as it may stay for long beside others."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most or BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def strings(column: pa.Array) -> list[str]:
    """A string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


#: Scripts without spaces between words (Chinese, Japanese, Thai, Lao, Burmese, Khmer), as a class of characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{UNSPACED}]")


def spaced(text: str) -> str:
    """A text with each character of such scripts as a word by itself."""
    return text if text.isascii() or not _UNSPACED.search(text) else _UNSPACED.sub(r" \g<0> ", text)


#: What a worker takes at once. An executor holds a batch more than once, outside its heap, while it is sent and read
#: back, so this is kept within the 4 MB of a chunk of its buffer pools.
BATCH = "2m"


class Remembered(dict):
    """What make() gives for a key; forgets the older half of its keys beyond a fixed number."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Between batches, so that a batch never loses what it uses."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about most bytes each, so that memory doesn't follow the batch size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text column, and where each text's begin and end.

    Words stand between ASCII white space (0x20, 0x09 to 0x0D) with A-Z in lower case; a null text
    has none. Each distinct word of the column is hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary() if coded.dictionary.type == pa.string() else pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    empty = next((i for i, w in enumerate(distinct) if not w), None)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    if empty is not None:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return hashes[codes], offsets


_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> _S)


def runs_hashed(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k word hashes, in order; of the whole when there are fewer, and none without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return runs_hashed(np.concatenate([words, np.full(k - n, n, dtype=np.uint64)]), k)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mixed(h + words[i : n - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return h
