"""Importance resampling towards a target distribution, by hashed word features.

Two passes over the texts in Arrow. The first counts the features of a partition in one vector of
BUCKETS cells (np.bincount) and merges the vectors in a tree; the second looks up each feature's gain,
the log ratio of its cell's shares in target and corpus, and sums a document's gains by bincount
weights. Adding Gumbel noise of a document's own seed to the mean gain and taking the highest scores
draws without replacement in proportion to the exponential of the weight (in thousandths).

Ranks come from a range-sorted table of those documents alone that can be drawn: scores are whole
numbers within fixed bounds, so their counts, a bounded table, tell the least score that is drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import crcs, shifted, stretches
from .common import kept, mapped, pieces

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7

#: Digits, letters (A-Z in lower case) and all beyond ASCII make words.
WORD = np.array([0 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if b < 0x5B and b >= 0x41 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.uint32(0xE96CCF45)  # crc32 of one space


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a text column, part by part: buckets of words and word pairs, the number of each one's text,
    and the numbers of the texts of the words."""
    last = None
    for data, starts, lengths, texts in stretches(column, WORD):
        if not len(starts):
            continue
        c = crcs(data, starts, lengths)
        if last is not None:  # the word before this part
            before, owner = np.append(last[0], c[:-1]), np.append(last[1], texts[:-1])
        else:
            before, owner = np.append(np.uint32(0), c[:-1]), np.append(-1, texts[:-1])
        two = np.flatnonzero(owner == texts)
        pairs = shifted(before[two], lengths[two] + 1) ^ shifted(np.full(len(two), _SPACE), lengths[two]) ^ c[two]
        last = c[-1], texts[-1]
        yield (np.concatenate([c, pairs]) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([texts, texts[two]]), texts


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket. Only one vector comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                for buckets, _, _ in features(part.column(0)):
                    total += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

    vectors = texts.select(F.col(text).alias("_t")).transform(mapped, count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, dtype=np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, dtype=np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(vectors.getNumPartitions(), 64))))


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A bucket's gain: the log of its smoothed share in the target over that in the corpus, in whole thousandths, down."""
    over, under = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1) * over) / ((s + 1) * under))) for t, s in zip(target.astype(float).tolist(), corpus.astype(float).tolist())], dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight (the mean gain of a document's features, down; 0 without any) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                n = part.num_rows
                words, many, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
                for buckets, owners, texts in features(part.column(1)):
                    words += np.bincount(texts, minlength=n)
                    many += np.bincount(owners, minlength=n)
                    total += np.bincount(owners, weights=shared.value[buckets], minlength=n)
                mean = np.where(many > 0, total.astype(np.int64) // np.maximum(many, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, many, mean))], names=["key", "n_words", "n_features", "weight"])

    return rows.transform(mapped, weigh, "key long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, down, from the hash of seed:key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank (1, 2, 3 ... by score, highest first, then key and the other columns), without a
    window over all of them: ranges of scores are sorted each by itself and numbered as they pass, and
    the sizes of the ranges before, one row a range, are added."""
    by = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("n_features"), F.col("weight")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at + 1, at + n + 1))], names=[*batch.schema.names, "part", "place"])
            at += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered, _ = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).transform(mapped, number, f"{schema}, part long, place long"), "ranked")
    sizes = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, upto = [], 0
    for part in sorted(sizes):
        starts.append((part, upto))
        upto += sizes[part]
    before = rows.sparkSession.createDataFrame(starts or [(-1, 0)], "part long, before long")
    return numbered.join(F.broadcast(before), "part").select(*rows.columns, (F.col("place") + F.col("before")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """key, n_features, weight, score and rank (null if not drawn) of every row of docs.

    percent of the rows with least_words words or more are drawn, rounded down. A null or empty text
    has no features, weight 0 and is never drawn; a null key has noise of its own and comes last among
    ties; rows that repeat a key are drawn each by itself (equal rows in any order); long texts count
    whole; an empty table gives no row, an empty target a target of equal shares. Other columns are
    left out, whatever their names. Counts of buckets and of scores, both of bounded size, one row a
    sorted range and the gains come to the driver.
    """
    gains = gains_of(bucket_counts(target, target_text), bucket_counts(docs, text))
    scored, _ = kept(weights(docs, gains, key, text).withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "weights")
    rich = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in scored.filter(rich).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota, upto, least = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if upto >= quota:
            break
        upto, least = upto + n, score
    near = rich & (F.col("score") >= least) if least is not None else F.lit(False)
    drawn = ranked(scored.filter(near).drop("n_words")).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scored.filter(~near).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("key", key)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw documents towards the distribution of the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
