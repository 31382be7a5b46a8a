"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence a span of several consecutive sentences begins,
and at every sentence one ends: the shortest with at least SENTENCES sentences and WORDS words. A
sentence of LONG words is a span by itself too. All spans' hashes are joined over the corpus, and
the sentences that a non-first occurrence of a span covers are removed. Forward and backward spans
together cover every sentence of a repeated passage that holds about twice the least span,
wherever it stands in a text.

Words stand between ASCII white space; of scripts that write none, each character counts as a word.

A passage may begin and end inside sentences and hold few whole ones. On request, every run of
PASSAGE words that stands earlier in the corpus is removed too, word by word: a run is told by the
smallest hash of its runs of ANCHOR words, these are joined first, and only runs whose smallest
hash stands in several texts are joined themselves. No such run is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNSPACED, cut, kept, mapped, mixed, pieces, sifted, spaced, strings, word_hashes

SENTENCES, WORDS, LONG = 2, 20, 25
PASSAGE, ANCHOR = 50, 25
#: A sentence with the white space behind it: up to final punctuation before white space, a full-width stop, or a line's end.
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?…][\"')\]»”]*(?:[^\S\n]+|\n+|\Z)|[。！？｡][\"')\]»”’」』）】〉》]*(?:[^\S\n]+|\n+|))|[^\n]+(?:\n+|\Z)|\n+")
#: A word, as word_hashes takes them of a text that spaced() gives.
_WORD = re.compile(rf"[{UNSPACED}]|[^ \t-\r{UNSPACED}]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they give the text."""
    return _SENTENCE.findall(text)


def spans(words: np.ndarray, ends: np.ndarray, least_sentences: int = SENTENCES, least_words: int = WORDS, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, last sentence and hash of every span of one text, by first sentence: words
    holds the word hashes, ends where each sentence's words end. Sentences without words don't count."""
    starts = np.concatenate([[0], ends[:-1]])
    own = np.flatnonzero(ends > starts)
    m = len(own)
    s, e = starts[own], ends[own]
    here = np.arange(m)
    last = np.maximum(np.searchsorted(e, s + least_words, side="left"), here + least_sentences - 1)
    first = np.minimum(np.searchsorted(s, e - least_words, side="right") - 1, here - least_sentences + 1)
    forward, backward, alone = last < m, first >= 0, e - s >= long
    pair = np.unique(np.concatenate([here[forward] * m + last[forward], first[backward] * m + here[backward], here[alone] * (m + 1)]))
    if not len(pair):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    a, b = pair // m, pair % m
    sums, down = prefix_sums(words)
    h = mixed((sums[e[b]] - sums[s[a]]) * down[s[a]] + (e[b] - s[a]).astype(np.uint64))
    return own[a], own[b], h


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What gives polynomial hashes of all runs of words, modulo 2**64: prefix sums and what scales them."""
    n = len(words)
    up, down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, x, dtype=np.uint64)])) for x in (_BASE, _INVERSE))
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(words) * up[:n])]), down


def windows(words: np.ndarray, ends: np.ndarray, size: int = PASSAGE, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, hash and anchor of every run of size words of some texts, in order; the
    anchor is the smallest hash of a run of anchor words inside."""
    n = len(words) - size + 1
    if n < 1:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    sums, down = prefix_sums(words)
    h = mixed((sums[size:] - sums[:-size]) * down[:n])
    least, have, want = mixed((sums[anchor:] - sums[:-anchor]) * down[: len(words) - anchor + 1]), 1, size - anchor + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return text[at], at - ends[text[at]], h[at], least[at]


def covered_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PASSAGE) -> DataFrame:
    """key, later and own: hashes of the runs of size words that a smaller key's text holds too, and
    of those that stand more than once in the text itself."""
    anchor = size // 2

    def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return windows(*word_hashes(pa.array(map(spaced, strings(batch.column(1))), type=pa.string())), size, anchor)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, 1, 1 << 20)):
            at, _, h, least = hashed(batch)
            ids = batch.column(0).to_numpy()
            new = np.ones(len(at), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1])
            order = np.lexsort((h, at))
            same = np.flatnonzero((h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1]))
            again = order[same]
            own = np.concatenate([np.zeros(int(new.sum()), dtype=bool), np.ones(len(again), dtype=bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([least[new], h[again]]).view(np.int64)), pa.array(ids[np.concatenate([at[new], at[again]])]), pa.array(own)], names=["h", "id", "own"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, 1, 1 << 20)):
            at, _, h, least = hashed(batch)
            ids, ends = batch.column(0).to_numpy(), np.searchsorted(at, np.arange(batch.num_rows + 1))
            found = [np.unique(h[a:b][np.isin(least[a:b], x.values.to_numpy().view(np.uint64))]) for a, b, x in zip(ends[:-1], ends[1:], batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in found]))], names=["h", "id"])

    def later(rows: DataFrame) -> DataFrame:
        """Rows whose hash another key holds too, with the smallest key."""
        return rows.join(rows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h", "first"), "h")

    bodies = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    found, _ = kept(bodies.transform(mapped, first, "h long, id long, own boolean"), "passage-anchors")
    shared = cut(later(found.filter("not own").select("h", "id")).groupBy("id").agg(F.collect_set("h").alias("anchors")))
    some, _ = kept(sifted(bodies, "id", shared.select("id")).join(shared, "id").select("id", "t", "anchors").transform(mapped, runs, "h long, id long"), "passage-runs")
    told = later(some).filter("id > first").select("id", "h", F.lit(False).alias("own")).union(found.filter("own").select("id", "h", "own"))
    sets = told.groupBy("id").agg(F.collect_set(F.when(~F.col("own"), F.col("h"))).alias("later"), F.collect_set(F.when(F.col("own"), F.col("h"))).alias("own"))
    return sets.withColumnRenamed("id", key)


def passage_words(text: str, later: np.ndarray, own: np.ndarray, size: int = PASSAGE) -> list[tuple[int, int]]:
    """Where in a text words stand that runs cover: all runs of later, and those of own but for the
    first of equal ones, of which no word goes."""
    words, ends = word_hashes(pa.array([spaced(text)], type=pa.string()))
    _, at, h, _ = windows(words, ends, size, size // 2)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    hit, again = np.isin(h, later), np.isin(h, own) & (first[which] < at)
    begin = np.where(hit, at, np.maximum(at, first[which] + size))[hit | again]
    np.add.at(gone, begin, 1)
    np.add.at(gone, at[hit | again] + size, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(gone)[:-1] > 0, [False]])))
    starts = [*(m.start() for m in _WORD.finditer(text)), len(text)]
    return [(starts[a], starts[b]) for a, b in edges.reshape(-1, 2).tolist()]


def covered_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS, long: int = LONG) -> DataFrame:
    """key and ranges of the texts that hold a non-first span; a range is a whole number, its
    first sentence times 2**32 plus its last one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, 1, 1 << 20)):
            split = [sentences(t) for t in strings(batch.column(1))]
            words, ends = word_hashes(pa.array([spaced(x) for part in split for x in part], type=pa.string()))
            keys, ranges, hashes, again, at = [], [], [], [], 0
            for k, part in zip(batch.column(0).to_pylist(), split):
                e = ends[at : at + len(part) + 1]
                at += len(part)
                a, b, h = spans(words[e[0] : e[-1]], e[1:] - e[0], least_sentences, least_words, long)
                if len(h):
                    first = np.zeros(len(h), dtype=bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    keys.append(np.full(len(h), k))
                    ranges.append(a << 32 | b)
                    hashes.append(h)
                    again.append(~first)
            if keys:
                columns = [np.concatenate(x) for x in (hashes, keys, ranges, again)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], names=["h", "id", "range", "again"])

    bodies = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    found, _ = kept(bodies.transform(mapped, find, "h long, id long, range long, again boolean"), "sentence-spans")
    across = found.filter("not again").groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h", "first")
    later = found.filter("not again").join(across, "h").filter("id > first").select("id", "range")
    within = found.filter("again").select("id", "range")
    return later.union(within).groupBy("id").agg(F.collect_set("range").alias("ranges")).withColumnRenamed("id", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int | None = None, **options) -> DataFrame:
    """docs with every sentence gone that a repeated span covers, but for the span's first
    occurrence: that in the smallest key, and the first one there. With passage, every repeated run
    of so many words goes too, wherever it begins and ends.

    All columns stay as they are but the text; a column n_removed counts the sentences that went,
    whole or in part.
    White space at the end of a changed text goes too, and a text may become empty. Null texts and
    rows with null keys stay as they are, rows that repeat a key count as one document (of equal
    texts neither is removed for the other), and an empty table gives no row.
    """
    if "n_removed" in docs.columns:
        raise ValueError("docs has a column n_removed")
    ranges = covered_spans(docs, key, text, **options).select(F.col(key).alias("__repeat_key"), F.col("ranges").alias("__repeat_ranges"))
    joined = docs.join(ranges, docs[key] == ranges["__repeat_key"], "left").drop("__repeat_key")
    if passage:
        runs = covered_passages(docs, key, text, passage).select(F.col(key).alias("__run_key"), F.col("later").alias("__later_runs"), F.col("own").alias("__own_runs"))
        joined = joined.join(runs, docs[key] == runs["__run_key"], "left").drop("__run_key")
    place, width = docs.columns.index(text), len(docs.columns)
    schema, names = docs.withColumn("n_removed", F.lit(0)).schema, [*docs.columns, "n_removed"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, removed = batch.column(place), [0] * batch.num_rows
            lists, *runs = batch.columns[width:]
            changed = {}
            touched = np.logical_or.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (lists, *runs)])
            for i in np.flatnonzero(touched).tolist():
                whole = column[i].as_py() or ""
                parts = sentences(whole)
                gone = np.zeros(len(parts) + 1, dtype=np.int64)
                for r in lists[i].values.to_pylist() if lists[i].is_valid else ():
                    if (r & 0xFFFFFFFF) < len(parts):
                        gone[r >> 32] += 1
                        gone[(r & 0xFFFFFFFF) + 1] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                cuts = passage_words(whole, *(x[i].values.to_numpy().view(np.uint64) for x in runs), passage) if runs and runs[0].is_valid()[i].as_py() else []
                if keep.all() and not cuts:
                    continue
                left, at = [], 0
                for j, p in enumerate(parts):
                    a, b = at, at + len(p)
                    at = b
                    if not keep[j]:
                        continue
                    while cuts and cuts[0][1] <= a:
                        cuts.pop(0)
                    for x, y in cuts:
                        if x >= b:
                            break
                        left.append(whole[a : max(a, x)])
                        a, keep[j] = min(b, y), False
                    left.append(whole[a:b])
                changed[i] = "".join(left).rstrip()
                removed[i] = int((~keep).sum())
            if changed:
                texts = column.to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                column = pa.array(texts, type=column.type)
            columns = [column if j == place else batch.column(j) for j in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, type=pa.int32())], names=names)

    return joined.transform(mapped, clean, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", "n_removed")
