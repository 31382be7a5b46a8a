"""Packing documents into training sequences by order-preserving dynamic programming.

The ids of the documents of an input partition form one stream, in their order. Sequences are
windows of that stream, so packing only chooses where to cut. Cuts at document ends are free,
cuts at sentence ends cost a penalty, and a window shorter than the length costs its padding, all
counted in ids. A cut inside a sentence costs a quarter of a window, so a sentence is cut only where
its ends would leave as much padding, as where it is longer than a window. With f(i) the least cost of a stream cut at candidate i,

    f(i) = cut(i) + min over m, j of f(j) + m * hard + length * (m + 1) - (i - j)

where m full windows between j and i are cut inside sentences. For each m the candidates j with
length * m < i - j <= length * (m + 1) form a sliding window, whose least f(j) + j stands at the
head of a monotone queue for m = 0; for larger m all of it is known a length before, so these are
found for all candidates of a length at once. The programme runs over a block of ids at a time; what follows the last
cut but two of a block opens the next one, so memory stays bounded and a cut is never placed blind.
So the cuts are the best of each block, given where it begins, not of the whole stream at once.

Sequences that are as long as a power of two need no padding: the last window of a partition, which
alone may be far from full, is split into such lengths where the cuts, at TAIL each, cost less than
its padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces
from .tokens import Encoder, default_path

LENGTH, SENTENCE, HARD, TAIL = 2048, 1, 512, 4
#: A worker takes so many bytes of its texts in one go; what words of more would take stays beside the encoder.
PART = 2 << 20
FAR = 1 << 62
FULL = 2  # at most so many full windows in a row are cut inside sentences, but for longer sentences
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(candidates: np.ndarray, penalties: np.ndarray, length: int = LENGTH, hard: int = HARD, full: int = FULL) -> list[int]:
    """Where to cut a stream from 0 to the last candidate: the ends of the windows.

    candidates ascend; penalties[i] is what a cut there costs (the last one is where the stream
    ends). Gaps too long for any transition get further candidates at the hard penalty.
    """
    if not len(candidates):
        return []
    reach = length * (full + 1)
    gaps = np.diff(np.concatenate([[0], candidates]))
    for k in np.flatnonzero(gaps > reach):
        end = int(candidates[k])
        more = np.arange(end - int(gaps[k]) + length, end, length)
        candidates, penalties = np.concatenate([candidates, more]), np.concatenate([penalties, np.full(len(more), hard)])
    order = np.argsort(candidates, kind="stable")
    at = np.concatenate([[0], candidates[order]]).astype(np.int64)
    cost = np.concatenate([[0], penalties[order]]).astype(np.int64)
    n, g = len(at), np.zeros(len(at), dtype=np.int64)  # f(i) + at(i)
    places, prices = at.tolist(), cost.tolist()
    least: deque[tuple[int, int]] = deque()  # the queue of m = 0; for m > 0 all of a window is known a length before
    a, before = 1, 0
    while a < n:
        b = int(np.searchsorted(at, places[a] + length))
        far = np.full(b - a, FAR)
        for m in range(1, full + 1):
            lo, hi = np.searchsorted(at, at[a:b] - length * (m + 1)), np.searchsorted(at, at[a:b] - length * m)
            some = np.flatnonzero(lo < hi)
            if len(some):
                ends = np.stack([lo[some], hi[some]], axis=1).ravel()
                far[some] = np.minimum(far[some], np.minimum.reduceat(g[:b], ends)[::2] + m * hard + length * (m + 1))
        for i, other in zip(range(a, b), far.tolist()):
            while least and least[-1][0] >= before:
                least.pop()
            least.append((before, places[i - 1]))
            oldest = places[i] - length
            while least and least[0][1] < oldest:
                least.popleft()
            if least and least[0][0] + length < other:
                other = least[0][0] + length
            g[i] = before = other + prices[i]
        a = b
    out, i = [], n - 1
    while i:
        x, want = places[i], int(g[i]) - prices[i]
        for m in range(full + 1):
            lo, hi = np.searchsorted(at, (x - length * (m + 1), x - length * m))
            fits = np.flatnonzero(g[lo:hi] == want - m * hard - length * (m + 1))
            if len(fits):
                break
        i = int(lo + fits[-1])
        out += [x, *(places[i] + length * s for s in range(m, 0, -1))]
    return out[::-1]


def powers(rest: int, length: int, tail: int) -> list[int]:
    """Lengths for a last window of rest ids: itself, or powers of two where that costs less."""
    split = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return split if (len(split) - 1) * tail < length - rest else [rest]


class Packer:
    """Takes documents one after another and gives pieces for a partition."""

    def __init__(self, ends: np.ndarray, length: int, sentence: int, hard: int, full: int, first: int, block: int):
        self.ends, self.length, self.sentence, self.hard, self.full, self.next, self.block = ends, length, sentence, hard, full, first, block
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, how many of them are gone
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        if self.held >= self.block:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        if not self.held:
            return
        at, spots, costs = 0, [], []
        for _, ids, gone in self.docs:
            left = ids[gone:]
            inner = np.flatnonzero(self.ends[left]) + 1
            inner = inner[inner < len(left)]
            spots += [inner + at, [at + len(left)]]
            costs += [np.full(len(inner), self.sentence), [0]]
            at += len(left)
        chosen = cuts(np.concatenate(spots).astype(np.int64), np.concatenate(costs).astype(np.int64), self.length, self.hard, self.full)
        if last:
            start = chosen[-2] if len(chosen) > 1 else 0
            chosen = chosen[:-1] + (start + np.cumsum(powers(at - start, self.length, TAIL))).tolist()
        else:
            chosen = chosen[:-2]
        self.emit(chosen)

    def emit(self, chosen: list[int]) -> None:
        done, d = 0, 0
        for end in chosen:
            offset = 0
            while done < end:
                doc_id, ids, gone = self.docs[d]
                take = min(end - done, len(ids) - gone)
                piece = ids[gone : gone + take]
                self.out.append((doc_id, gone, take, zlib.crc32(piece.astype("<u4")), len(ids), self.next, offset))
                done, offset = done + take, offset + take
                self.docs[d] = (doc_id, ids, gone + take)
                d += gone + take == len(ids)
            self.next += 1
        self.docs = self.docs[d:]
        self.held -= done


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, sentence: int = SENTENCE, hard: int = HARD, full: int = FULL, block: int = 400_000) -> DataFrame:
    """One row per piece of a document in a sequence: key, start and length in the document's ids,
    ids_crc32, doc_tokens (with the end id), sequence_id and offset in the sequence.

    Documents keep the order in which their input partition has them, and no row is shuffled; sort
    docs before for another order. A null text is empty and packs as its end id alone, a null key
    stays null, equal rows are packed each by itself, an empty table gives no row, and other
    columns are ignored. Sequence ids are unique but not gapless: the partition is in the high bits.
    """
    if length & (length - 1) or block < 8 * length:
        raise ValueError("length must be a power of two, and block at least eight times as much")
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer)
        if not hasattr(enc, "ends"):
            enc.ends = enc.sentence_ends()
        packer = Packer(enc.ends, length, sentence, hard, full, TaskContext.get().partitionId() << 33, block)
        tail = np.array([end_id], dtype=enc.dtype).tobytes()

        def rows() -> pa.RecordBatch:
            made, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*made)], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in pieces(batch, 1, PART):
                for doc_id, raw in zip(part.column(0).to_pylist(), enc.batch(part.column(1))):
                    packer.add(doc_id, np.frombuffer(raw + tail, dtype=enc.dtype))
                if packer.out:
                    yield rows()
                pa.default_memory_pool().release_unused()  # else what a piece took stays beside the next one's
        packer.pack(last=True)
        if packer.out:
            yield rows()

    return docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).transform(mapped, run, PIECES.replace("doc_id", f"`{key}`", 1))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
