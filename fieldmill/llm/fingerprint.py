"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low bits.

The shingle hashes of a text are cut once: the high bits choose one of BINS bins, and a bin keeps
the least hash that falls into it. An empty bin takes the value of a bin that a hash of (bin,
attempt) names, with further attempts until that one was filled by a shingle, however many it takes;
attempts are the same for all texts, so equal sets fill alike. Only the low BITS bits of a bin's
value are kept. Bins of unlike texts then agree by chance once in 2**BITS, so likeness corrects
for that: (share of equal bins - 2**-BITS) / (1 - 2**-BITS), held to 0..1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mixed, pieces, runs_hashed, strings, word_hashes

BINS, BITS, SHINGLE = 256, 4, 5
TABLE = 1024  # attempts that are held ready; later ones are computed when met


def attempts(bins: int, first: int, many: int) -> np.ndarray:
    """The bins that attempts first, first + 1, ... name, a row for each."""
    seeds = np.arange(first * bins, (first + many) * bins, dtype=np.uint64).reshape(many, bins)
    return (mixed(mixed(seeds + np.uint64(0x51ED270B)) ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bins)).astype(np.int32)


class Fingerprints:
    """of(text) gives the packed bytes; an empty array of shingles gives all zero bits."""

    def __init__(self, k: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, and bits 1, 2, 4 or 8")
        self.k, self.bins, self.bits = k, bins, bits
        self.table = attempts(bins, 0, TABLE)
        self.shift = np.uint64(64 - bins.bit_length() + 1)

    def lows(self, texts: list[str]) -> list[np.ndarray | None]:
        words, ends = word_hashes(pa.array(texts, type=pa.string()))
        return [self.low(words[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def low(self, words: np.ndarray) -> np.ndarray | None:
        """The low bits of every bin, None for a text without words."""
        h = runs_hashed(words, self.k)
        if not len(h):
            return None
        h = np.sort(mixed(h))
        at = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        value, full = np.zeros(self.bins, dtype=np.uint64), np.zeros(self.bins, dtype=bool)
        value[at[first]], full[at[first]] = h[first], True
        if len(first) == 1:
            value[:] = h[0]  # whatever the attempts, they end there
        else:
            self.densify(value, full)
        return (mixed(value) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def densify(self, value: np.ndarray, full: np.ndarray) -> None:
        """Give every empty bin the value of the first filled bin that its attempts name."""
        empty, at, many = np.flatnonzero(~full), 0, 8
        while len(empty):
            donor = (self.table[at : at + many] if at + many <= TABLE else attempts(self.bins, at, many))[:, empty]
            hit = full[donor]
            met = hit.any(axis=0)
            value[empty[met]] = value[donor[hit.argmax(axis=0), np.arange(len(empty))][met]]
            empty, at, many = empty[~met], at + many, min(2 * many, 256)

    def pack(self, low: np.ndarray | None) -> bytes:
        """Prefixed by a byte that tells whether there were words."""
        if low is None:
            return bytes(1 + self.bins * self.bits // 8)
        per = 8 // self.bits
        parts = low.reshape(-1, per)
        out = np.zeros(len(parts), dtype=np.uint8)
        for i in range(per):
            out |= parts[:, i] << np.uint8(i * self.bits)
        return b"\1" + out.tobytes()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """1 for two texts without words, 0 for one of them."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def edited(text: str, other: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see edited) with the next document
    in ascending key order, the first one after the last.

    Columns: key, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited and
    near_next (likeness to the edited text and to the next document).

    Rows are dealt once into key ranges; the first row of a range is also sent to the range before
    it, so no other row moves twice. A null text is empty; null keys come first; rows with equal
    keys follow one another by text; a lone row is its own next; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the summaries behind the quantiles have a bounded size; a key beyond 2**53 may fall to a neighbouring range
    cuts = sorted(set(rows.stat.approxQuantile("k", [i / n for i in range(1, n)], max(0.2 / n, 1e-5)))) if n > 1 else []
    cuts = np.array(cuts, dtype=np.int64)
    out_schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def parts_of(keys: pa.Array) -> np.ndarray:
        part = np.searchsorted(cuts, keys.fill_null(0).to_numpy(), side="right")
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, part)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(parts_of(batch.column(0))), batch.column(0)], names=["part", "k"])

    least = F.min(F.struct(F.col("k").isNotNull().alias("have"), "k")).alias("f")
    firsts = rows.select("k").transform(mapped, parts, "part long, k long").groupBy("part").agg(least).select("part", "f.k").orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], out_schema)
    # the row that opens a range closes the range before; of rows with that key, the first by text
    opens = {(r.part, r.k): firsts[i - 1].part for i, r in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = parts_of(batch.column(0))
            before = [opens.get(x) for x in zip(part.tolist(), batch.column(0).to_pylist())]
            again = np.array([i for i, x in enumerate(before) if x is not None], dtype=np.int64)
            names = ["k", "t", "part", "tail"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.zeros(batch.num_rows, dtype=np.int32))], names=names)
            if len(again):
                moved = pa.array([before[i] for i in again], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(again)).columns, moved, pa.array(np.ones(len(again), dtype=np.int32))], names=names)

    sent = rows.transform(mapped, deal, "k long, t string, part long, tail int")
    # a range is a partition, and so a task
    dealt = sent.repartitionById(max(1, len(cuts) + 1), F.col("part").cast("int")).sortWithinPartitions("part", "tail", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprints(k, bins, bits)
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None  # part, key, text, low bits of the row whose next is still to come
        closed = None  # a part that has met its closing row
        for batch in (part for batch in batches for part in pieces(batch, 1)):
            made: list[list] = [[] for _ in names]
            pairs: list[tuple] = []  # a row and the next one
            texts = strings(batch.column(1))
            for i, t, low, p, tail in zip(batch.column(0).to_pylist(), texts, fp.lows(texts), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tail and closed == p:
                    continue
                if last is not None and last[0] == p:
                    pairs.append((last, t, low))
                if tail:
                    closed, last = p, None
                else:
                    last = (p, i, t, low)
            changed = [edited(x[2], t) for x, t, _ in pairs]
            for ((_, j, s, own), _, low), e, other in zip(pairs, changed, fp.lows(changed)):
                row = (j, len(s), hashlib.sha256(e.encode()).hexdigest(), fp.pack(own).hex(), fp.pack(other).hex(), fp.likeness(own, other), fp.likeness(own, low))
                for column, x in zip(made, row):
                    column.append(x)
            if made[0]:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(made, kinds)], names=names)

    return dealt.transform(mapped, run, out_schema)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
