"""Grouping spelling variants: words one edit apart, by two-dimensional range reporting.

Words of one length are ranked in forward and in reverse order, a word being the point (forward rank,
reverse rank). For an edit at position i, the words that share the first i letters are an interval of
forward ranks, those that share the letters behind an interval of reverse ranks; words of the same
length in both are replacements at i, words longer by one are insertions before i. A wavelet tree over
the reverse ranks in forward order reports what lies in both intervals, at a cost by what it reports.

Trees are built part by part. A pair of words of class L (lengths L, or L and L + 1) whose edit lies in
a window of positions shares all letters outside it, so the words are dealt by class, window and the
hash of these letters: first by the two halves, and where many meet, by halves of the window again,
down to single positions, where only words of one or two free letters can meet. Each pair is reported
for one position alone (of several an insertion can stand at, the first), so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import crcs, shifted, stretches
from .common import cut, kept, mapped, pieces, scope

LEAST_LETTERS, LEAST_COUNT, DROPPED, STRONGER = 5, 3, 97, 2
#: Words are dealt to so many cells; a cell of more than MEET words is dealt anew by halved windows; a task has about PART words.
CELLS, MEET, PART = 1 << 20, 50_000, 200_000
#: Queries that go down a tree together.
TOGETHER = 1 << 19

#: Lower-case letters for A-Z and a-z, and the first byte of U+00C0 to U+00FF; its second byte belongs to it.
LETTER = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b == 0xC3 else 0 for b in range(256)], dtype=np.uint8)


# words


def _crc_of_keys(keys: pa.Array) -> np.ndarray:
    text = pc.binary_join_element_wise(pc.fill_null(keys.cast(pa.string()), ""), ":", "")
    data = [x.as_py().encode() for x in text]
    ends = np.cumsum([0, *map(len, data)])
    return crcs(np.frombuffer(b"".join(data), dtype=np.uint8), ends[:-1], np.diff(ends))


def _without(word: bytes, h: int) -> bytes:
    w = word.decode()
    i = h % len(w)
    return (w[:i] + w[i + 1 :]).encode()


def words_of(keys: pa.Array, texts: pa.Array, dropped: int = DROPPED) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct words of texts and their counts, part by part; where dropped divides the checksum of an
    occurrence, without a letter."""
    of_key = _crc_of_keys(keys)
    for data, starts, lengths, owners in stretches(texts, LETTER, joint=0xC3):
        if not len(starts):
            continue
        ends = np.concatenate([[0], np.cumsum(lengths)])
        packed = data[data != 0]
        c = crcs(packed, ends[:-1], lengths)
        h = shifted(of_key[owners], lengths) ^ c
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        codes, hit = coded.indices.to_numpy(), np.flatnonzero(h % np.uint32(dropped) == 0)
        keep = np.ones(len(codes), dtype=bool)
        keep[hit] = False
        counts = np.bincount(codes[keep], minlength=len(coded.dictionary))
        left = [_without(words[i].as_py(), int(h[i])) for i in hit.tolist()]
        yield pa.concat_arrays([coded.dictionary, pa.array(left, type=pa.large_binary())]), np.append(counts, np.ones(len(left), dtype=np.int64))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", dropped: int = DROPPED, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words of at least least_letters letters and least_count occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                for words, n in words_of(part.column(0), part.column(1), dropped):
                    words = words.cast(pa.large_string())
                    keep = pa.array((n > 0) & (pc.utf8_length(words).to_numpy() >= least_letters))
                    yield pa.RecordBatch.from_arrays([words.filter(keep).cast(pa.string()), pa.array(n).filter(keep)], names=["word", "n"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.transform(mapped, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# range reporting


class WaveletTree:
    """A sequence of the numbers 0 to m - 1, level by level from their highest bit: at each level, how
    many zeros stand before each place, and the zeros before the ones on the level below."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(len(sequence) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (sequence >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def report(self, first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its number and every value from low to before high at places first to before end."""
        query, value = np.arange(len(first)), np.zeros(len(first), dtype=np.int64)
        alive = (first < end) & (low < high)
        query, value, a, b = query[alive], value[alive], first[alive], end[alive]
        for level, zeros in enumerate(self.zeros):
            bit = self.bits - 1 - level
            a0, b0, all0 = zeros[a], zeros[b], zeros[-1]
            query = np.concatenate([query, query])
            value = np.concatenate([value, value | (1 << bit)])
            a, b = np.concatenate([a0, all0 + a - a0]), np.concatenate([b0, all0 + b - b0])
            alive = (a < b) & (value < high[query]) & (value + (1 << bit) > low[query])
            query, value, a, b = query[alive], value[alive], a[alive], b[alive]
        return query, value


class Points:
    """Words of one length as points, with intervals by what they begin and end with."""

    def __init__(self, letters: np.ndarray, numbers: np.ndarray):
        """letters: a row of code points a word; numbers: what report() gives for a word."""
        self.size = letters.shape[1]
        forward = np.argsort(_joined(letters), kind="stable")
        back = np.argsort(_joined(letters[:, ::-1]), kind="stable")
        rank = np.empty(len(back), dtype=np.int64)
        rank[back] = np.arange(len(back))
        self.by_front, self.by_back, self.numbers = letters[forward], letters[back][:, ::-1], numbers[back]
        self.tree = WaveletTree(rank[forward])

    def near(self, fronts: np.ndarray, backs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of first letters and of last ones: the row's number, and each word that has both."""
        first, end = _interval(self.by_front, fronts)
        low, high = _interval(self.by_back, backs[:, ::-1])
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for a in range(0, len(first), TOGETHER):
            q, v = self.tree.report(first[a : a + TOGETHER], end[a : a + TOGETHER], low[a : a + TOGETHER], high[a : a + TOGETHER])
            found.append((q + a, self.numbers[v]))
        return tuple(map(np.concatenate, zip(*found)))


def _joined(letters: np.ndarray) -> np.ndarray:
    """Rows of code points as strings, which numpy orders by code point."""
    letters = np.ascontiguousarray(letters)
    return letters.view(f"U{letters.shape[1]}").ravel() if letters.shape[1] else np.zeros(len(letters), dtype="U1")


def _interval(rows: np.ndarray, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows stand, in order, that begin with each of fronts."""
    k = fronts.shape[1]
    if not k:
        return np.zeros(len(fronts), dtype=np.int64), np.full(len(fronts), len(rows))
    have, asked = _joined(rows[:, :k]), _joined(fronts)
    distinct, where = np.unique(asked, return_inverse=True)
    return np.searchsorted(have, distinct, "left")[where], np.searchsorted(have, distinct, "right")[where]


def pairs(words: np.ndarray, numbers: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words (of length letters, or one more) and of their near words in the class,
    with an edit at a position from low to before high; words are strings, each there once."""
    size = np.char.str_len(words)
    same, more = np.flatnonzero(size == length), np.flatnonzero(size == length + 1)
    if not len(same):
        return
    letters = words[same].astype(f"U{length}").view(np.uint32).reshape(-1, length)
    own = Points(letters, np.arange(len(same))) if len(same) > 1 else None
    longer = words[more].astype(f"U{length + 1}").view(np.uint32).reshape(-1, length + 1)
    other = Points(longer, np.arange(len(more))) if len(more) else None
    for i in range(low, min(high, length + 1)):
        if own and i < length:  # replaced at i
            q, v = own.near(letters[:, :i], letters[:, i + 1 :])
            q, v = q[q != v], v[q != v]
            yield numbers[same[q]], numbers[same[v]]
        if other:  # inserted before i, as the first of equal letters
            q, v = other.near(letters[:, :i], letters[:, i:])
            if i:
                new = longer[v, i] != longer[v, i - 1]
                q, v = q[new], v[new]
            yield numbers[same[q]], numbers[more[v]]
            yield numbers[more[v]], numbers[same[q]]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (word, n, class, low, high) with the cell of what lies outside their window."""
    keep = F.greatest(F.col("class") - F.col("high"), F.lit(0))
    outside = (F.substring("word", F.lit(1), F.col("low")), F.when(keep > 0, F.substring("word", F.length("word") - keep + 1, keep)).otherwise(F.lit("")))
    return rows.withColumn("cell", F.pmod(F.xxhash64("class", "low", "high", *outside), F.lit(CELLS)))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row for both halves of its window."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    return _dealt(rows.select("word", "n", "class", F.explode(halves).alias("w")).select("word", "n", "class", "w.*"))


def near_words(words: DataFrame, meet: int = MEET, part: int = PART) -> DataFrame:
    """word, n_near and the near word of largest n (ties: smallest) as best_n and best, of every word of
    words (word, n; each word once) that has a near one.

    The sizes of cells, a table of at most CELLS rows, are broadcast to choose what is dealt anew.
    """
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("class")).withColumn("low", F.lit(0)).withColumn("high", F.col("class") + 1)
    rows, _ = kept(_halved(classes), "windows")
    while True:
        full = cut(rows.filter("high - low > 1").groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > meet).select("cell"))
        if full.isEmpty():
            break
        wide = F.col("high") - F.col("low") > 1
        narrow = rows.filter(wide).join(F.broadcast(full), "cell", "left_semi").select(*rows.columns)
        rows, _ = kept(rows.filter(wide).join(F.broadcast(full), "cell", "left_anti").select(*rows.columns).unionByName(rows.filter(~wide)).unionByName(_halved(narrow)), "windows")
    parts = -(-rows.count() // part) or 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # about part rows
        if not got:
            return
        table = pa.Table.from_batches(got)
        window = np.stack([table[c].to_numpy() for c in ("class", "low", "high")], axis=1)
        kinds, kind = np.unique(window, axis=0, return_inverse=True)
        word, n = table["word"].combine_chunks(), table["n"].to_numpy()
        order = np.argsort(kind.ravel(), kind="stable")
        ends = np.searchsorted(kind.ravel()[order], np.arange(len(kinds) + 1))
        for k, (length, low, high) in enumerate(kinds.tolist()):
            mine = order[ends[k] : ends[k + 1]]
            texts = word.take(pa.array(mine))
            rank = np.empty(len(mine), dtype=np.int64)  # by word, for ties
            rank[pc.array_sort_indices(texts).to_numpy()] = np.arange(len(mine))
            strength = n[mine]
            many, best = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), -1, dtype=np.int64)
            for a, b in pairs(np.array(texts.to_pylist(), dtype=f"U{length + 1}"), np.arange(len(mine)), length, low, high):
                many += np.bincount(a, minlength=len(mine))
                by = np.lexsort((rank[b], -strength[b], a))
                a, b = a[by], b[by]
                lead = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
                a, b = a[lead], b[lead]
                had = best[a]
                better = (had < 0) | (strength[b] > strength[had]) | (strength[b] == strength[had]) & (rank[b] < rank[had])
                best[a[better]] = b[better]
            out = np.flatnonzero(many)
            if len(out):
                yield pa.RecordBatch.from_arrays([texts.take(pa.array(out)), pa.array(many[out]), pa.array(strength[best[out]]), texts.take(pa.array(best[out]))], names=["word", "n_near", "best_n", "best"])

    found = rows.repartition(parts, "cell").select("word", "n", "class", "low", "high").transform(mapped, search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _rooted(words: DataFrame) -> DataFrame:
    """words (word, form and more) with root, the end of the chain of forms. Counts double along a
    chain, so it is short; pointers are doubled, so rounds grow with the logarithm of its length."""
    up = cut(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return words.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", dropped: int = DROPPED, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs that is long and frequent enough.

    Null and empty texts have no words, a null key stands as an empty one in the checksum, rows that
    repeat a key or a text count each, texts and words of any length are taken whole, and an empty table
    gives no row. Of near words of equal n the first in code-point order is the form. Other columns are
    left out, whatever their names.
    """
    with scope(docs.sparkSession) as own:
        words, _ = kept(count_words(docs, key, text, dropped, least_letters, least_count), "words")
        told = words.join(near_words(words), "word", "left")
        strong = F.col("best_n") >= STRONGER * F.col("n")
        table, _ = kept(told.select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
        out, path = kept(_rooted(table).select("word", "form", "root", "n", "n_near", "form_n"), "spelling")
        own.keep(path)
    return out


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group the spelling variants of all documents' words."""
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
