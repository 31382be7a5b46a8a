"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

A word's score in a language is the sum of the log-probabilities of its letter trigrams there
(letters with what stands before and behind them, edges included), learned by counting. The word's
script leaves as candidates the languages that use it. Over the words of a text the best sequence
of languages is found where every switch costs a penalty, so that single words don't break a span
and a passage in another language does. A text's language is that with most letters in its spans,
and its score is their share.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces

CELLS = 1 << 18
PENALTY = 12.0
SAMPLE = 1500  # labelled texts a language that the trigram counts are learned from, in expectation
OFF_SCRIPT = -50.0
SCRIPT_SHARE = 0.02
#: First code points of script ranges; what lies before the first is Latin too.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])
_TABLES: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter; made once per worker."""
    if not _TABLES:
        _TABLES.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _TABLES[0]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the letter trigrams of all words (which hold no space), the word of each, its script."""
    points = np.frombuffer(("  " + " ".join(words) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    code = np.where(is_letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    owner = np.cumsum(points == 32)[at] - 2
    h = (code[at - 1] * np.uint64(0x1F35 << 42 | 1) + code[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
    scripts = SCRIPT_OF[np.searchsorted(STARTS, points[at], side="right") - 1]
    return (h >> np.uint64(46)).astype(np.int64), owner, scripts


class Model:
    """Trigram log-probabilities and scripts of the learned languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=0)
        kinds = max(1, int((counts.sum(axis=1) > 0).sum()))
        self.table = np.log((counts + 0.1) / (total + 0.1 * kinds)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= SCRIPT_SHARE  # script, language

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words (by language) and how many letters they have."""
        cells, owner, scripts = trigrams(words)
        n = np.bincount(owner, minlength=len(words))
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        if len(cells):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            mine = owner[first]
            out[mine] = np.add.reduceat(self.table[cells], first, axis=0)
            can = self.uses[scripts[first]]  # the script of a word is that of its first letter
            can |= ~can.any(axis=1, keepdims=True)
            out[mine] += np.where(can, 0, OFF_SCRIPT).astype(np.float32)
        return out, n

    def label(self, scores: np.ndarray, ends: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The language number of every word; scores of all words, ends where texts end. All texts
        take a step at a time, the longest first, so that a step is a few array operations."""
        n, k = scores.shape
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        state = np.min_scalar_type(max(k - 1, 0))
        out = np.zeros(n, dtype=state)
        if not len(order):
            return out
        begin, size = starts[order], sizes[order]
        steps = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        back = np.zeros((n, k), dtype=state)
        own = np.arange(k, dtype=state)
        v = scores[begin].astype(np.float64)
        for t in range(1, steps):
            m = alive[t]
            w, at = v[:m], begin[:m] + t
            top = w.argmax(axis=1)
            change = (w[np.arange(m), top] - penalty)[:, None]
            stay = w >= change
            back[at] = np.where(stay, own, top[:, None])
            v[:m] = scores[at] + np.where(stay, w, change)
        state = v.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = alive[t]
            at = begin[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, state[:m]] if t else state[:m]
        return out


def held_out(key: str):
    """Whether a text is kept from training: crc32 of its key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows with a language that aren't held out.

    Counts come from about sample rows of each language (all where there are fewer), chosen by a
    hash of the key; the table of counts has a fixed number of cells for each language.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    many = {r.l: r.c for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("c")).collect()}
    langs = sorted(many)
    if not langs:
        return Model([], np.zeros((CELLS, 0)), np.zeros((len(NAMES), 0)))
    number = F.lit(None).cast("int")
    chosen = F.lit(False)
    for i, l in enumerate(langs):
        number = F.when(F.col("l") == l, i).otherwise(number)
        chosen = F.when(F.col("l") == l, F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / many[l]))).otherwise(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, 1, 1 << 20)):
            lists = pc.ascii_split_whitespace(pc.utf8_lower(batch.column(1)))
            words = lists.flatten().to_pylist()
            cells, owner, scripts = trigrams(words)
            mine = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(lists).to_numpy())[owner].astype(np.int64)
            for kind, value in ((0, cells), (1, scripts)):
                each, n = np.unique(mine * CELLS + value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), kind, dtype=np.int32)), pa.array(each), pa.array(n.astype(np.int64))], names=["kind", "cell", "n"])

    found = rows.filter(chosen).select(number.alias("i"), "t").transform(mapped, count, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (found.column(c).to_numpy() for c in ("kind", "cell", "n"))
    counts, scripts = np.zeros((CELLS, len(langs))), np.zeros((len(NAMES), len(langs)))
    for k, into in ((0, counts), (1, scripts)):
        c = cell[kind == k]
        into[c % CELLS, c // CELLS] = n[kind == k]
    return Model(langs, counts, scripts)


SPANS = "array<struct<lang:string,words:int>>"


def _labelled(model: Model, column: pa.Array, penalty: float) -> list[pa.Array]:
    """lang_pred, score and spans of a column of texts."""
    k, rows = len(model.langs), len(column)
    names = np.array([*model.langs, "und"], dtype=object)
    pred, share = np.full(rows, k), np.zeros(rows)
    offsets, spans, lengths = np.zeros(rows + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if k:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(column, "")))
        coded = lists.flatten().dictionary_encode()
        scores, letter = model.scores(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy())
        keep = letter[code] > 0
        code, row = code[keep], row[keep]
        labels = model.label(scores[code], np.searchsorted(row, np.arange(rows), side="right"), penalty).astype(np.int64)
        weight = np.bincount(row * k + labels, weights=letter[code], minlength=rows * k).reshape(rows, k)
        total = weight.sum(axis=1)
        have = total > 0
        pred[have] = weight[have].argmax(axis=1)
        share[have] = weight[have].max(axis=1) / total[have]
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])]))
            spans, lengths = labels[first], np.diff(np.append(first, len(row)))
            offsets = np.searchsorted(row[first], np.arange(rows + 1), side="left")
    structs = pa.StructArray.from_arrays([pa.array(names[spans], type=pa.string()), pa.array(lengths, type=pa.int32())], names=["lang", "words"])
    return [pa.array(names[pred], type=pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), structs)]


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and spans (language and number of words with letters, in order).

    lang_pred is a learned language, or und with score 0 for texts that are null or have no letter
    (and for all texts if nothing was learned). Letters of scripts that no learned language uses
    leave all as candidates. Any number of languages may be learned. Rows are labelled each by itself from their text alone, ties fall to
    the first language by name, an empty table gives no row; columns of the new names are an
    error. No row is shuffled.
    """
    new = ("lang_pred", "score", "spans")
    clash = [c for c in docs.columns if c in new]
    if clash:
        raise ValueError(f"docs has columns {clash}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language
    place, names = docs.columns.index(text), [*docs.columns, *new]
    schema = docs.select("*", F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.array().cast(SPANS).alias(new[2])).schema

    most = (8 << 20) // max(4, len(model.langs))  # scores are held for every word and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, place, most)):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_labelled(shared.value, batch.column(place), penalty)], names=names)

    return docs.transform(mapped, run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
