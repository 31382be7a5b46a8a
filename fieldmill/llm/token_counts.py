"""Token counts by a unigram model, with forward scores shared along a trie of pre-tokens.

The pieces are those of a byte-level vocabulary file, in its order; a piece's log-probability
follows Zipf's law in its rank, log(1 / (rank + OFFSET)), held as a whole number of 2**-16 so that
sums are exact. A pre-token is cut into the pieces of the greatest total, ties by fewer pieces, and
its count is their number. A text's count is the sum over its pre-tokens.

The best cut of a prefix doesn't depend on what follows. So the distinct pre-tokens of a batch are
inserted in a trie in byte order, and each node holds the forward score and piece count of its
prefix, computed once from the nodes above it; a terminal node's count is stored for its
pre-token. In that order the trie needs only the path of nodes that is open just now.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, Remembered
from .tokens import SPACES

OFFSET, SCALE = 2.7, 1 << 16
_WORKER: dict[str, "Unigram"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Unigram:
    """Scores of pieces, and counts of pre-tokens by the trie."""

    def __init__(self, path: str, remembered: int = 250_000):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.score = {piece: -round(SCALE * math.log(rank + OFFSET)) for piece, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.score]
        if missing:
            raise ValueError(f"{path} lacks single bytes: {missing[:5]}")
        self.longest = max(map(len, self.score))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known = Remembered(lambda w: None, remembered)

    @classmethod
    def of(cls, path: str) -> "Unigram":
        """One per Python worker and file."""
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def trie_counts(self, words: list[str]) -> dict[str, int]:
        """The counts of distinct pre-tokens: one pass over their trie in byte order."""
        score, longest = self.score.get, self.longest
        order = sorted((w.encode(), w) for w in words)
        totals, counts = [0], [0]  # forward score and pieces of the open path's nodes
        before, out = b"", {}
        for w, name in order:
            shared, end = 0, min(len(before), len(w))
            while shared < end and before[shared] == w[shared]:
                shared += 1
            del totals[shared + 1 :], counts[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                best, fewest = None, 0
                for j in range(max(0, i - longest), i):
                    s = score(w[j:i])
                    if s is not None:
                        s += totals[j]
                        if best is None or s > best or (s == best and counts[j] < fewest):
                            best, fewest = s, counts[j]
                totals.append(best)
                counts.append(fewest + 1)
            before = w
            out[name] = counts[-1]
        return out

    def batch(self, column: pa.Array) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of every text of a column; both 0 for null and empty texts.

        Texts without two white-space characters together are cut before every space, and the
        distinct parts are cut into pre-tokens once.
        """
        column = pc.fill_null(column, "")
        plain = pc.invert(pc.match_substring_regex(column, SPACES)).to_pylist()
        lists = pc.split_pattern(column, " ")
        ends = pc.list_value_length(lists).to_pylist()
        coded = lists.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        split, known, a, firsts, others = self.split, self.known, 0, [], {}
        for i, n in enumerate(ends):
            firsts.append(split(parts[codes[a]]) if plain[i] else split(column[i].as_py()))
            a += n
        cut = []
        for w in parts:
            if w.isalpha():
                cut.append((" " + w,))
            elif w[:-1].isalpha() and w[-1] in ".,":
                cut.append((" " + w[:-1], w[-1]))
            else:
                cut.append(split(" " + w))
        for group in (cut, firsts):
            for words in group:
                for w in words:
                    if w not in known:
                        found = known.old.get(w)
                        if found is None:
                            others[w] = 0
                        else:
                            known[w] = found
        known.update(self.trie_counts(list(others)))
        get = known.__getitem__
        many = pa.array([len(x) for x in cut], type=pa.int64()).to_numpy()
        total = pa.array([sum(map(get, x)) for x in cut], type=pa.int64()).to_numpy()
        n_pre, n_tok, a = [], [], 0
        for i, n in enumerate(ends):
            own = codes[a + 1 : a + n] if plain[i] else codes[:0]
            n_pre.append(len(firsts[i]) + int(many[own].sum()))
            n_tok.append(sum(map(get, firsts[i])) + int(total[own].sum()))
            a += n
        known.trim()
        return n_pre, n_tok


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_pretokens and n_tokens of every whole text; other columns are ignored.

    Null and empty texts count 0 of both, null keys stay null, repeated rows are counted each by
    itself, and an empty table gives no row. Nothing is shuffled: every task counts its own rows,
    and a worker keeps the counts of a fixed number of pre-tokens.
    """
    vocabulary = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.of(vocabulary)
        for batch in batches:
            for part in pieces(batch, 1):
                pre, tok = model.batch(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pre, type=pa.int64()), pa.array(tok, type=pa.int64())], names=[key, "n_pretokens", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).transform(mapped, run, f"`{key}` long, n_pretokens long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
