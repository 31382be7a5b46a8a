"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The library splits a text into pre-tokens by a fixed pattern and encodes each by itself, so the
ids of a text are the joined ids of its pre-tokens. A pre-token holds a space at its front or is
white space altogether. So where no two white-space characters stand together, a text may be cut
before every space, and each distinct part of a batch is encoded once. Pre-tokens repeat from batch
to batch, hence every Python worker keeps the ids of those met lately, up to a fixed number, in flat
arrays: as Python objects they would take several times the memory.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Remembered

SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}][\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTERS = _letters()
_WORKER: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def joined(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of values, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """The ids that encode(text, add_special_tokens=False) of the library gives, as bytes of dtype (two
    bytes an id where the vocabulary allows it). As there, an added token that stands in a text, such as
    <|endoftext|>, is cut out first and becomes its own id."""

    def __init__(self, path: str, remembered: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Whether such a token takes white space or whole words with it; the library then cuts by itself.
        self.wide = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = self.dtype.char
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.cache = Remembered(self.model_ids, remembered)
        self.most, self.kept = remembered, (pa.array([], type=pa.string()), np.zeros(0, dtype=self.dtype), np.zeros(1, dtype=np.int64))

    def model_ids(self, pretoken: str) -> bytes:
        """The model's ids of a pre-token; the model takes bytes as the letters of LETTERS."""
        found = self.tok.model.tokenize(pretoken.encode().decode("latin-1").translate(LETTERS))
        return array(self.code, [t.id for t in found]).tobytes()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per Python worker and file."""
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def raw(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.cache.__getitem__, self.split(text)))
        if self.wide:
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.cache.__getitem__, self.split(text[at : m.start()]))
            out.append(array(self.code, [self.added[m[0]]]).tobytes())
            at = m.end()
        return b"".join([*out, *map(self.cache.__getitem__, self.split(text[at:]))])

    def batch(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column, null as empty, as bytes of dtype."""
        self.cache.trim()  # not behind the last text, as who zips the ids with a list takes no further step
        column = pc.fill_null(column, "").cast(pa.string())
        odd = pc.match_substring_regex(column, SPACES)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(column, token))
        lists = pc.split_pattern(column.filter(pc.invert(odd)), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
        coded = lists.flatten().dictionary_encode()
        del lists
        words, codes, a, texts = coded.dictionary, coded.indices.to_numpy(), 0, iter(ends)
        ids, starts, sizes = self.parts(words)
        for i, apart in enumerate(odd.to_pylist()):
            if apart:
                yield self.raw(column[i].as_py())
                continue
            b = next(texts)
            rest = codes[a + 1 : b]
            yield self.raw(words[codes[a]].as_py()) + joined(ids, starts[rest], sizes[rest]).tobytes()
            a = b

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words with a space before each: all ids, and where those of each word begin
        and how many they are."""
        n, last = len(words), pc.utf8_slice_codeunits(words, -1)
        core = pc.utf8_slice_codeunits(words, 0, -1)
        whole = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        ended = pc.and_(pc.is_in(last, pa.array([".", ","])), pc.utf8_is_alpha(core)).to_numpy(zero_copy_only=False)
        found, owners, split = [], [], self.split
        for i in np.flatnonzero(~(whole | ended)).tolist():
            some = split(" " + words[i].as_py())
            found += some
            owners += [i] * len(some)
        a, b = np.flatnonzero(whole), np.flatnonzero(ended)
        letters = pc.binary_join_element_wise("", pa.concat_arrays([words.filter(pa.array(whole)), core.filter(pa.array(ended))]), " ")
        pretokens = pa.concat_arrays([letters, last.filter(pa.array(ended)), pa.array(found, type=pa.string())]).dictionary_encode()
        order = np.argsort(np.concatenate([a, b, b, np.array(owners, dtype=np.int64)]), kind="stable")
        many = whole + 2 * ended + np.bincount(owners, minlength=n) if owners else whole + 2 * ended
        at = pretokens.indices.to_numpy()[order]
        ids, bounds = self.known(pretokens.dictionary)
        sizes = np.diff(bounds)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(many)])]
        return joined(ids, bounds[at], sizes), ends[:-1], np.diff(ends)

    def known(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens, one after another, and their bounds. What is new is encoded and
        kept for later batches, as flat arrays; beyond a fixed number all but those of this batch go."""
        words, ids, bounds = self.kept
        places = pc.index_in(pretokens, value_set=words)
        new = places.is_null().to_numpy(zero_copy_only=False)
        more = pretokens.filter(places.is_null())
        flat, counts = self.encoded(more)
        ids, bounds = np.concatenate([ids, flat]), np.concatenate([bounds, bounds[-1] + np.cumsum(counts, dtype=np.int64)])
        at = np.where(new, len(words) + np.cumsum(new) - 1, pc.fill_null(places, 0).to_numpy(zero_copy_only=False))
        sizes = np.diff(bounds)[at]
        mine = joined(ids, bounds[at], sizes), np.concatenate([[0], np.cumsum(sizes)])
        self.kept = (pa.concat_arrays([words, more]), ids, bounds) if len(bounds) <= self.most else (pretokens, *mine)
        return mine

    def encoded(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of pre-tokens, one after another, and how many each has."""
        ends = np.cumsum(pc.binary_length(pretokens).to_numpy(zero_copy_only=False)).tolist()
        letters = "".join(pretokens.to_pylist()).encode().decode("latin-1").translate(LETTERS)
        tokenize, ids, counts, a = self.tok.model.tokenize, array(self.code), [], 0
        for b in ends:
            found = tokenize(letters[a:b])
            counts.append(len(found))
            ids.extend([t.id for t in found])
            a = b
        return np.frombuffer(ids, dtype=self.dtype), np.array(counts, dtype=np.int64)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence may end behind it: final punctuation or a line break."""
        ends = np.zeros(self.size, dtype=bool)
        rule = re.compile(r"^\s*[.!?。！？…]+[\"')\]»”]*\s*$|\n")
        for i in range(self.size):
            ends[i] = bool(rule.search(self.tok.decode([i], skip_special_tokens=False)))
        return ends
