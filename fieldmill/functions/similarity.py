"""Arrow UDFs for what has no built-in: compatibility decomposition, and the gestalt similarity of
the standard library, which is asymmetric and so can't be replaced by an edit distance."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(text: str) -> str:
    """Decomposed by compatibility, with only ASCII kept."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def plain_string(text) -> str:
    """The normal form in which strings are compared."""
    text = "" if text is None else str(text)
    return re.sub(r"\s+", " ", folded(unicodedata.normalize("NFKC", text).strip().lower()))


@lru_cache(maxsize=1 << 16)
def plain_key(key) -> str:
    return re.sub(r"[^a-z0-9]", "", folded(str(key).lower()))


def likeness(left, right) -> float:
    return difflib.SequenceMatcher(a=plain_string(left), b=plain_string(right)).ratio()


def likeness_from(a: str, b: str, least: float) -> float | None:
    """The ratio of two plain strings if it reaches least; cheap upper bounds come first."""
    m = difflib.SequenceMatcher(a=a, b=b)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return None
    ratio = m.ratio()
    return ratio if ratio >= least else None


def choose_key(target: str, candidates: list[str], cutoff: float = 0.8) -> str | None:
    """The first candidate with the same plain key, else the first of the one most like it (ties by
    the greater plain key) if it reaches the cutoff."""
    return _chosen(target, tuple(candidates), cutoff)


@lru_cache(maxsize=1 << 16)
def _chosen(target: str, candidates: tuple[str, ...], cutoff: float) -> str | None:
    """Records of one kind have the same keys, so a worker remembers what it has chosen among them."""
    want, plain = plain_key(target), [plain_key(c) for c in candidates]
    if want not in plain:
        near = difflib.get_close_matches(want, plain, 1, cutoff)
        if not near:
            return None
        want = near[0]
    return candidates[plain.index(want)]


@F.arrow_udf(T.StringType())
def plain_strings(c: pa.Array) -> pa.Array:
    """The normal form of strings, null for null."""
    return pa.array([None if t is None else plain_string(t) for t in c.to_pylist()], type=pa.string())


@F.arrow_udf(T.StringType())
def plain_keys(c: pa.Array) -> pa.Array:
    """The plain form of keys, null for null."""
    return pa.array([None if t is None else plain_key(t) for t in c.to_pylist()], type=pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def plain_key_lists(c: pa.Array) -> pa.Array:
    return pa.array([None if t is None else [plain_key(k) for k in t] for t in c.to_pylist()], type=pa.list_(pa.string()))


@F.arrow_udf(T.DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Gestalt ratio of the normal forms; left and right don't commute."""
    return pa.array([likeness(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], type=pa.float64())


@F.arrow_udf(T.StringType())
def closest_key(target: pa.Array, candidates: pa.Array) -> pa.Array:
    return pa.array([choose_key(t, c) if t is not None and c is not None else None for t, c in zip(target.to_pylist(), candidates.to_pylist())], type=pa.string())
