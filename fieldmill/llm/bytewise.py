"""Words and checksums of whole text columns, byte by byte in numpy, without an object per word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in stretches of about so many bytes.
STRETCH = 2 << 20
#: Words up to so many bytes are summed column by column, longer ones each by itself.
SHORT = 64


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_T = _table()


def _advanced(c: np.ndarray) -> np.ndarray:
    """What a zero byte makes of a checksum, apart from what the checksum of the bytes behind gives."""
    return _T[c & 0xFF] ^ (c >> np.uint32(8))


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables by byte of a checksum: for 0 to 63 bytes behind, and for 64, 128, 256 and so on."""
    units = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near, c = [], units
    for _ in range(64):
        near.append(c)
        c = _advanced(c)
    far = [c]
    for _ in range(40):
        far.append(_apply(far[-1], far[-1]))
    return np.array(near), np.array(far)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> np.uint32(8)) & 0xFF] ^ table[2][(c >> np.uint32(16)) & 0xFF] ^ table[3][c >> np.uint32(24)]


_NEAR, _FAR = _shifts()


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums moved on by n bytes: crc32(a + b) is shifted(crc32(a), len(b)) ^ crc32(b)."""
    k = n & 63
    c = _NEAR[k, 0, c & 0xFF] ^ _NEAR[k, 1, (c >> np.uint32(8)) & 0xFF] ^ _NEAR[k, 2, (c >> np.uint32(16)) & 0xFF] ^ _NEAR[k, 3, c >> np.uint32(24)]
    rest = n >> 6
    bit = 0
    while (some := np.flatnonzero(rest >> bit)).size:
        some = some[(rest[some] >> bit) & 1 == 1]
        c[some] = _apply(_FAR[bit], c[some])
        bit += 1
    return c


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and where each text begins and ends."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def stretches(column: pa.Array, table: np.ndarray, joint: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a text column: bytes, starts and lengths in them, and the number of each word's text.

    table maps bytes to what is compared, 0 for those outside words; a byte behind joint belongs to
    the word too. Texts come in stretches that end between words, in order.
    """
    data, ends = flat(column)
    a = 0
    while a < len(data):
        b = min(a + STRETCH, len(data))
        while b < len(data):  # on to the first byte outside words, or to the end of a text
            ahead = table[data[b : b + STRETCH]] == 0
            if joint is not None:
                ahead &= data[b - 1 : b - 1 + len(ahead)] != joint
            outside = b + int(np.argmax(ahead)) if ahead.any() else len(data)
            end = int(ends[np.searchsorted(ends, b)])
            if min(outside, end) < b + len(ahead):
                b = min(outside, end)
                break
            b += len(ahead)
        part = data[a:b]
        mapped = table[part]
        inside = mapped != 0
        if joint is not None:
            tail = np.flatnonzero(part[:-1] == joint) + 1
            mapped[tail], inside[tail] = part[tail], True
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = ends[(ends > a) & (ends < b)] - a
        first[own] = inside[own]
        starts = np.flatnonzero(first)
        upto = np.concatenate([[0], np.cumsum(inside)])
        lengths = np.diff(np.append(upto[starts], upto[-1]))
        yield mapped, starts, lengths, np.searchsorted(ends, starts + a, side="right") - 1
        a = b


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each word."""
    order = np.argsort(-np.minimum(lengths, SHORT), kind="stable")
    at, size = starts[order], lengths[order]
    most = int(min(size.max(initial=0), SHORT))
    falling = -np.minimum(size, SHORT)
    c = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    for p in range(most):
        k = int(np.searchsorted(falling, -p, side="left"))  # words longer than p
        now = c[:k]
        c[:k] = _T[(now ^ data[at[:k] + p]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out
