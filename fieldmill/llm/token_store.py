"""Token-id shards with a minimal perfect hash index.

A store is a folder of shards in ascending key order. A shard is two files:

``shard-NNNNN.bin``  the ids of its documents one after another, little-endian, two bytes an id
                     for vocabularies up to 65,536 ids and four otherwise;
``shard-NNNNN.idx``  ``FMIX`` header, bucket displacements, then for every slot of a minimal
                     perfect hash over the shard's distinct keys a 64-bit fingerprint of the key,
                     the first document with it and their number, then document offsets and keys.

A key's bucket gives a displacement (or, for buckets of one key, the slot itself), which gives the
slot; the stored fingerprint tells absent keys. Keyed access touches a fixed number of entries.
The shard of a key follows from the key ranges in the manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mixed, pieces, scratch
from .tokens import Encoder, default_path

MAGIC = b"FMIX0001"
NULL_KEY = 0x5BD1E995  # stands in for a null key in hashes
TRIED = 64
FRONT = 32  # characters of a text that order rows of one key into shards
READ = 500  # documents that a scan reads at once
#: A writer takes so much at once, as what it looks up anew in each batch takes time.
TAKEN, PART = "16m", 16 << 20
_MANIFEST = "shard long, low long, high long, nulls long, n_docs long, n_tokens long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark takes it to be in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[len("file:") :] if full.startswith("file:/") and not full.startswith("file://") else full


def key_hashes(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    h = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.where(nulls, mixed(np.full(1, NULL_KEY, dtype=np.uint64)), h)


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) % np.uint64(max(n, 1))).astype(np.int64)


def perfect_hash(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct hashes: hash, displace, and place
    buckets of one key straight into the slots that are left (stored as minus slot minus one)."""
    n = len(h)
    buckets = max(1, -(-n // 4))
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    starts = np.searchsorted(b[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    out, taken = np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=bool)
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] < 2:
            break
        mine, d = h[order[starts[k] : starts[k + 1]]], 1
        while True:  # many displacements at a time
            tried = _slot(mine[None, :], np.arange(d, d + TRIED)[:, None], n)
            apart = (np.diff(np.sort(tried, axis=1), axis=1) > 0).all(axis=1)
            fit = np.flatnonzero(apart & ~taken[tried].any(axis=1))
            if len(fit):
                s, d = tried[fit[0]], d + int(fit[0])
                break
            d += TRIED
        taken[s] = True
        out[k] = d
    single = np.flatnonzero(sizes == 1)
    out[single] = -np.flatnonzero(~taken)[: len(single)] - 1
    return out


def slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(h % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -d - 1, _slot(h, np.maximum(d, 0), n))


def index_bytes(keys: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """The index of a shard whose keys ascend, nulls first; equal keys stand together."""
    n = len(keys)
    change = np.ones(n, dtype=bool)
    change[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    h = key_hashes(keys[first], nulls[first])
    d = perfect_hash(h)
    at = slots(h, d, len(h))
    finger, where, many = (np.zeros(len(h), dtype=t) for t in ("<u8", "<u4", "<u4"))
    finger[at], where[at], many[at] = mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, count
    head = MAGIC + struct.pack("<4Q", width, n, len(h), len(d))
    return head + b"".join(x.tobytes() for x in (d.astype("<i8"), finger, where, many, offsets.astype("<u8"), keys.astype("<i8"), nulls.astype("u1")))


class Shard:
    """An opened shard: get(key) by a fixed number of small reads, and the whole index for scans."""

    def __init__(self, folder: str, number: int):
        fs, root = filesystem(folder)
        self.path = f"{root}/shard-{number:05d}"
        self.idx, self.bin = fs.open_input_file(f"{self.path}.idx"), fs.open_input_file(f"{self.path}.bin")
        head = self.idx.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{self.path}.idx is no index of this format")
        width, self.n, k, b = struct.unpack_from("<4Q", head, 8)
        self.n_keys, self.dtype = k, np.dtype("<u2" if width == 2 else "<u4")
        self.parts, at = {}, 40  # name: type, place, entries
        for name, kind, size in (("d", "<i8", b), ("finger", "<u8", k), ("where", "<u4", k), ("many", "<u4", k), ("offsets", "<u8", self.n + 1), ("keys", "<i8", self.n), ("nulls", "u1", self.n)):
            kind = np.dtype(kind)
            self.parts[name] = (kind, at, size)
            at += kind.itemsize * size

    def entries(self, name: str, first: int = 0, many: int | None = None) -> np.ndarray:
        """Entries of a part of the index: many from first on, or all."""
        kind, at, size = self.parts[name]
        many = size - first if many is None else many
        return np.frombuffer(self.idx.read_at(kind.itemsize * many, at + kind.itemsize * first), dtype=kind)

    def find(self, keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key and how many have it (0 for absent keys), with the index read whole."""
        if not self.n_keys:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        h = key_hashes(keys, nulls)
        at = slots(h, self.entries("d"), self.n_keys)
        known = self.entries("finger")[at] == mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return self.entries("where")[at].astype(np.int64), np.where(known, self.entries("many")[at], 0).astype(np.int64)

    def find_one(self, key: int | None) -> tuple[int, int]:
        """As find, for one key, by reading one entry of each part that it needs."""
        if not self.n_keys:
            return 0, 0
        h = key_hashes(np.array([key or 0], dtype=np.int64), np.array([key is None]))
        buckets = self.parts["d"][2]
        d = self.entries("d", int(h[0] % np.uint64(buckets)), 1)
        at = int(-d[0] - 1) if d[0] < 0 else int(_slot(h, d, self.n_keys)[0])
        if self.entries("finger", at, 1)[0] != mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0]:
            return 0, 0
        return int(self.entries("where", at, 1)[0]), int(self.entries("many", at, 1)[0])

    def payload(self, first: int, end: int) -> np.ndarray:
        """The ids from place first to end."""
        size = self.dtype.itemsize
        return np.frombuffer(self.bin.read_at((end - first) * size, first * size), dtype=self.dtype)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        first, many = self.find_one(key)
        if not many:
            return []
        ends = self.entries("offsets", first, many + 1).astype(np.int64).tolist()
        return [self.payload(a, b) for a, b in zip(ends[:-1], ends[1:])]


class TokenStore:
    """A written store, opened from its folder and manifest rows."""

    def __init__(self, folder: str, manifest: list[dict]):
        self.folder, self.manifest = folder, sorted(manifest, key=lambda r: r["shard"])
        self.highs = [(r["high"] is not None, r["high"] or 0) for r in self.manifest]
        self.opened: dict[int, Shard] = {}

    def shard(self, i: int) -> Shard:
        number = self.manifest[i]["shard"]
        if number not in self.opened:
            self.opened[number] = Shard(self.folder, number)
        return self.opened[number]

    def get(self, key: int | None) -> list[np.ndarray]:
        out, i = [], bisect_left(self.highs, (key is not None, key or 0))
        while i < len(self.manifest):
            found = self.shard(i).get(key)
            if not found and (out or i >= len(self.highs) or self.highs[i] > (key is not None, key or 0)):
                break
            out += found
            i += 1
        return out


def write_store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encode every whole text, append end_id and write the shards of a store; return its manifest.

    Null texts count as empty, null keys come first, rows with equal keys are ordered by text, and
    an empty table gives no shard. Rows of one key, or without one, fall to several shards where they
    are many. Other columns are ignored, whatever their names. One row per shard comes back to the driver. A task writes under a name of its own and then renames, so a
    repeated task replaces the same file by the same bytes.
    """
    tokenizer, folder = tokenizer or default_path(), qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
    ranges = [F.col("_k"), F.left("_t", F.lit(FRONT))]  # a key on many rows is split by how their texts begin
    rows = (rows.repartitionByRange(shards, *ranges) if shards else rows.repartitionByRange(*ranges)).sortWithinPartitions("_k", "_t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, enc = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        tail, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/shard-{number:05d}", uuid.uuid4().hex
        keys, sizes, out = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{name}.bin.{own}")
            keys.append(batch.column(0))
            for part in pieces(batch, 1, PART):
                for raw in enc.batch(part.column(1)):
                    sizes.append(len(raw) // width + 1)
                    out.write(raw + tail)
        if out is None:
            return
        out.close()
        column = pa.chunked_array(keys)
        nulls = column.is_null().to_numpy()
        values = column.fill_null(0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        with fs.open_output_stream(f"{name}.idx.{own}") as idx:
            idx.write(index_bytes(values, nulls, offsets, width))
        for kind in ("bin", "idx"):
            fs.move(f"{name}.{kind}.{own}", f"{name}.{kind}")
        have = values[~nulls]
        made = [number, int(have[0]) if len(have) else None, int(have[-1]) if len(have) else None, int(nulls.sum()), len(sizes), int(offsets[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.int64()) for x in made], names=["shard", "low", "high", "nulls", "n_docs", "n_tokens"])

    return sorted((r.asDict() for r in rows.transform(mapped, write, _MANIFEST, TAKEN).collect()), key=lambda r: r["shard"])


def read_store(spark: SparkSession, folder: str, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """One row per document of a store, read back from its files: the key, start (ids of all
    documents before it), n_tokens and ids_crc32 (of the ids as four-byte integers).

    Each distinct key of a shard is looked up by the perfect hash, and what its slot names is read;
    a slot with another fingerprint, or slots that together don't name every document once, are an error.
    """
    folder = qualified(spark, folder)
    bases, total = [], 0
    for r in manifest:
        bases.append(total)
        total += r["n_tokens"]
    numbers = [r["shard"] for r in manifest]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shard = Shard(folder, numbers[i])
                keys, nulls, offsets = shard.entries("keys"), shard.entries("nulls").astype(bool), shard.entries("offsets").astype(np.int64)
                new = np.ones(shard.n, dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
                distinct = np.flatnonzero(new)
                first, many = shard.find(keys[distinct], nulls[distinct])
                ends = np.cumsum(many)
                places = np.repeat(first - (ends - many), many) + np.arange(int(many.sum()))
                if (many == 0).any() or not np.array_equal(np.sort(places), np.arange(shard.n)):
                    raise ValueError(f"{shard.path}.idx does not lead to all its keys")
                owner = np.repeat(distinct, many)
                for a in range(0, shard.n, READ):
                    at, own = places[a : a + READ], owner[a : a + READ]
                    lo, hi = int(offsets[at].min()), int(offsets[at + 1].max())
                    ids = shard.payload(lo, hi)  # one read for neighbours: slots of ascending keys name ascending places
                    sums = [zlib.crc32(ids[x - lo : y - lo].astype("<u4")) for x, y in zip(offsets[at].tolist(), offsets[at + 1].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[own], mask=nulls[own]), pa.array(offsets[at] + bases[i]), pa.array(offsets[at + 1] - offsets[at]), pa.array(sums, type=pa.int64())],
                        names=[key, "start", "n_tokens", "ids_crc32"],
                    )

    n = len(manifest)
    return spark.range(0, n, 1, max(1, n)).transform(mapped, read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as a store in the shared folder and read it back."""
    folder = scratch(spark, "token-store")
    manifest = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_store(spark, folder, manifest)
