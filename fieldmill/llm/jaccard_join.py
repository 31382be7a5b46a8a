"""Exact Jaccard join of documents' word shingles as a metric-space join.

The Jaccard distance d is a metric, so the distances of two documents to a pivot differ by at most
their own distance. Texts that share little are all at a distance near 1 from any pivot, and such
a pivot tells nothing about them; so pivots are chosen where they can tell something:

1. Documents with equal sets become one. A set's rarest shingles (its prefix) must meet the prefix
   of every set it links to. Documents that share a prefix shingle, cut into bands of set size
   with a window of one band above, form a region, and its smallest document is the pivot: so a
   document lies in the region of every pivot that any of its links could share with it.
   Rarity comes from word counts over all documents, in a table of fixed size.
   Prefixes bound the similarity of two sets from above. Before any set is loaded, these bounds part
   regions whose prefixes fit in a task's hands (FITTING documents) and leave out documents that
   can't link in them; each part is a region with its smallest document as the pivot, and equal
   parts are one. This only saves loading: bounds decide no link.
2. The distance of every member to its pivot is computed. Members within the threshold link to
   the pivot, hence with each other. The rest of a region is cut into shells by the distance to
   the pivot, as wide as the threshold; a document links inside its shell or to the next one, so
   each shell takes the next shell's documents as its boundary.
3. A shell joins by itself. Where it is too heavy for a task, some of its documents, chosen by hash,
   become pivots of Voronoi regions: a document goes to every region whose pivot is at most twice
   the threshold farther than its own, and regions join recursively, each level a distributed step,
   until they fit in a task. There the same goes on in memory, down to leaves of a few documents,
   where whole sets are compared. A region that its pivots can't part (all are about as far from
   each) is dealt into blocks, and every pair of blocks with a document that no pivot took joins.

Every pair within the threshold thus meets in a region, and every link is decided on whole sets.
A region of any size goes this way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept, mapped, pieces, runs_hashed, scope, word_hashes
from .components import components

CELLS, CHUNK = 1 << 20, 1 << 14
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000
PIVOTS, SHRUNK = 16, 0.7  # a level's pivots of a region, and the share of its pairs that its parts may have together
FILTER_BITS, SHARED_BITS = 1 << 24, 1 << 26
FITTING = 256


def survey(texts: DataFrame, k: int) -> tuple[DataFrame, str, np.ndarray]:
    """One pass over texts (id, text): a table of id, n (set size) and fp (the set's fingerprint), its
    path, and for each of CELLS hash cells eight times the binary logarithm of its words' count in all texts.
    Tasks add up their own counts first; that table has the same size for any input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for part in (part for batch in batches for part in pieces(batch, 1)):
            words, ends = word_hashes(part.column(1))
            total += np.bincount((words % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            sets = [shingle_set(words[a:b], k) for a, b in zip(ends[:-1], ends[1:])]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            none = pa.nulls(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], type=pa.int32()), pa.array(prints, type=pa.binary()), none.cast(pa.int64()), none.cast(pa.binary())], names=["id", "n", "fp", "c", "v"])
        parts = [(c, total[c * CHUNK : (c + 1) * CHUNK]) for c in range(CELLS // CHUNK)]
        parts = [(c, p.astype(np.int64).tobytes()) for c, p in parts if p.any()]
        if parts:
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array([c for c, _ in parts]), pa.array([v for _, v in parts], type=pa.binary())], names=["id", "n", "fp", "c", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(v, dtype=np.int64)
                sums[c] = sums[c] + part if c in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], type=pa.binary())], names=["c", "v"])

    made, path = kept(texts.transform(mapped, run, "id long, n int, fp binary, c long, v binary"), "jaccard-survey")
    out = np.zeros(CELLS)
    for r in made.filter("c is not null").select("c", "v").repartition(CELLS // CHUNK, "c").transform(mapped, add, "c long, v binary").collect():
        out[r.c * CHUNK : (r.c + 1) * CHUNK] = np.frombuffer(r.v, dtype=np.int64)
    return made.filter("c is null").select("id", "n", "fp"), path, np.round(8 * np.log2(1 + out)).astype(np.uint16)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles of word hashes, ascending."""
    return np.unique(runs_hashed(w, k))


def prefix_of(w: np.ndarray, k: int, percent: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingle set, and the keys of its rarest shingles in the order of all shingles: by
    word counts, then by hash. The first prefix_length of them must meet the same part of any set
    with at least percent / 100 of similarity."""
    h = runs_hashed(w, k)
    s, first = np.unique(h, return_index=True)
    take = prefix_length(len(s), percent)
    cell = weights[w % np.uint64(CELLS)].astype(np.uint64)
    rank = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(k, len(w))):
        rank += cell[i : i + len(h)]
    keys = (rank[first] << np.uint64(50)) | (s >> np.uint64(14))
    return s, np.sort(np.partition(keys, take - 1)[:take] if 0 < take < len(keys) else keys)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def may_link(prefixes: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """A matrix that is False only for pairs of sets that can't be similar enough, judged by their
    first keys: up to the end of the shorter-reaching prefix all shared shingles are known, beyond
    it all may be shared."""
    m = len(prefixes)
    ends = np.array([p[-1] if len(p) < n else np.iinfo(np.uint64).max for p, n in zip(prefixes, sizes)], dtype=np.uint64)
    reach = np.stack([np.searchsorted(p, ends, side="right") for p in prefixes])  # keys of i up to j's end
    rest = sizes[:, None] - reach
    most = _matrix(prefixes, list(range(m)), list(range(m))) + np.minimum(rest, rest.T)
    yes = similar(most, sizes[:, None], sizes[None, :], percent)
    np.fill_diagonal(yes, False)
    return yes


def similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


# --- links inside one shell, in memory ---------------------------------------------------------


def _matrix(sets: list[np.ndarray], rows: list[int], cols: list[int]) -> np.ndarray:
    """Sizes of the intersections of rows' and cols' sets."""
    every = sorted({*rows, *cols})
    values, codes = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True)
    owner = np.repeat(np.arange(len(every)), [len(sets[i]) for i in every])
    common = np.bincount(codes, minlength=len(values)) > 1
    code = (np.cumsum(common) - 1)[codes]
    keep = common[codes]
    code, owner = code[keep], owner[keep]
    place = {x: i for i, x in enumerate(every)}
    r, c = np.array([place[i] for i in rows]), np.array([place[i] for i in cols])
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    shared = int(common.sum())
    width = max(1, min(shared, 4_000_000 // len(every)))
    for a in range(0, shared, width):
        lo, hi = np.searchsorted(code, [a, a + width])
        m = np.zeros((len(every), width), dtype=np.float32)
        m[owner[lo:hi], code[lo:hi] - a] = 1
        out += m[r] @ m[c].T
    return out.astype(np.int64)


class Forest:
    """Union-find; pairs holds a link for every union that joined two trees."""

    def __init__(self, n: int):
        self.up, self.pairs = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.pairs.append((i, j))


def join_region(sets: list[np.ndarray], percent: int, leaf: int = 48, pivots: int = 8) -> list[tuple[int, int]]:
    """Links that connect all documents of a region that links connect: a spanning forest."""
    size = np.array([len(s) for s in sets])
    forest, eps = Forest(len(sets)), (100 - percent) / 100

    def whole(ids: list[int]) -> None:
        for a in range(0, len(ids), 512):
            part = ids[a : a + 512]
            inter = _matrix(sets, part, ids)
            yes = similar(inter, size[part][:, None], size[ids][None, :], percent)
            for i, j in zip(*np.nonzero(yes)):
                if ids[j] != part[i]:
                    forest.link(part[i], ids[j])

    def join(ids: list[int]) -> None:
        if len(ids) <= leaf:
            return whole(ids)
        chosen = [ids[i * len(ids) // pivots] for i in range(pivots)]
        inter = _matrix(sets, ids, chosen)
        union = size[ids][:, None] + size[chosen][None, :] - inter
        for i, j in zip(*np.nonzero(100 * inter >= percent * union)):
            if ids[i] != chosen[j]:
                forest.link(ids[i], chosen[j])
        d = 1 - inter / union
        near = d <= d.min(axis=1, keepdims=True) + 2 * eps + 1e-9
        home = d.argmin(axis=1)
        regions = []
        for j in range(pivots):
            if (home == j).any():
                regions.append([ids[i] for i in np.flatnonzero(near[:, j])])
        if sum(len(r) ** 2 for r in regions) > 0.7 * len(ids) ** 2:
            return whole(ids)
        for r in regions:
            if len(r) > 1:
                join(r)

    if len(sets) > 1:
        join(list(range(len(sets))))
    return forest.pairs


# --- the distributed join ----------------------------------------------------------------------


def _bits(cells: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """size bits, those of cells (one long column, any number modulo size) set: a filter of fixed
    size that lets everything in cells pass, and little else while cells are few."""
    cell = F.pmod(F.col(cells.columns[0]), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))
    rows = cells.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out


def _set_in(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    at = cells & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def measured(members: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """g, id, j, inter, np, n: the intersection of every member's set (members: g, id) with those of
    its region's pivots (pivots: g, j, id), and the sizes.

    A region is dealt into parts of bounded weight, and its pivots, few, go to every part; a task
    holds the pivots of one part at a time and reads its members one after another.
    """
    parts = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))
    dealt = members.join(parts, "g").select("g", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.lit(-1).alias("j"), "id")
    copied = pivots.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "j", "id")
    # pivots first, in their order: a member has j -1, so the order is by whether it is one
    rows = dealt.union(copied).join(sets, "id").select("g", "part", (F.col("j") < 0).alias("member"), "j", "id", "set").repartition("g", "part").sortWithinPartitions("g", "part", "member", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for g, part, member, j, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, part) != now:
                    now, held = (g, part), []
                own = np.frombuffer(raw, dtype=np.uint64)
                if not member:
                    held.append((j, own))
                    continue
                for pivot, other in held:
                    for column, x in zip(out, (g, i, pivot, common(own, other), len(other), len(own))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in out], names=["g", "id", "j", "inter", "np", "n"])

    return rows.transform(mapped, run, "g long, id long, j long, inter long, np long, n long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def joined(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links inside each group of rows (keys, id, set)."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []

        def links() -> pa.RecordBatch:
            out = join_region(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in out], type=pa.int64()), pa.array([ids[j] for _, j in out], type=pa.int64())], names=["a", "b"])

        for batch in batches:
            for at, i, s in zip(zip(*(batch.column(c).to_pylist() for c in range(k))), batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                if at != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, held = at, [], []
                ids.append(i)
                held.append(np.frombuffer(s, dtype=np.uint64))
        if len(ids) > 1:
            yield links()

    return rows.select(*keys, "id", "set").repartition(*keys).sortWithinPartitions(*keys).transform(mapped, run, "a long, b long")


def join_shells(rows: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Links inside the groups of rows (g, id, n, taken): tables of a, b that connect what links
    connect. Of documents that are taken (linked to the pivot of the whole region) no two need a link
    among themselves. Each level parts heavy groups by pivots; see the module's text."""
    eps, found, level = (100 - percent) / 100, [], 0
    while True:
        weight = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("taken")).alias("open"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.max("stuck").alias("stuck"))
        weight = cut(weight.filter("open > 0 and c > 1"))
        light = rows.join(weight.filter("blocks = 1").select("g"), "g")
        found.append(cut(joined(light.select("g", "id").join(sets, "id"), ["g"], percent)))
        if weight.filter("blocks > 1 and stuck").limit(1).count():
            found.append(cut(_blocks(rows.join(weight.filter("blocks > 1 and stuck").select("g", "c", "blocks", "open"), "g"), sets, percent)))
        heavy = weight.filter("blocks > 1 and not stuck").select("g", "c")
        if heavy.isEmpty():
            return found
        # pivots: of each of PIVOTS classes of a group the document of the least hash
        inside = rows.join(heavy, "g")
        at = F.struct(F.xxhash64("id", F.lit(level)).alias("h"), "id")
        pivots = cut(inside.groupBy("g", F.pmod(F.xxhash64("id", F.lit(level + 1000)), F.lit(PIVOTS)).cast("int").alias("j")).agg(F.min(at).alias("p")).select("g", "j", F.col("p.id").alias("id")))
        union = F.col("np") + F.col("n") - F.col("inter")
        away = measured(inside.select("g", "id"), pivots, sets).select("g", "id", F.col("j").cast("int").alias("j"), (100 * F.col("inter") >= percent * union).alias("link"), (1 - F.col("inter") / union).alias("d"))
        told = cut(away.groupBy("g", "id").agg(F.collect_list(F.struct("d", "j", "link")).alias("to")))
        found.append(cut(told.select("g", "id", F.explode(F.filter("to", lambda t: t["link"])).alias("t")).select("g", "id", "t.j").join(pivots.withColumnRenamed("id", "b"), ["g", "j"]).filter("id <> b").select(F.col("id").alias("a"), "b")))
        least = F.array_min("to")
        near = told.withColumn("least", least).select("g", "id", F.explode(F.filter("to", lambda t: t["d"] <= least["d"] + 2 * eps + 1e-9)).alias("t"), F.col("least.j").alias("home"))
        homes = near.select("g", F.col("home").alias("j")).distinct()
        parts = near.select("g", "id", F.col("t.j").alias("j")).join(homes, ["g", "j"]).join(inside.select("g", "id", "n", "taken", "c"), ["g", "id"])
        grown = parts.groupBy("g", "j").agg(F.count(F.lit(1)).cast("double").alias("m"), F.max("c").alias("c")).groupBy("g").agg(F.sum(F.col("m") * F.col("m")).alias("work"), F.max("c").alias("c"))
        # a group whose parts are together nearly as much work as itself is not worth parting: it stays whole, for blocks
        stuck = grown.filter(F.col("work") > SHRUNK * F.col("c") * F.col("c")).select("g")
        parted = parts.join(stuck, "g", "left_anti").select(F.xxhash64("g", "j", F.lit(level)).alias("g"), "id", "n", "taken", F.lit(False).alias("stuck"))
        whole = inside.join(stuck, "g").select("g", "id", "n", "taken", F.lit(True).alias("stuck"))
        rows, level = cut(parted.union(whole)), level + 1


def _blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups of rows (g, id, taken, c, blocks) that can't be parted: dealt into blocks,
    every pair of blocks joins, but for two of taken documents."""
    kind = F.when(F.col("taken"), F.col("blocks")).otherwise(0)  # blocks of open documents come first
    mine = kind + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), 2 * F.col("blocks") - 1)
    with_ = F.when(F.col("taken"), F.filter(every, lambda o: o < F.col("blocks"))).otherwise(every)
    dealt = rows.withColumn("k", mine).withColumn("o", F.explode(with_)).select("g", F.least("k", "o").alias("gi"), F.greatest("k", "o").alias("gj"), "id")
    return joined(dealt.join(sets, "id"), ["g", "gi", "gj"], percent)


def _named(docs: DataFrame, k: int, percent: int, key: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """id, n and fp of every row, the path of that table, and the component of every fp."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made, made_path, weights = survey(rows, k)
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.000001)).cast("int")
    full = made.filter("n > 0 and id is not null")

    # copies: rows whose set a smaller key has, told by key and set, as a key may stand on other sets
    # too; only what a filter can't tell from them is joined
    # tables of their own, so that adaptive execution can split a large group of copies in the joins
    firsts = cut(full.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("top")))
    copies = cut(full.select("id", "fp").join(firsts.filter("rep < top"), "fp").filter("id > rep").select("id", "fp", "rep").distinct())
    copied, counts = sc.broadcast(_bits(copies.select(F.xxhash64("id")))), sc.broadcast(weights)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in pieces(batch, 1)):
            sizes, prefixes, prints = [], [], []
            words, ends = word_hashes(batch.column(1))
            maybe = _set_in(copied.value, batch.column(2).to_numpy())
            for a, b, m in zip(ends[:-1], ends[1:], maybe.tolist()):
                s, p = prefix_of(words[a:b], k, percent, counts.value)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if m and len(s) else None)
                prefixes.append(p.view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int32()), lists, pa.array(prints, type=pa.binary())], names=["id", "n", "prefix", "fp"])

    celled = rows.filter("id is not null").select("id", "text", F.xxhash64("id").alias("cell"))
    sets_by_row, _ = kept(celled.transform(mapped, base, "id long, n int, prefix array<long>, fp binary").filter("n > 0"), "jaccard-base")
    reps = sets_by_row.filter("fp is null").drop("fp").union(sets_by_row.filter("fp is not null").join(copies, ["id", "fp"], "left_anti").drop("fp"))

    # 1. regions of documents that share a prefix shingle, by bands of size
    shared = reps.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("s")
    shared, _ = kept(shared, "jaccard-shared")
    repeated = sc.broadcast(_bits(shared, SHARED_BITS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            value, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = np.flatnonzero(_set_in(repeated.value, value))
            row = np.repeat(np.arange(batch.num_rows), sizes)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(value[keep]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["s", "id", "n"])

    rows_of = reps.select("id", "n", "prefix").transform(mapped, spread, "s long, id long, n int").join(shared, "s")
    member, _ = kept(rows_of.select("s", "id", F.explode(F.array(band, band - 1)).alias("band"), band.alias("own")), "jaccard-member")
    lead = member.groupBy("s", "band").agg(F.min(F.when(F.col("own") == F.col("band"), F.col("id"))).alias("p"), F.count(F.lit(1)).alias("c")).filter("p is not null and c > 1")
    inside = cut(member.join(lead.select("s", "band", "p"), ["s", "band"]).select("p", "id").distinct())
    sizes = inside.groupBy("p").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")

    # what bounds can part is parted, and what they leave alone is left out
    fitting = inside.join(sizes.filter(f"c <= {FITTING}").select("p"), "p")
    known = sc.broadcast(_bits(fitting.select(F.xxhash64("id"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_set_in(known.value, batch.column(3).to_numpy()))).select(["id", "n", "prefix"])

    picked = reps.select("id", "n", "prefix", F.xxhash64("id").alias("cell")).transform(mapped, pick, "id long, n int, prefix array<long>")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def parted() -> pa.RecordBatch:
            ids = np.array([x[0] for x in held])
            forest = Forest(len(held))
            for i, j in zip(*np.nonzero(np.triu(may_link([x[2] for x in held], np.array([x[1] for x in held]), percent)))):
                forest.link(int(i), int(j))
            root = np.array([forest.root(i) for i in range(len(held))])
            groups = [np.sort(ids[root == r]) for r in np.flatnonzero(np.bincount(root) > 1)]
            names = [np.full(len(g), xxhash.xxh64_intdigest(g.tobytes()), dtype=np.uint64).view(np.int64) for g in groups]
            none = np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (names, [np.full(len(g), g[0]) for g in groups], groups)], names=["g", "p", "id"])

        for batch in batches:
            at, ids, ns, prefixes = (batch.column(i) for i in range(4))
            for p, i, n, x in zip(at.to_pylist(), ids.to_pylist(), ns.to_pylist(), prefixes):
                if p != now:
                    if len(held) > 1:
                        yield parted()
                    now, held = p, []
                held.append((i, n, x.values.to_numpy().view(np.uint64)))
        if len(held) > 1:
            yield parted()

    few = fitting.join(picked, "id").select("p", "id", "n", "prefix").repartition("p").sortWithinPartitions("p")
    many = inside.join(sizes.filter(f"c > {FITTING}").select("p"), "p").select(F.xxhash64("p", F.lit("region")).alias("g"), "p", "id")
    regions = cut(few.transform(mapped, part, "g long, p long, id long").distinct().union(many))
    pairs, leads = regions.filter("id <> p"), regions.select("g", "p").distinct()

    # the sets of the documents in regions
    loaded = sc.broadcast(_bits(regions.select(F.xxhash64("id")).union(regions.select(F.xxhash64("p")))))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(_set_in(loaded.value, batch.column(2).to_numpy()))
            for part in pieces(batch.take(pa.array(hit)), 1) if len(hit) else ():
                words, ends = word_hashes(part.column(1))
                sets = [shingle_set(words[a:b], k) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["id", "set"])

    sets, _ = kept(celled.transform(mapped, sets_of, "id long, set binary").filter("length(set) > 0"), "jaccard-sets")

    # 2. distances to the pivots
    union = F.col("np") + F.col("n") - F.col("inter")
    shell = F.floor((1 - F.col("inter") / union) / ((100 - percent) / 100 * 1.000001)).cast("int")
    away = measured(pairs.select("g", "id"), leads.select("g", F.lit(0).alias("j"), F.col("p").alias("id")), sets)
    to_pivot = cut(away.select("g", "id", "n", (100 * F.col("inter") >= percent * union).alias("taken"), shell.alias("shell")).join(leads, "g"))

    # 3. shells with the next shell's documents
    wide = to_pivot.select("g", "id", "n", "taken", F.explode(F.array("shell", F.col("shell") - 1)).alias("shell")).filter("shell >= 0")
    homes = to_pivot.select("g", "shell").distinct()
    one = wide.join(homes, ["g", "shell"]).groupBy(F.xxhash64("g", "shell").alias("g"), "id").agg(F.max("n").alias("n"), F.max("taken").alias("taken"))
    shells = cut(one.withColumn("stuck", F.lit(False)))
    within = join_shells(shells, sets, percent)
    # a key that stands on rows with different sets joins these
    sets_of_key = copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    twice = full.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x < y").select("id").join(copies.select("id", "rep"), "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = to_pivot.filter("taken").select(F.col("p").alias("a"), F.col("id").alias("b")).union(sets_of_key).union(twice)
    for part in within:
        links = links.union(part)
    label = components(links)
    return made, made_path, cut(firsts.select("fp", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")))


def link_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles (set size) and component_id (the smallest key reachable by links) per row.

    Two documents link when 100 * intersection >= percent * union of their k-word shingle sets.
    Words stand between ASCII white space, A-Z in lower case; a text of fewer words is one shingle;
    texts without words, and null texts, have no shingle and no link. A null key has no link and a
    null component. Rows that repeat a key count as one document with the links of all of them.
    Equal texts link. An empty table gives no row; other columns are ignored.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be at least 50 and below 100")
    spark = docs.sparkSession
    with scope(spark) as own:
        made, made_path, named = _named(docs, k, percent, key, text)
        own.keep(made_path, named)
    whole = made.select("id", "n", "fp").join(named, "fp", "left")
    return whole.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key stands in gone (one column of that type, materialised). Only rows
    that a filter of fixed size can't tell from those are shuffled; null keys stay."""
    held, columns = docs.sparkSession.sparkContext.broadcast(_bits(gone.select(F.xxhash64(gone.columns[0])), SHARED_BITS)), docs.columns

    def passing(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column(batch.num_columns - 1).to_numpy()
                yield batch.filter(pa.array(_set_in(held.value, cells) == inside)).select(columns)

        return docs.withColumn("__cell", F.xxhash64(key)).transform(mapped, run, docs.schema)

    return passing(False).union(passing(True).join(gone.select(F.col(gone.columns[0]).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by links of at least 0.9 on three-word shingles."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
