"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask chooses some of a few consecutive words and ignores the others, so that its hash
survives a substitution at an ignored place. The seeds of all test items are joined with those of
all training texts. A hit tells where an item would lie in a text; there the item's words are held
against the text's, place by place, and the text is contaminated if in some window of the item
enough words are equal.

Masks can miss an item of few words. Such an item is cut into one block more than it may have
substitutions, so that one block at least is whole in any match, and the blocks are seeds too. An
item of one word is joined with the words of the texts, each at its first place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, sifted

#: Chosen places of each mask; all masks have the same span.
MASKS = ((0, 1, 3, 5, 6), (0, 2, 3, 4, 6))
WINDOW, SHARE = 20, 0.75
#: Items of fewer words are looked for by blocks.
SHORT = 15
BROADCAST_SEEDS = 1_000_000
#: About so many places of a text are held against items in one row; a text with more hits has several.
HITS = 1000
#: A character of a script without spaces between words.
UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}]"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text: runs of letters and digits, in lower case, and single
    characters of scripts without spaces."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(words: Column, masks=MASKS) -> Column:
    """A hash for every mask and place, mask by mask; none for texts shorter than the span."""
    span = max(map(max, masks)) + 1
    places = F.sequence(F.lit(0), F.size(words) - span)

    def of(number: int, mask) -> Column:
        return F.transform(places, lambda i: F.xxhash64(F.lit(number), *(words[i + o] for o in mask)))

    return F.when(F.size(words) >= span, F.concat(*(of(k, m) for k, m in enumerate(masks)))).otherwise(F.array().cast("array<bigint>"))


def blocks(n: int, share: float = SHARE) -> list[tuple[int, int]]:
    """Begin and length of the blocks of an item of n words: no substitutions that share allows touch all of them."""
    parts = n - math.ceil(n * share) + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per text and item that it holds: key, item_key, start (the place in words where the
    item begins, negative where its front is cut off), n_equal (equal words of the item there).

    A pair counts when within some window consecutive words of the item (all of a shorter item) at
    least share are equal at one alignment; of several alignments the one with most equal words is
    returned, then the first. Of items with fewer than SHORT words (and no more than window) no match
    is missed, down to items of one word. Null and empty texts hold nothing, and items without words
    are in none; rows with null keys are not joined and give no row; rows that
    repeat a key count as one text; empty tables give no row; other columns are ignored.
    The items' seeds are broadcast up to BROADCAST_SEEDS of them, else joined by a shuffle. Only texts
    that have a hit are shuffled, to be held against the items.
    """
    span = max(map(max, masks)) + 1

    def hashed(rows: DataFrame, name: str, body: str) -> DataFrame:
        # exploding one array of words keeps the optimizer from computing it anew for every use
        return rows.filter(F.col(name).isNotNull()).select(F.col(name).alias("id"), F.explode(F.array(word_hashes(F.col(body)))).alias("words"))

    texts, tests = hashed(docs, key, text), hashed(items, item_key, item_text).filter(F.size("words") > 0)

    def places(rows: DataFrame) -> DataFrame:
        made = rows.filter(F.size("words") >= span).select("id", (F.size("words") - span + 1).alias("n"), seeds(F.col("words"), masks).alias("seeds"))
        return made.select("id", "n", F.posexplode("seeds").alias("k", "seed")).select("id", F.pmod("k", "n").alias("at"), "seed")

    def runs(words: Column, at: Column, length: int) -> Column:
        return F.struct(at.alias("at"), F.xxhash64(F.lit(-length), *(words[at + o] for o in range(length))).alias("seed"))

    theirs = places(tests).select(F.col("id").alias("item"), F.col("at").alias("item_at"), "seed").distinct()
    n = tests.agg(F.coalesce(F.sum(F.size("words") * len(masks)), F.lit(0))).first()[0]
    hits = places(texts).join(F.broadcast(theirs) if n <= BROADCAST_SEEDS else theirs, "seed")
    found = hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("start"))

    # short items: each length has its own blocks, and the texts need seeds of the lengths of these only
    short = min(max(SHORT, span) - 1, window)
    sizes = [r[0] for r in tests.filter((F.size("words") <= short) & (F.size("words") > 1)).select(F.size("words")).distinct().collect()]
    if sizes:
        cuts = F.lit(None)
        for size in sizes:
            cuts = F.when(F.size("words") == size, F.array(*(runs(F.col("words"), F.lit(i), length) for i, length in blocks(size, share)))).otherwise(cuts)
        few = tests.select("id", F.explode(cuts).alias("s")).select(F.col("id").alias("item"), F.col("s.at").alias("item_at"), "s.seed").distinct()
        lengths = sorted({length for size in sizes for _, length in blocks(size, share)})
        of = lambda m: F.when(F.size("words") >= m, F.transform(F.sequence(F.lit(0), F.size("words") - m), lambda i: runs(F.col("words"), i, m))).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))
        ours = texts.select("id", F.explode(F.concat(*map(of, lengths))).alias("s")).select("id", "s.at", "s.seed")
        hits = ours.join(F.broadcast(few) if n <= BROADCAST_SEEDS else few, "seed")
        found = found.union(hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("start")))
    found = cut(found.distinct())

    bodies = sifted(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", found.select("id"))
    lots = F.ceil(F.count(F.lit(1)).over(W.partitionBy("id")) / F.lit(HITS))
    lot = F.pmod(F.xxhash64("item", "start"), lots).alias("lot")
    held = bodies.join(found.select("*", lot).groupBy("id", "lot").agg(F.collect_set(F.struct("item", "start")).alias("found")).drop("lot"), "id")
    held = held.select("id", "found", F.explode(F.array(word_hashes(F.col("text")))).alias("words")).select("id", "words", F.explode("found").alias("f"))
    pairs = held.select("id", "words", "f.item", "f.start").join(tests.select(F.col("id").alias("item"), F.col("words").alias("want")), "item")
    place = F.sequence(F.lit(0), F.size("want") - 1)
    same = F.transform(place, lambda i: F.coalesce((F.get("words", i + F.col("start")) == F.get("want", i)).cast("int"), F.lit(0)))
    pairs = pairs.select("id", "item", "start", same.alias("same")).withColumn("wide", F.least(F.size("same"), F.lit(window)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - F.col("wide")), lambda i: total(F.slice("same", i + 1, F.col("wide")))))
    kept = pairs.filter(best >= F.ceil(F.col("wide") * share)).select("id", "item", "start", total(F.col("same")).alias("n_equal"))

    # an item of one word is in every text that has it, first where the word first stands
    lone = tests.filter(F.size("words") == 1).select(F.col("id").alias("item"), F.get("words", F.lit(0)).alias("word"))
    asked = lone.select("word").distinct()
    stands = texts.select("id", F.posexplode("words").alias("at", "word")).join(F.broadcast(asked) if n <= BROADCAST_SEEDS else asked, "word", "left_semi")
    first = stands.groupBy("id", "word").agg(F.min("at").alias("start")).join(lone, "word")
    kept = kept.unionByName(first.select("id", "item", "start", F.lit(1).alias("n_equal"))) if not lone.isEmpty() else kept
    top = kept.groupBy("id", "item").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("start"))).alias("x"))
    return top.select(F.col("id").alias(key), F.col("item").alias(item_key), (-F.col("x.start")).alias("start"), F.col("x.n_equal").alias("n_equal"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without the contaminated rows, all columns as they are. Most rows pass without a shuffle;
    only those that share a cell with a contaminated key are joined with these keys."""
    bad = cut(contaminated(docs, items, key=key, **options).select(F.col(key).alias("__leak_key")).distinct())
    doubtful = sifted(docs, key, bad)
    return sifted(docs, key, bad, outside=True).unionByName(doubtful.join(bad, doubtful[key] == bad["__leak_key"], "left_anti"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_MASKED = " UNION ALL ".join(
    f"SELECT id, i AS at, {k} AS mask, {' || chr(31) || '.join(f'words[i + {o + 1}]' for o in m)} AS seed FROM {{t}}, unnest(range(len(words) - {max(m)})) AS u(i) WHERE len(words) > {max(m)}"
    for k, m in enumerate(MASKS)
)

ORACLE = f"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({_MASKED.format(t="d")}),
bs AS ({_MASKED.format(t="b")}),
c AS (SELECT DISTINCT ds.id, bs.id AS item, ds.at - bs.at AS start FROM ds JOIN bs USING (mask, seed)),
e AS (
  SELECT c.*, list_transform(range(len(b.words)), lambda i: CASE WHEN i + c.start >= 0 AND i + c.start < len(d.words) AND d.words[i + c.start + 1] = b.words[i + 1] THEN 1 ELSE 0 END) AS same
  FROM c JOIN d ON d.id = c.id JOIN b ON b.id = c.item),
w AS (SELECT *, least(len(same), {WINDOW}) AS wide FROM e),
k AS (
  SELECT id, item, start, list_sum(same)::INT AS n_equal FROM w
  WHERE list_max(list_transform(range(len(same) - wide + 1), lambda i: list_sum(same[i + 1 : i + wide]))) >= ceil(wide * {SHARE}))
SELECT id AS doc_id, item AS item_id, start::INT AS start, n_equal FROM k
QUALIFY row_number() OVER (PARTITION BY id, item ORDER BY n_equal DESC, start) = 1
"""
