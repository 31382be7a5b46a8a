"""Files that hold one JSON array, scanned in splits as lines are.

A file is read as text that ends at each closing brace, so Spark's own splits apply. Whether a split
begins inside a string, and how deep, follows from the splits before it: the first pass tells, for
either case, whether a split has an odd number of quotes and by how much it changes the depth. These
are summed in file order, and the second pass, which knows where it begins, cuts the records out.
What a split holds of a record that began before it, or ends behind it, is joined with its other parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_OUTSIDE = re.compile(r"[\s,\[\]\ufeff]*\Z")
STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """f, b (file and start of the split) and value: text up to a closing brace, which is left out, in order."""
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for value, f, b in zip(*(c.to_pylist() for c in batch.columns)):
            yield (f, b), value


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: whether the quotes in it are odd, the change of depth if it begins outside strings
    (d0) and inside one (d1), and its first character that isn't white space."""
    rows, now = [], None
    for split, value in _by_split(batches):
        if split != now:
            now = split
            rows.append([*split, 0, [0, 0], ""])
        row = rows[-1]
        row[4] = row[4] or value.lstrip(" \t\r\n\ufeff")[:1]
        for m in _TOKEN.finditer(value):
            t = m[0]
            if t == '"':
                row[2] ^= 1
            elif t in STEP:
                row[3][row[2]] += STEP[t]
        row[3][row[2]] -= 1  # the brace at the end
        if not row[4]:
            row[4] = "}"
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], type=pa.int32()), pa.array([r[3][0] for r in rows], type=pa.int64()), pa.array([r[3][1] for r in rows], type=pa.int64()), pa.array([r[4] for r in rows])], names=["f", "b", "odd", "d0", "d1", "c"])


def _states(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, int]]:
    """For each split whether it begins inside a string, and at what depth: one entry a split. Files
    that don't hold an array are an error."""
    rows = _pieces(spark, path).mapInArrow(_survey, "f string, b long, odd int, d0 long, d1 long, c string")
    order = W.partitionBy("f").orderBy("b")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    begun = rows.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    deep = begun.withColumn("d", F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0")))
    told = deep.select("f", "b", "c", "inside", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("depth"), F.row_number().over(order).alias("n"), (F.sum("d").over(W.partitionBy("f"))).alias("end"), (F.sum("odd").over(W.partitionBy("f")) % 2).alias("open")).collect()
    if not told or any(r.n == 1 and r.c != "[" for r in told):
        raise ValueError(f"{path} holds no JSON array")
    if any(r.open or r.end != -1 for r in told):  # the last piece has no brace
        raise ValueError(f"{path} ends inside its array")
    return {(r.f, r.b): (r.inside, r.depth) for r in told}


def records(spark: SparkSession, path: str) -> DataFrame:
    """f, b, n and text of every record of the arrays under path; b and n (from 0) tell in which split
    and as which it ends there, so they order the records of a file. Elements that are no objects are an error."""
    states = spark.sparkContext.broadcast(_states(spark, path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records and parts of records: kind 0 a whole one, 1 the end of one, 2 a middle, 3 a beginning."""
        out: list[tuple] = []
        now, inside, depth, held, begun, n = None, 0, 0, [], False, 0

        def rest() -> None:
            if now is not None and depth > 1 and held:
                out.append((*now, n, 3 if begun else 2, "".join(held)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["f", "b", "n", "kind", "text"])
            out.clear()
            return made

        for split, value in _by_split(batches):
            if split != now:
                rest()
                now, (inside, depth), held, begun, n = split, states.value[split], [], False, 0
            text, at = value + "}", 0
            for m in _TOKEN.finditer(text):
                t = m[0]
                if t == '"':
                    inside ^= 1
                elif not inside and t in STEP:
                    if depth == 1 and t == "{":
                        if not _OUTSIDE.match(text, at, m.start()):
                            raise ValueError(f"{now[0]} holds elements that are no records")
                        at, held, begun = m.start(), [], True
                    depth += STEP[t]
                    if depth == 1 and t == "}":
                        held.append(text[at : m.end()])
                        out.append((*now, n, 0 if begun else 1, "".join(held)))
                        n, at, held, begun = n + 1, m.end(), [], False
            if depth > 1:
                held.append(text[at:])
            elif not _OUTSIDE.match(text[at:].removesuffix("}") if depth < 1 else text[at:]):
                raise ValueError(f"{now[0]} holds elements that are no records")
            if len(out) >= 1000:
                yield batch()
        rest()
        if out:
            yield batch()

    rows = _pieces(spark, path).mapInArrow(cut, "f string, b long, n long, kind int, text string")
    # parts of one record follow one another; each beginning opens a group, and the end tells where it stands
    parts = rows.filter("kind > 0").withColumn("g", F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).over(W.partitionBy("f").orderBy("b", "n").rowsBetween(W.unboundedPreceding, 0)))
    joined = parts.groupBy("f", "g").agg(F.array_sort(F.collect_list(F.struct("b", "n", "text"))).alias("p"))
    joined = joined.select("f", F.element_at("p", -1)["b"].alias("b"), F.element_at("p", -1)["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return rows.filter("kind = 0").select("f", "b", "n", "text").unionByName(joined)


def numbered(rows: DataFrame) -> DataFrame:
    """records() with example_index, the record's place in its file: its place in the split and the
    number of records that end in the splits before."""
    counts = rows.groupBy("f", "b").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("f", "b", F.coalesce(F.sum("c").over(W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, ["f", "b"]).select("f", (F.col("before") + F.col("n")).alias("example_index"), "text")
