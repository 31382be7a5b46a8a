"""Scans. Paths may be in any file system that Spark reads; schemas are declared, not inferred."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.history import last_wins
from . import arrays
from .paths import children, exists

EXAMPLE = "instruction string, input string, output string, _meta struct<sample_id:string,document_name:string,source_file:string>"
CACHE = (
    "_sample_id long, instruction string, input string, output string, teacher_model string, teacher_output string, "
    "teacher_steps array<struct<position:int,token:string,logprob:double,prob:double,top_candidates:array<struct<token:string,logprob:double,prob:double>>>>"
)
MANIFEST = (
    "created_at_utc string, source_path string, source_dataset_sha256 string, teacher_model string, top_k int, shard_size int, batch_size int, tensor_parallel_size int, max_model_len int, "
    "total_examples int, chat_template_fingerprint string, total_shards int, shards array<struct<shard_index:int,path:string,example_start:int,example_end:int,row_count:int>>"
)


def json_array(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """A file that holds one JSON array of records; anything else fails. Large files are read in splits."""
    return _array(spark, path, schema).select("r.*")


def _array(spark: SparkSession, path: str, schema: str, index: bool = False) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = arrays.records(spark, path)
    parsed = F.from_json("text", StructType.fromDDL(schema), {"mode": "FAILFAST"}).alias("r")
    return arrays.numbered(rows).select("example_index", parsed) if index else rows.select(parsed)


def eval_dataset(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """A file of evaluation records, an array or a single object; a missing file fails."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """A file's JSON as one variant value."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))


def indexed(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """The records of a JSON array with their place in it, example_index."""
    return _array(spark, path, schema, index=True).select("example_index", "r.*")


def corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Examples of several files, with the corpus they belong to."""
    parts = [json_array(spark, p).withColumn("corpus", F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def first_existing(spark: SparkSession, paths: list[str], rows: int) -> DataFrame:
    """The first rows examples, with example_index, of the first path that exists."""
    for p in paths:
        if exists(spark, p):
            return indexed(spark, p).orderBy("example_index").limit(rows)
    raise FileNotFoundError(", ".join(paths))


def concatenated(spark: SparkSession, paths: list[str], rows: int) -> DataFrame:
    """The first rows examples of the files in their order, with file_index and example_index. One
    plan: every file gives its own first rows at most, and the first of these are kept."""
    parts = [indexed(spark, p).orderBy("example_index").limit(rows).select(F.lit(i).alias("file_index"), "*") for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts).orderBy("file_index", "example_index").limit(rows)


def shards(spark: SparkSession, path: str, rows: int | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Soft-label shards in example order, the first rows of them if given. With the run's manifest only
    the shards that hold these are scanned: the row counts, summed in order, tell the last of them."""
    df = spark.read.parquet(path)
    if rows is not None and manifest is not None:
        before = W.orderBy("s.example_start").rowsBetween(W.unboundedPreceding, -1)
        upto = manifest.select(F.explode("shards").alias("s")).select("s.shard_index", F.coalesce(F.sum("s.row_count").over(before), F.lit(0)).alias("before"))
        last = upto.filter(F.col("before") < rows).agg(F.max("shard_index")).first()[0]
        df = df.filter(F.col("shard_index") <= (-1 if last is None else last))
    df = df.orderBy("example_index")
    return df if rows is None else df.limit(rows)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """The shard_index of every shard whose files are there."""
    found = [int(n.partition("=")[2]) for n in children(spark, path) if n.startswith("shard_index=")]
    return spark.createDataFrame([(i,) for i in found], "shard_index long")


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A run's manifest; without strict a missing one is an empty table."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def jsonl_cache(spark: SparkSession, path: str, schema: str = CACHE, key: str = "_sample_id") -> DataFrame:
    """A JSON-lines cache; of rows with the same key the last one wins: that of the file written last,
    in it the one that stands last (files are read in splits, hence by where a split begins and the
    line's place in it, which doesn't depend on how splits are dealt to tasks)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    m = lambda name: F.col(f"_metadata.{name}")
    lines = spark.read.text(path).select("value", m("file_modification_time").cast("timestamp_ntz").alias("_t"), m("file_path").alias("_f"), m("file_block_start").alias("_b"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the place of a line in its split, _i, counted as the split is read."""
        now, count = None, 0
        for batch in batches:
            places = []
            for split in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                now, count = split, count + 1 if split == now else 0
                places.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, type=pa.int64())], names=[*batch.schema.names, "_i"])

    read = lines.mapInArrow(placed, "value string, _t timestamp_ntz, _f string, _b long, _i long").filter(F.trim("value") != "")
    df = read.select(F.from_json("value", schema).alias("r"), "_t", "_f", "_b", "_i").select("r.*", "_t", "_f", "_b", "_i")
    return last_wins(df, [key], ["_t", "_f", "_b", "_i"]).drop("_t", "_f", "_b", "_i")


def csv_history(spark: SparkSession, path: str) -> DataFrame:
    """A metric history, an empty one where there is no file; all columns are text."""
    if not exists(spark, path):
        return spark.createDataFrame([], "step string")
    return spark.read.option("header", True).csv(path)


def kd_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
