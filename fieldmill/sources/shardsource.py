"""Shards as a data source of their own: files count when the manifest names them.

``df.write.format("fieldmill_shards").option("size", 500).mode("append").save(path)`` writes each
task's rows, by shard, under names of its own in the job's folder. When all tasks are done the commit
puts a manifest entry in place that names the files; where the job fails its folder is removed, with
what tasks left there that nobody was told of, and there is no entry. mode("overwrite") makes the new
entry the only one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .paths import children, text_of


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name, shard_index, example_start, example_end, row_count."""

    files: list[dict] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, size: int, index: str, overwrite: bool):
        self.path, self.size, self.index, self.overwrite = path, size, index, overwrite
        self.folder = f"data/job={uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows by shard, one file open a shard that the task has met (rows come sorted or nearly so)."""
        fs, root = _filesystem(self.path)
        own, opened, told = uuid.uuid4().hex, {}, {}
        try:
            for batch in iterator:
                shard = pc.floor(pc.divide(batch.column(batch.schema.names.index(self.index)).cast(pa.float64()), float(self.size))).cast(pa.int64()).to_numpy()
                for s in np.unique(shard).tolist():
                    rows = batch.filter(pa.array(shard == s))
                    at = rows.column(rows.schema.names.index(self.index))
                    if s not in opened:
                        fs.create_dir(f"{root}/{self.folder}/shard_index={s}", recursive=True)
                        told[s] = {"file": f"{self.folder}/shard_index={s}/part-{own}.parquet", "shard_index": s, "example_start": None, "example_end": None, "row_count": 0}
                        opened[s] = pq.ParquetWriter(f"{root}/{told[s]['file']}", batch.schema, filesystem=fs)
                    opened[s].write_batch(rows)
                    low, high, t = pc.min(at).as_py(), pc.max(at).as_py() + 1, told[s]
                    t["example_start"] = low if t["example_start"] is None else min(low, t["example_start"])
                    t["example_end"] = max(high, t["example_end"] or high)
                    t["row_count"] += rows.num_rows
            for w in opened.values():
                w.close()
        except BaseException:
            for t in told.values():
                if fs.get_file_info(f"{root}/{t['file']}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{t['file']}")
            raise
        return Written(list(told.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The manifest entry appears under its name when it is whole."""
        fs, root = _filesystem(self.path)
        entry = {"files": [f for m in messages if m is not None for f in m.files]}
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        fs.create_dir(f"{root}/manifest", recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifest")) if f.path.endswith(".json")] if self.overwrite else []
        with fs.open_output_stream(f"{root}/_{name}") as out:
            out.write(json.dumps(entry | {"replaces": [p.rpartition("/")[2] for p in before]}).encode())
        fs.move(f"{root}/_{name}", f"{root}/manifest/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.folder}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.folder}")


class Shards(DataSource):
    """Options: path, size (rows a shard), index (the column of example numbers)."""

    @classmethod
    def name(cls) -> str:
        return "fieldmill_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("size", 500)), self.options.get("index", "example_index"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shards)


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The files that the manifest's entries name, entries replaced by later ones left out."""
    told = {n: json.loads(text_of(spark, f"{path}/manifest/{n}")) for n in children(spark, f"{path}/manifest") if n.endswith(".json")}
    replaced = {n for e in told.values() for n in e["replaces"]}
    return [f for n, e in sorted(told.items()) if n not in replaced for f in e["files"]]


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows, with shard_index."""
    files = [f"{path}/{f['file']}" for f in committed(spark, path)]
    reader = spark.read.schema(f"{schema}, shard_index long")
    return reader.option("basePath", f"{path}/data").parquet(*files).drop("job") if files else spark.createDataFrame([], f"{schema}, shard_index long")
