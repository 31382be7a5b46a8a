"""Score generations as they arrive, each step once, and resume where a run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import logged_steps, to_long, with_pending_loss
from ..operators.scoring import corpus_metrics, score
from ..sources.paths import exists, remove

GENERATION = "step long, corpus string, sample_idx long, gt string, pred string"
KEPT = 3
METRICS = ["accuracy_pct", "parse_errors", "valid_json", "matched_fields", "total_fields", "examples"]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A version of a history; one that isn't there is an error, not an empty history."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def no_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "step long, corpus string, metric string, value double")


def score_step(batch: DataFrame, losses: DataFrame | None = None) -> DataFrame:
    """The long metrics of a batch of generations, with the loss of its steps where there is one."""
    metrics = corpus_metrics(score(batch, ["step", "corpus", "sample_idx"]))
    names = METRICS
    if losses is not None:
        metrics, names = with_pending_loss(metrics, losses), [*METRICS, "loss"]
    return to_long(metrics.withColumn("corpus", F.coalesce("corpus", F.lit("overall"))), ["step", "corpus"], names)


def score_stream(spark: SparkSession, source: str, history: str, checkpoint: str, losses: DataFrame | None = None, on_step: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Score the JSON files of generations in source that weren't scored before, then stop.

    A step already in the history is skipped. A batch that is replayed writes the same version of
    the history again: versions are folders named by batch, each made from the one before, and only
    the last KEPT of them stay. on_step gets a batch's new long metrics and its number.
    """
    stream = spark.readStream.schema(GENERATION).json(source)

    def each(batch: DataFrame, number: int) -> None:
        before = read_history(spark, f"{history}/v={number - 1}") if number else no_history(spark)
        fresh = score_step(batch.join(logged_steps(before), "step", "left_anti"), losses)
        # fresh has no step of before, so nothing is replaced, and a batch is scored once
        before.unionByName(fresh, allowMissingColumns=True).write.mode("overwrite").parquet(f"{history}/v={number}")
        if on_step:
            on_step(spark.read.parquet(f"{history}/v={number}").join(logged_steps(before), "step", "left_anti"), number)
        if number >= KEPT:
            remove(spark, f"{history}/v={number - KEPT}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, history: str, versions: int) -> DataFrame:
    """The history after so many batches."""
    return read_history(spark, f"{history}/v={versions - 1}")


def teacher_rows(examples: DataFrame, done: DataFrame, key: str, backend, schema: str) -> DataFrame:
    """Ask a teacher for the examples that done lacks. backend takes an iterator of pandas frames and
    gives frames of schema: a session to a server is opened once a partition."""
    return examples.join(done.select(key).distinct(), key, "left_anti").mapInPandas(backend, schema)
