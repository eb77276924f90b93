"""Incremental runs: change streams merged into tables, and delta runs with watermarks that survive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_per_key(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Each key's last row of a batch."""
    row = F.max_by(F.struct(*batch.columns), sequence)
    return batch.groupBy(key).agg(row.alias("_r")).select("_r.*")


def merge_batch(table: DataFrame, batch: DataFrame, key: str, sequence: str, kind: str) -> DataFrame:
    """The table after a batch of changes (kind D deletes). Rows not newer than the table's change nothing, so a batch
    may come twice."""
    last = latest_per_key(batch, key, sequence)
    seen = table.select(key, F.col(sequence).alias("_seen"))
    last = last.join(seen, key, "left").filter(F.col("_seen").isNull() | (F.col(sequence) > F.col("_seen"))).drop("_seen")
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(F.col(kind) != "D").select(*table.columns))


class VersionedTable:
    """A Parquet table in versions: a batch writes the next one, and its number names the last that is whole.

    The version of a batch is its number, so a batch that is run again overwrites what it may have left half done. The
    last two versions stay: the one before is what a batch that is run again starts from.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) < version - 1:
                fs.delete(s.getPath(), True)


def stream_changes(stream: DataFrame, table: VersionedTable, key: str, sequence: str, kind: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of changes into a table; offsets are committed after each batch. Runs until all there is has been read."""

    def merge(batch: DataFrame, number: int) -> None:
        table.write(merge_batch(table.read(number - 1), batch, key, sequence, kind), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_changes(stream: DataFrame, path: str, key: str, sequence: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's last change of every key to a folder of its own, whole or again: a batch writes what it brings and
    reads nothing. Runs until all there is has been read."""

    def write(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, key, sequence).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, schema: str, key: str, sequence: str, kind: str) -> DataFrame:
    """What the changes of `append_changes` amount to: each key's last row, unless that deletes it (kind D)."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path).drop("batch")
    return latest_per_key(rows, key, sequence).filter(F.col(kind) != "D")


def compact(spark: SparkSession, path: str, into: str, schema: str, key: str, sequence: str) -> None:
    """Each key's last change, deletions too (later batches may bring older ones), as the one batch of another folder."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path).drop("batch")
    latest_per_key(rows, key, sequence).write.parquet(f"{into.rstrip('/')}/batch=-1")


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window of event time and `by`, for streams and tables. An addition, for event data."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"))


def delta_run(df: DataFrame, column: str, mark: object | None, process: Callable[[DataFrame], None], cancelled: Callable[[], bool] = lambda: False) -> object | None:
    """Process the rows above the mark and return the next one: the greatest value when the run began.

    Without rows it moves on too; a cancelled run keeps the old mark.
    """
    top = df.agg(F.max(column)).first()[0]
    rows = df if mark is None else df.filter(F.col(column) > F.lit(mark))
    process(rows if top is None else rows.filter(F.col(column) <= F.lit(top)))
    return mark if cancelled() or top is None else top


def due_now(schedule: DataFrame, now: datetime) -> DataFrame:
    """Schedules whose next run has come, with the seconds they are late."""
    at = F.lit(now).cast("timestamp")
    return schedule.filter(F.col("enabled") & (F.col("next_run") <= at)).withColumn("late", F.unix_seconds(at) - F.unix_seconds("next_run"))
