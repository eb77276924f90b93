"""Change hints: a stream of ids alone, and a re-read of what they name.

A feed says how far it has come and gives the ids of a range of its hints. Hints tell when to look, not what is there: the
rows are read again from their table, so a hint that comes twice, late, or for a row that is gone changes nothing that
isn't so. Hints may get lost, so a sweep from time to time takes what is newer than the last one looked at.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

#: Hints of a partition.
PARTITION_HINTS = 100_000


class Feed(Protocol):
    """Hints by number, from 1. ids may leave numbers out; forget, where there is one, is told what is done with."""

    def latest(self) -> int: ...

    def ids(self, first: int, last: int) -> Iterator[tuple[int, int]]: ...


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class HintReader(DataSourceStreamReader):
    def __init__(self, feed: Feed, options: dict):
        self.feed, self.start = feed, int(options.get("start", "0"))
        self.most = int(options.get("partition_hints", str(PARTITION_HINTS)))

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        return {"seq": self.feed.latest()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(i, min(i + self.most - 1, end["seq"])) for i in range(start["seq"] + 1, end["seq"] + 1, self.most)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from self.feed.ids(partition.first, partition.last)

    def commit(self, end: dict) -> None:
        if forget := getattr(self.feed, "forget", None):
            forget(end["seq"])


class HintSource(DataSource):
    feed: Feed

    def schema(self) -> str:
        return "seq long, id long"

    def streamReader(self, schema) -> HintReader:
        return HintReader(type(self).feed, self.options)


def hint_stream(spark: SparkSession, feed: Feed, **options: str) -> DataFrame:
    """seq, id: a stream of a feed's hints. The feed is sent to the workers as it is."""
    for module in {__name__, type(feed).__module__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    own = f"hints_{uuid.uuid4().hex}"
    spark.dataSource.register(type("OwnHints", (HintSource,), {"feed": feed, "name": classmethod(lambda cls: own)}))
    return spark.readStream.format(own).options(**options).load()


def named(hints: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The ids of a batch of hints, once each, with the row that the table has for it now: `found` is false where it has none."""
    ids = hints.select(F.col("id").alias(key)).filter(f"{key} is not null").distinct()
    return ids.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def newer(table: DataFrame, key: str, version: str, mark: object | None, known: DataFrame) -> DataFrame:
    """What hints may have missed: rows above the mark (all, without one), which the scan can skip by, and the keys of known
    rows that the table no longer has."""
    rows = table if mark is None else table.filter(F.col(version) > F.lit(mark))
    gone = known.select(key).join(table.select(key), key, "left_anti")
    out = rows.withColumn("found", F.lit(True))
    return out.unionByName(gone.withColumn("found", F.lit(False)), allowMissingColumns=True)


class Looked:
    """What has been looked at: a folder of rows by the batch that looked (found or not), each written whole or again.

    A key's state is its row of the latest batch; batches and sweeps are numbered in the order they were made.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def add(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/n={number}")

    def state(self, key: str) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, found boolean, n long").option("basePath", self.path).parquet(self.path)
        row = F.max_by(F.struct(*rows.columns), F.struct("n", "found"))
        return rows.groupBy(key).agg(row.alias("r")).select("r.*").filter("found").drop("n", "found")


def follow(stream: DataFrame, table: Callable[[], DataFrame], key: str, looked: Looked, checkpoint: str, number: int) -> StreamingQuery:
    """Look at what the new hints name, as the table is when each batch is read. number: that of this run, above all before;
    a batch that is done again overwrites what it wrote."""

    def batch(hints: DataFrame, n: int) -> None:
        looked.add(named(hints, table(), key), number * 1_000_000 + n)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def sweep(table: DataFrame, key: str, version: str, mark: object | None, looked: Looked, number: int) -> object | None:
    """Look at what hints of this run or before have missed, and give the mark of the next sweep: the greatest version when
    this one began. A run's sweep comes after its hints; the first needs no mark and takes all."""
    top = table.agg(F.max(version)).first()[0]
    known = looked.state(key) if mark is not None else table.limit(0)
    looked.add(newer(table, key, version, mark, known), number * 1_000_000 + 999_999)
    return mark if top is None else top
