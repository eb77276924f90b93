"""Staged objects as bucketed tables: a run shuffles what came in, not what is staged.

A generation of a staged table is bucketed by the key that runs join on (an external id, or an entity), a file a bucket.
Joins and aggregations by that key read it where it lies; only the other side is dealt into its buckets. A run's result is
the next generation: what stays is written from where it was read, with the new and changed rows dealt to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.diff import object_changes
from rillstone.schema import Attribute

#: What a bucket should hold, compressed.
BUCKET_BYTES = 256 << 20
MOST_BUCKETS = 1 << 16


def buckets_for(size: int) -> int:
    """The least power of two by which buckets hold BUCKET_BYTES at most. Two tables join where they lie if their numbers are
    equal; with spark.sql.bucketing.coalesceBucketsInJoin.enabled also if one is a multiple of the other."""
    return min(MOST_BUCKETS, 1 << max(0, (max(size, 1) - 1) // BUCKET_BYTES).bit_length())


@dataclass(frozen=True)
class Staging:
    """A generation of a staged table: where it lies, what it is bucketed by, and into how many."""

    table: str
    path: str
    key: tuple[str, ...]
    buckets: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def dealt(self, df: DataFrame) -> DataFrame:
        """df's rows in the partitions of the buckets that they belong to."""
        return df.repartition(self.buckets, *self.key)

    def write(self, df: DataFrame) -> Staging:
        """Write df, which is dealt, as this generation."""
        rows = df.sortWithinPartitions(*self.key).write.mode("errorifexists").option("path", self.path)
        rows.bucketBy(self.buckets, *self.key).sortBy(*self.key).format("parquet").saveAsTable(self.table)
        return self

    def register(self, spark: SparkSession, columns: str) -> Staging:
        """Make a generation that another session wrote known to this one's catalogue. columns: `name type, ...`."""
        keys = ", ".join(f"`{k}`" for k in self.key)
        spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def following(self, n: int) -> Staging:
        """The place of the n-th generation after this one."""
        return Staging(f"{self.table}_{n}", f"{self.path}-{n}", self.key, self.buckets)


def stage(df: DataFrame, table: str, path: str, key: list[str], buckets: int) -> Staging:
    """The first generation of a staged table: the one time that all of it is shuffled."""
    s = Staging(table, path, tuple(key), buckets)
    return s.write(s.dealt(df))


@dataclass
class Import:
    """What an import finds in a staged table. matched: incoming rows with staged_id; changes: key, change, changed; after:
    the rows of the next generation, in the partitions of its buckets."""

    matched: DataFrame
    changes: DataFrame
    after: DataFrame


def imported(spark: SparkSession, s: Staging, incoming: DataFrame, attributes: list[Attribute], id_col: str, full: bool = True) -> Import:
    """An import against a staged table that has id_col beside the key and the attributes.

    A full import marks staged objects that it lacks for deletion, one without rows none. A delta (full off) touches only
    what it has, and a row of it with a true `deleted` takes its object away; a deletion of what isn't staged does nothing.
    New objects get no id here: their id_col is null until they are given one.
    """
    key, staged = list(s.key), s.frame(spark)
    arrived = incoming
    if "deleted" in incoming.columns:
        gone = incoming.filter("deleted").select(*key)
        arrived = incoming.filter("deleted is null or not deleted").drop("deleted")
    else:
        gone = incoming.select(*key).limit(0)
    matched = arrived.join(staged.select(*key, F.col(id_col).alias("staged_id")), key, "left")
    changes = object_changes(staged, arrived, key, attributes, full)
    if not full:
        changes = changes.union(staged.select(*key).join(gone, key, "left_semi").select(*key, F.lit("delete"), F.array().cast("array<string>")))
    new = changes.filter("change <> 'none'").select(*key, "change")
    names = [c for c in staged.columns if c not in (*key, id_col)]
    came = s.dealt(arrived.join(new.filter("change <> 'delete'"), key).join(staged.select(*key, id_col), key, "left").select(*key, id_col, *names))
    kept = staged.join(s.dealt(new.select(*key)), key, "left_anti").select(*key, id_col, *names)
    return Import(matched, changes, kept.unionByName(came))
