"""Pages of very large results by a stored rank index.

The result is sorted once, by ranges: every part holds a range of the order, and a small table its number of rows, how many
lie before it, and its first and last key. An offset or a key then names the parts that a page lies in, and nothing else is
read or sorted, however far down the page is.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.operators.query import LARGEST_PAGE

#: Rows of a part.
PART_ROWS = 1_000_000


def _order(keys: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.col(k).desc() if down else F.col(k).asc() for k, down in keys]


def beyond(keys: tuple[tuple[str, bool], ...], last: tuple, of: str = "") -> Column:
    """Rows strictly after `last` in the order of keys: nulls come first going up and last going down."""
    found = F.lit(False)
    same = F.lit(True)
    for (k, down), v in zip(keys, last, strict=True):
        c = F.col(of + k)
        if v is None:
            more = F.lit(False) if down else c.isNotNull()
        else:
            more = (c < F.lit(v)) | c.isNull() if down else F.coalesce(c > F.lit(v), F.lit(False))
        found = found | (same & more)
        same = same & c.eqNullSafe(F.lit(v))
    return found


@dataclass(frozen=True)
class PageIndex:
    """A stored order: rows by part and rank in it, and the table of parts. keys: (column, descending), unique together."""

    path: str
    keys: tuple[tuple[str, bool], ...]
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def parts(self, spark: SparkSession) -> DataFrame:
        """part, n, before, first, last: a row for each part."""
        return spark.read.parquet(f"{self.path}/parts")

    def total(self, spark: SparkSession) -> int:
        return self.parts(spark).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _opened(self, spark: SparkSession, parts: list) -> DataFrame:
        """The rows of some parts with `_rank`, their place in the whole order."""
        rows = self.rows(spark).filter(F.col("part").isin([p["part"] for p in parts]))
        before = functools.reduce(lambda c, p: c.when(F.col("part") == p["part"], F.lit(p["before"])), parts, F).otherwise(F.lit(None))
        return rows.withColumn("_rank", before + F.col("rank"))

    def _page(self, rows: DataFrame, size: int) -> DataFrame:
        return rows.orderBy("_rank").limit(size).drop("part", "rank", "_rank")

    def range(self, spark: SparkSession, offset: int, count: int) -> DataFrame:
        """Rows from an offset (0 at least), at most LARGEST_PAGE, in order."""
        offset, count = max(0, offset), max(0, min(count, LARGEST_PAGE))
        parts = self.parts(spark).filter((F.col("before") < offset + count) & (F.col("before") + F.col("n") > offset)).select("part", "before").collect()
        if not parts or not count:
            return self._page(self.rows(spark).filter(F.lit(False)).withColumn("_rank", F.col("rank")), 0)
        return self._page(self._opened(spark, parts).filter((F.col("_rank") >= offset) & (F.col("_rank") < offset + count)), count)

    def after(self, spark: SparkSession, last: tuple | None, size: int) -> DataFrame:
        """The `size` rows after the key `last` (from the start if it is None), in order. No row of the key need be there."""
        known = self.parts(spark)
        if last is not None:
            known = known.filter(beyond(self.keys, last, "last."))
        # the first such part may have no more than one row after the key; those behind it are whole
        ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = ahead - F.first("n").over(Window.orderBy("part"))
        parts = known.withColumn("_ahead", ahead).filter(F.col("_ahead") + 1 < size).select("part", "before").collect()
        if not parts or size < 1:
            return self.range(spark, 0, 0)
        rows = self._opened(spark, parts)
        return self._page(rows if last is None else rows.filter(beyond(self.keys, last)), size)


def build(df: DataFrame, keys: list[tuple[str, bool]], path: str, part_rows: int = PART_ROWS) -> PageIndex:
    """Sort df once and store it. Columns called part or rank are not allowed."""
    spark, order = df.sparkSession, _order(tuple(keys))
    n = max(1, -(-df.count() // part_rows))
    at = F.monotonically_increasing_id()
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at)
    numbered = numbered.withColumns({"part": F.shiftright("_at", 33).cast("int"), "rank": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    numbered.write.partitionBy("part").parquet(f"{path}/rows")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    key = F.struct(*(k for k, _ in keys))
    parts = stored.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "rank").alias("first"), F.max_by(key, "rank").alias("last"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", "n", before.alias("before"), "first", "last").write.parquet(f"{path}/parts")  # a row a part
    return PageIndex(path, tuple(keys), schema)
