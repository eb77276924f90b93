"""Joins and minima of keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.session import scratch, stored

#: Salts over which the rows of one key are spread.
SALTS = 64


def with_answers(df: DataFrame, keys: list[str], answers: DataFrame, salt_by: Column | str, how: str = "left") -> DataFrame:
    """df joined (left, inner) to answers, which has a row for each key at most.

    An answer goes once to each salt of its key that df has rows of, and they meet there; a hot key is no one task's.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    spread = salted.select(*keys, "_salt").distinct().join(answers, keys)
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "_n", at: str | None = None) -> DataFrame:
    """df with each row's place, from 1, among the rows of its group (of all rows, without one) in an order; a table.

    Rows are dealt by ranges of group and order, so that a large group lies in several tasks: each numbers its own rows,
    and what the group has in the ranges before is added. Rows that are equal by group and order are told apart by a hash of
    the whole row.
    """
    spark, names = df.sparkSession, df.columns
    keys = [*by, *order, "_hash"]
    rows = df.withColumn("_hash", F.xxhash64(*names)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_hash")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), at or scratch(spark), "numbered").withColumn("_range", F.shiftright("_at", 33))
    own = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    runs = rows.groupBy(*own, F.col("_range").alias("_r")).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*(f"_by{i}" for i in range(len(by)))).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))  # a row for each range of a group
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    out = rows.join(runs, [F.col("_range") == F.col("_r"), *same])
    return out.select(*names, (F.col("_at") - F.col("_first") + 1 + F.col("_before")).alias(name))
