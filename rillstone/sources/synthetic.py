"""Seeded example data: every value is a function of the row's number, the attribute and the seed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Generator:
    """kind: words (weights by value), sequence, integer or decimal (low, high), date (low, high), boolean (share true),
    pattern ({other} and [unique]), manager (share with one), references (low, high count; targets). filled: share of
    rows with a value. depends: (attribute, value) another attribute must have."""

    kind: str
    values: dict | None = None
    low: object = 0
    high: object = 1
    share: float = 1.0
    pattern: str = ""
    targets: int = 0
    filled: float = 1.0
    depends: tuple[str, object] | None = None


def chance(name: str, seed: int, *more: Column) -> Column:
    """A number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id", *more), F.lit(1 << 52)) / float(1 << 52)


def column(name: str, g: Generator, seed: int, rows: int) -> Column:
    u = chance(name, seed)
    if g.kind == "words":
        total, acc, out = sum(g.values.values()), 0.0, F.lit(None).cast("string")
        pairs = []
        for v, w in g.values.items():
            acc += w / total
            pairs.append((acc, v))
        for edge, v in reversed(pairs):
            out = F.when(u < edge, F.lit(v)).otherwise(out)
        value = F.coalesce(out, F.lit(pairs[-1][1]))
    elif g.kind == "sequence":
        value = F.col("id") + g.low
    elif g.kind == "integer":
        value = (F.floor(u * (g.high - g.low + 1)) + g.low).cast("int")
    elif g.kind == "decimal":
        value = (u * (g.high - g.low) + g.low).cast("decimal(18,2)")
    elif g.kind == "date":
        low, high = F.unix_micros(F.lit(g.low).cast("timestamp")), F.unix_micros(F.lit(g.high).cast("timestamp"))
        value = F.timestamp_micros((low + u * (high - low)).cast("bigint"))
    elif g.kind == "boolean":
        value = u < g.share
    elif g.kind == "pattern":
        parts = re.split(r"(\{\w+\}|\[unique\])", g.pattern)
        value = F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") else F.col("id").cast("string") if p == "[unique]" else F.lit(p) for p in parts if p))
    elif g.kind == "manager":  # someone of a lesser number, so there are no circles
        value = F.when((F.col("id") > 0) & (chance(name + "?", seed) < g.share), F.floor(u * F.col("id")).cast("bigint"))
    elif g.kind == "references":
        n = (F.floor(u * (g.high - g.low + 1)) + g.low).cast("int")
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.floor(chance(name, seed, k) * g.targets).cast("bigint"))
        value = F.when(n > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))
    else:
        raise ValueError(f"no generator {g.kind}")
    if g.filled < 1:
        value = F.when(chance(name + "#", seed) < g.filled, value)
    return value if g.depends is None else F.when(F.col(g.depends[0]) == F.lit(g.depends[1]), value)


def generate(spark: SparkSession, rows: int, generators: dict[str, Generator], seed: int = 1) -> DataFrame:
    """id (from 0) and the attributes in their order; later ones may use earlier ones."""
    df = spark.range(rows)
    for name, g in generators.items():
        df = df.withColumn(name, column(name, g, seed, rows))
    return df
