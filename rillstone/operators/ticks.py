"""Clock ticks over values stored by day: a tick reads the days of its windows and no others.

Time alone moves an object in or out of scope when a relative date passes one of its values. The values that rules compare
with relative dates are kept in a table by day. A tick gives each such comparison a window (the bound at the last tick to
the bound now); the windows' days are joined to that table, whose scan is pruned to them as the plan runs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.criteria import Group, in_scope, relative_bounds
from rillstone.schema import ObjectType
from rillstone.session import stored

def write_values(objects: DataFrame, t: ObjectType, attributes: list[str], path: str, spread: int = 1) -> None:
    """Store key, attr, value of some date attributes, a folder a day: one shuffle by day. spread: the files of a day, for
    data in which one day may hold more than a task should write."""
    each = F.array(*(F.struct(F.lit(t.attribute(a).name).alias("attr"), F.col(t.attribute(a).name).cast("timestamp").alias("value")) for a in attributes))
    rows = objects.select(F.col(t.key).alias("key"), F.inline(each)).filter("value is not null").withColumn("day", F.to_date("value"))
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "day", F.pmod(F.xxhash64("key"), F.lit(spread))).write.partitionBy("day").parquet(path)


def windows(spark: SparkSession, rules: dict[int, tuple[Group, ...]], t: ObjectType, after: datetime | None, now: datetime, at: str) -> DataFrame:
    """rule, attr, lo, hi: what passed since `after` (ever, without one: lo is null) by each relative comparison; a small table."""
    found = []
    for rule, groups in rules.items():
        for c in relative_bounds(groups):
            lo, hi = (None if x is None else c.value.at(x).replace(tzinfo=None).isoformat() for x in (after, now))
            found.append((rule, t.attribute(c.attribute).name, lo, hi))
    rows = spark.createDataFrame(found, "rule int, attr string, lo string, hi string")
    return stored(rows.select("rule", "attr", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi")), at, "windows")


def candidates(values: DataFrame, passed: DataFrame) -> DataFrame:
    """rule, key: objects with a value in a window (lo, hi] of a rule, once each. values: key, attr, value, day.

    Windows are as many as the rules have relative comparisons; their days prune the scan. Windows without a beginning, those
    of a first tick, take all days.
    """
    some = passed.filter(F.col("lo") < F.col("hi"))
    days = some.select("rule", "attr", "lo", "hi", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day"))
    hit = values.join(F.broadcast(days), ["day", "attr"]).filter((F.col("value") > F.col("lo")) & (F.col("value") <= F.col("hi"))).select("rule", "key")
    first = passed.filter("lo is null")
    if not first.isEmpty():
        hit = hit.union(values.join(F.broadcast(first), "attr").filter(F.col("value") <= F.col("hi")).select("rule", "key"))
    return hit.distinct()


def drifted(objects: DataFrame, t: ObjectType, found: DataFrame, rules: dict[int, tuple[Group, ...]], connected: str, now: datetime) -> DataFrame:
    """rule, key, in_scope of candidates whose scope no longer agrees with whether they are connected (a column).

    Objects are read for the candidates alone."""
    rows = objects.withColumn("key", F.col(t.key)).join(found, "key")
    scope = F.lit(None).cast("boolean")
    for rule, groups in rules.items():
        scope = F.when(F.col("rule") == rule, F.coalesce(in_scope(groups, t, now), F.lit(False))).otherwise(scope)
    rows = rows.withColumn("in_scope", scope)
    return rows.filter(F.col("in_scope") != F.coalesce(connected, F.lit(False))).select("rule", "key", "in_scope")
