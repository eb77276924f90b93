"""Relational sources: parallel scans, watermarks, related tables and change logs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.query import keyset_page
from rillstone.sources.files import Capabilities


#: What a database can do: it reads by pages and partitions, has watermarks and change logs, and makes keys.
DATABASE = Capabilities(delta_import=True, export=True, partitions=True, paging=True, parallel_export=True, generated_keys=True, watermark=True, change_log=True)


def scan(
    spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, capabilities: Capabilities = DATABASE, **options: str
) -> DataFrame:
    """A table, view or `(statement) alias` over JDBC, read in parallel ranges of a numeric key; filters and columns are
    pushed down. Without bounds they are asked for: the least and the greatest key."""
    capabilities.check("full import")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        capabilities.check("import by partition")
        if bounds is None:
            quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
            statement = f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}) bounds_of"
            r = spark.read.format("jdbc").options(url=url, dbtable=statement, **options).load().first()
            bounds = (r[0], r[1])
        if bounds[0] is not None:  # a table without rows has no bounds
            reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1] + 1, numPartitions=partitions)
    return reader.load()


def scan_since(spark: SparkSession, url: str, table: str, column: str, mark: object | None, key: str | None = None, capabilities: Capabilities = DATABASE, **options: str) -> DataFrame:
    """The rows above a mark; the database filters them. All without one."""
    if mark is not None:
        capabilities.check("delta import by watermark")
    return changed_since(scan(spark, url, table, key, capabilities=capabilities, **options), column, mark)


def scan_page(spark: SparkSession, url: str, table: str, keys: list[str], last: tuple | None, size: int, capabilities: Capabilities = DATABASE, **options: str) -> DataFrame:
    """The `size` rows after `last` in the order of keys: filter, order and limit go to the database."""
    capabilities.check("paged import")
    return keyset_page(scan(spark, url, table, capabilities=capabilities, **options), keys, last, size)


#: Types that order, by the name they are stored under.
_ORDERED = {"int": int, "long": int, "decimal": Decimal, "timestamp": datetime.fromisoformat, "string": str, "binary": bytes.fromhex}


def watermark_text(value: object) -> tuple[str, str]:
    """(text, type) of a watermark value; a ValueError for values without an order."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} can't be a watermark")
    if isinstance(value, int):
        return str(value), "long"
    if isinstance(value, Decimal):
        return str(value), "decimal"
    if isinstance(value, datetime):
        return value.isoformat(), "timestamp"
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex(), "binary"
    if isinstance(value, str):
        return value, "string"
    raise ValueError(f"a {type(value).__name__} can't be a watermark")


def watermark_value(text: str, kind: str) -> object:
    if kind not in _ORDERED:
        raise ValueError(f"{kind} has no order")
    return _ORDERED[kind](text)


@dataclass
class Watermarks:
    """Where each table, and each related table, was read up to, in one mode (column or log), for one source identity."""

    mode: str
    own: dict[str, tuple[str, str]] = field(default_factory=dict)
    related: dict[str, tuple[str, str]] = field(default_factory=dict)
    identity: str | None = None

    def dumps(self) -> str:
        return json.dumps({"mode": self.mode, "own": self.own, "related": self.related, "identity": self.identity}, sort_keys=True)

    @classmethod
    def loads(cls, text: str | None, mode: str, identity: str | None = None) -> Watermarks | None:
        """None, that is a new baseline, for text that can't be read, of another mode or of another source's identity."""
        try:
            d = json.loads(text)
            found = cls(d["mode"], {k: tuple(v) for k, v in d["own"].items()}, {k: tuple(v) for k, v in d["related"].items()}, d.get("identity"))
        except (TypeError, ValueError, KeyError, AttributeError):
            return None
        return found if found.mode == mode and found.identity == identity else None


def changed_since(df: DataFrame, column: str, mark: object | None, overlap_seconds: int = 0) -> DataFrame:
    """Rows above the mark; all without one. An overlap reads again what may have come late."""
    if mark is None:
        return df
    c = F.col(column)
    if overlap_seconds:
        return df.filter(F.unix_micros(c) > F.unix_micros(F.lit(mark).cast("timestamp")) - overlap_seconds * 1_000_000)
    return df.filter(c > F.lit(mark))


def changed_with_related(parents: DataFrame, key: str, own: tuple[str, object | None], related: list[tuple[DataFrame, str, str, object | None]]) -> DataFrame:
    """Parents above their own mark, or with a changed row in a related table (frame, foreign key, change column, mark).

    A related table without a mark brings every parent that has a row there.
    """
    if own[1] is None:
        return parents
    keys = changed_since(parents, *own).select(key)
    for child, foreign, column, mark in related:
        keys = keys.union(changed_since(child, column, mark).select(F.col(foreign).alias(key)))
    return parents.join(keys, key, "left_semi")


def change_log(log: DataFrame, current: DataFrame, key: str, sequence: str, kind: str, mark: object | None) -> DataFrame:
    """key, change (upsert, delete) and current's columns for keys in the log above the mark: each key's last state.

    A created or updated key whose row has gone since gives nothing.
    """
    last = changed_since(log, sequence, mark).groupBy(key).agg(F.max_by(kind, sequence).alias("_k"))
    rows = last.join(current, key, "left")
    present = F.lit(False)
    for c in current.columns:
        if c != key:
            present = present | F.col(c).isNotNull()
    there = last.filter("_k <> 'D'").join(current.select(key), key, "left_semi").select(key, F.lit(True).alias("_there"))
    rows = rows.join(there, key, "left").filter("_k = 'D' or _there")
    out = [F.when(F.col("_k") != "D", F.col(c)).alias(c) for c in current.columns if c != key]
    return rows.select(key, F.when(F.col("_k") == "D", "delete").otherwise("upsert").alias("change"), *out)
