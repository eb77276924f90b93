"""Attribute types, object types and their canonical Spark columns.

An object is a wide row: one column per attribute, an array where the attribute has many values. The long form,
a row per attribute value, is derived where an operator is the same for every attribute.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    """The nine attribute types and their Spark types."""

    TEXT = "string"
    NUMBER = "int"
    LONG = "bigint"
    DECIMAL = "decimal(38,10)"
    DATETIME = "timestamp"
    BOOLEAN = "boolean"
    GUID = "guid"
    BINARY = "binary"
    REFERENCE = "reference"

    @property
    def spark(self) -> str:
        return "string" if self in (Kind.GUID, Kind.REFERENCE) else self.value


class Write(Enum):
    ALWAYS = "always"
    NEVER = "never"
    ON_CREATE = "on create"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: Kind = Kind.TEXT
    many: bool = False
    write: Write = Write.ALWAYS
    target_type: str | None = None  # the object type that a reference names, if it names one
    selected: bool = True


@dataclass(frozen=True)
class ObjectType:
    """Attributes by name; names compare without case. `key` is the external id, `second_key` one known only after export."""

    name: str
    attributes: tuple[Attribute, ...]
    key: str
    second_key: str | None = None
    by_name: dict = field(init=False, repr=False, compare=False, hash=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "by_name", {a.name.lower(): a for a in self.attributes})

    def attribute(self, name: str) -> Attribute:
        try:
            return self.by_name[name.lower()]
        except KeyError:
            raise ValueError(f"{self.name} has no attribute {name}") from None


GUID_PATTERN = r"^\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}?$"


def parsed(text: Column, kind: Kind) -> Column:
    """Text to a kind's canonical value; null if it isn't one. Decimals may have exponents, booleans any case."""
    t = F.trim(text)
    if kind in (Kind.TEXT, Kind.REFERENCE):
        return text
    if kind is Kind.GUID:
        return F.when(t.rlike(GUID_PATTERN), F.lower(F.regexp_replace(t, r"[{}]", "")))
    if kind is Kind.BOOLEAN:
        return F.when(F.lower(t) == "true", True).when(F.lower(t) == "false", False)
    if kind is Kind.BINARY:
        return F.try_to_binary(t, F.lit("base64"))
    if kind is Kind.DATETIME:
        return F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?"), t.try_cast("timestamp"))
    if kind in (Kind.NUMBER, Kind.LONG):
        return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast(kind.spark))
    return t.try_cast(kind.spark)


def canonical(c: Column, kind: Kind) -> Column:
    """A typed column as values of a kind compare: decimals at one scale, ids in lower case. Too large a decimal is an error."""
    if kind is Kind.GUID:
        return F.lower(c.cast("string"))
    return c.cast(kind.spark)


def as_text(c: Column, kind: Kind) -> Column:
    """One text per value; equal values have equal texts (5.0 and 5.00; the scale doesn't count)."""
    if kind is Kind.DECIMAL:
        plain = c.cast("decimal(38,10)").cast("string")
        return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    if kind is Kind.BINARY:
        return F.base64(c)
    if kind is Kind.DATETIME:
        return F.unix_micros(c).cast("string")
    if kind is Kind.GUID:
        return F.lower(c)
    return c.cast("string")


def from_text(c: Column, kind: Kind) -> Column:
    """The inverse of as_text."""
    if kind is Kind.DATETIME:
        return F.timestamp_micros(c.cast("bigint"))
    return F.unbase64(c) if kind is Kind.BINARY else c.cast(kind.spark)


def each_value(values: Column, fn: Callable[[Column, Kind], Column], kind: Kind) -> Column:
    """fn of each value of a list. (Spark would take a second parameter of a lambda as the value's place.)"""
    return F.transform(values, lambda v: fn(v, kind))


def to_eav(df: DataFrame, key: list[str], attributes: list[Attribute]) -> DataFrame:
    """key, attr, kind, value (text): a row per value, none for a missing one. One pass over df, no shuffle."""
    rows = []
    for a in attributes:
        c = F.col(a.name) if a.many else F.array(F.col(a.name))
        texts = F.array_distinct(each_value(F.filter(c, lambda v: v.isNotNull()), as_text, a.kind))
        rows.append(F.struct(F.lit(a.name).alias("attr"), F.lit(a.kind.name).alias("kind"), F.coalesce(texts, F.array().cast("array<string>")).alias("values")))
    each = df.select(*key, F.inline(F.array(*rows)))
    return each.select(*key, "attr", "kind", F.explode("values").alias("value"))


def from_eav(eav: DataFrame, key: list[str], attributes: list[Attribute]) -> DataFrame:
    """The wide form; many-valued attributes sorted. The values to pivot on are given, so this is one shuffle."""
    cols = []
    for a in attributes:
        own = F.when(F.col("attr") == a.name, F.col("value"))
        value = F.sort_array(each_value(F.collect_set(own), from_text, a.kind)) if a.many else from_text(F.min(own), a.kind)
        cols.append(value.alias(a.name))
    return eav.groupBy(*key).agg(*cols)


def spark_schema(t: ObjectType) -> T.StructType:
    inner = ", ".join(f"`{a.name}` {'array<' + a.kind.spark + '>' if a.many else a.kind.spark}" for a in t.attributes)
    return T.StructType.fromDDL(inner)
