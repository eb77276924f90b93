"""Searches, list filters, sorting, pages and projections."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.criteria import Group, in_scope
from rillstone.schema import ObjectType
from rillstone.session import scratch, stored

LARGEST_PAGE = 500
_STRING = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "contains": lambda c, v: c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}
_NUMBER = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def column_named(df: DataFrame, name: str) -> str | None:
    """A column by name without case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def rest_filter(df: DataFrame, text: str | None) -> DataFrame:
    """`property:operator:value`; what can't be understood filters nothing."""
    parts = (text or "").split(":", 2)
    name = column_named(df, parts[0]) if len(parts) == 3 else None
    if name is None:
        return df
    kind, (op, value), c = dict(df.dtypes)[name], parts[1:], F.col(name)
    if kind == "string":
        if _UUID.fullmatch(value) and op in ("eq", "ne"):
            return df.filter(_STRING[op](F.lower(c), value.lower()))
        return df.filter(_STRING[op](c, value)) if op in _STRING else df
    if kind in ("int", "bigint", "smallint", "tinyint"):
        ok = op in _NUMBER and re.fullmatch(r"[+-]?\d{1,18}", value)
        return df.filter(_NUMBER[op](c, int(value))) if ok else df
    if kind == "boolean" and op in ("eq", "ne") and value.lower() in ("true", "false"):
        return df.filter(_NUMBER[op](c, value.lower() == "true"))
    return df


def rest_sort(df: DataFrame, by: str | None, descending: bool = False, tie_break: str | None = None) -> DataFrame:
    """By any property, named without case; an unknown one doesn't sort. Ties go by tie_break."""
    name = column_named(df, by) if by else None
    if name is None:
        return df
    order = [F.col(name).desc() if descending else F.col(name).asc()]
    return df.orderBy(*order, *([F.col(tie_break)] if tie_break else []))


def sort_by_key(df: DataFrame, key: str | None, keys: dict[str, Column], default: str, tie_break: str) -> DataFrame:
    """By one of the allowed keys, or the default; ties by tie_break."""
    return df.orderBy(keys.get((key or "").lower(), keys[default]), F.col(tie_break))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """The number-th page (from 1) of an ordered frame."""
    size = max(1, size)
    return df.offset((max(1, number) - 1) * size).limit(size)


def page_range(df: DataFrame, offset: int, count: int, total: bool = False) -> tuple[DataFrame, int | None]:
    """Rows from an offset (0 at least), at most LARGEST_PAGE, and if asked for the number of all."""
    return df.offset(max(0, offset)).limit(max(0, min(count, LARGEST_PAGE))), df.count() if total else None


def after_key(keys: list[str], last: tuple) -> Column:
    """Rows strictly after `last` in the order of keys, in a form that sources can push down."""
    found = F.lit(False)
    for i, (k, v) in enumerate(zip(keys, last, strict=True)):
        same = functools.reduce(operator.and_, [F.col(a) == F.lit(b) for a, b in zip(keys[:i], last[:i], strict=True)], F.lit(True))
        found = found | (same & (F.col(k) > F.lit(v)))
    return found


def keyset_page(df: DataFrame, keys: list[str], last: tuple | None, size: int) -> DataFrame:
    """The `size` rows after `last` in the order of keys; the keys together are unique."""
    return (df if last is None else df.filter(after_key(keys, last))).orderBy(*keys).limit(size)


def has_attribute(objects: DataFrame, values: DataFrame, key: str, attribute: str) -> DataFrame:
    """Objects with at least one value of an attribute (its name without case) in a long table; none if it is unknown."""
    return objects.join(values.filter(F.lower("attr") == attribute.lower()).select(key), key, "left_semi")


def list_filter(
    df: DataFrame,
    equal: dict[str, list] | None = None,
    between: dict[str, tuple] | None = None,
    text: str | None = None,
    text_columns: list[str] | None = None,
) -> DataFrame:
    """All filters together: a column's list is alternatives, ranges may be open, text is sought in any column without case."""
    for name, values in (equal or {}).items():
        if values:
            df = df.filter(F.col(name).isin(values))
    for name, (low, high) in (between or {}).items():
        if low is not None:
            df = df.filter(F.col(name) >= F.lit(low))
        if high is not None:
            df = df.filter(F.col(name) <= F.lit(high))
    if text and text_columns:
        df = df.filter(functools.reduce(operator.or_, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in text_columns]))
    return df


def pivoted(values: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """A row per object from long rows (attr, value); of several values the least. One shuffle: the columns are given."""
    own = [F.min(F.when(F.lower("attr") == a.lower(), F.col("value"))).alias(a) for a in attributes]
    return values.groupBy(key).agg(*own)


def capped(c: str, n: int) -> list[Column]:
    """The first n values of a list in order, and how many it has."""
    return [F.slice(F.sort_array(c), 1, n).alias(c), F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_total")]


def latest(children: DataFrame, by: list[str], at: str, tie_break: str, columns: list[str]) -> DataFrame:
    """The latest child of each parent, by aggregation: no sort of the children."""
    row = F.max_by(F.struct(*columns), F.struct(at, tie_break))
    return children.groupBy(*by).agg(row.alias("_row")).select(*by, "_row.*")


def ancestors(parents: DataFrame, node: str, parent: str, depth: int | None = 50) -> DataFrame:
    """(node, root): each node's ancestor `depth` steps up, or its topmost one before that; without a depth its topmost one.
    A small table.

    Walked by doubling: for each binary digit of `depth` that is set, on by as many steps from where the walk is. Without a
    depth it doubles until all nodes are at a top; nodes that reach none, because of a cycle, are an error.
    """
    jump = parents.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("root"))
    if depth is None:
        return _topmost(jump)
    at, left = None, depth
    while left:
        if left & 1:
            at = jump if at is None else _further(at, jump)
        left >>= 1
        if left:
            jump = _further(jump, jump)
    return parents.select(F.col(node).alias("node"), F.col(node).alias("root")) if at is None else at


def _further(walk: DataFrame, jump: DataFrame) -> DataFrame:
    far = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return walk.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _topmost(jump: DataFrame) -> DataFrame:
    """Each step is a table of its own, so that plans don't double with the walks."""
    at = scratch(jump.sparkSession)
    jump = stored(jump, at, "jump-0")
    below = jump.filter("node <> root").select(F.col("node").alias("root")).distinct()
    steps, most = 0, jump.count()
    while not jump.join(below, "root", "left_semi").isEmpty():
        if 2**steps > most:
            raise ValueError("the parents have a cycle")
        steps += 1
        jump = stored(_further(jump, jump), at, f"jump-{steps}")
    return jump


@dataclass(frozen=True)
class Search:
    """A stored search: a scope over one object type, output columns in order, and a default sort."""

    name: str
    type: ObjectType
    columns: tuple[str, ...]
    groups: tuple[Group, ...] = ()
    sort: str | None = None
    descending: bool = False

    def run(self, objects: DataFrame, tie_break: str, offset: int = 0, count: int | None = None, now: datetime | None = None) -> DataFrame:
        found = objects.filter(in_scope(self.groups, self.type, now)).select(*dict.fromkeys([*self.columns, tie_break]))
        found = rest_sort(found, self.sort or tie_break, self.descending, tie_break)
        return found if count is None else page_range(found, offset, count)[0]
