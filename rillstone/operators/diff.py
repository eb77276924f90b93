"""Typed differences between a snapshot and what is staged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.schema import Attribute, as_text, to_eav


def same(a: Column, b: Column, attribute: Attribute) -> Column:
    """Equal values; lists as sets, no list as the empty one."""
    if not attribute.many:
        return as_text(a, attribute.kind).eqNullSafe(as_text(b, attribute.kind))
    x, y = as_set(a, attribute), as_set(b, attribute)
    return (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)


def as_set(c: Column, attribute: Attribute) -> Column:
    texts = F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: as_text(v, attribute.kind))
    return F.coalesce(F.array_distinct(texts), F.array().cast("array<string>"))


def object_changes(staged: DataFrame, incoming: DataFrame, key: list[str], attributes: list[Attribute], detect_deletes: bool = True) -> DataFrame:
    """key, change (add, update, delete, none) and changed (names), one full outer join.

    An incoming table without rows deletes nothing; detect_deletes is off for partial (delta) imports.
    """
    a = staged.select(*key, F.struct(*(x.name for x in attributes)).alias("was"))
    if detect_deletes:
        a = where_any(a, incoming)
    b = incoming.select(*key, F.struct(*(x.name for x in attributes)).alias("now"))
    both = a.join(b, key, "full" if detect_deletes else "right")
    names = F.array_compact(
        F.array(*(F.when(~same(F.col(f"was.{x.name}"), F.col(f"now.{x.name}"), x), F.lit(x.name)) for x in attributes))
    )
    change = (
        F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.size(names) > 0, "update").otherwise("none")
    )
    none = F.array().cast("array<string>")
    return both.select(*key, change.alias("change"), F.when(change == "update", names).otherwise(none).alias("changed"))


def value_changes(staged: DataFrame, incoming: DataFrame, key: list[str], attributes: list[Attribute]) -> DataFrame:
    """key, attr, value, op (add, remove): only actual differences, value by value.

    Works on exploded values, so a list with very many values is spread over tasks and never compared in one row.
    """
    a = to_eav(staged, key, attributes).withColumn("side", F.lit(1))
    b = to_eav(incoming, key, attributes).withColumn("side", F.lit(2))
    sides = a.union(b).groupBy(*key, "attr", "kind", "value").agg(F.sum("side").alias("side")).filter("side < 3")
    return sides.select(*key, "attr", "kind", "value", F.when(F.col("side") == 1, "remove").otherwise("add").alias("op"))


def applied(value: Column, removes: Column, adds: Column) -> Column:
    """A list after its removes, then its adds."""
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return F.array_union(F.array_except(none(value), none(removes)), none(adds))


def content_hash(attributes: list[Attribute]) -> Column:
    """A digest of an object's content, independent of the order of attributes and values, of repeats and of decimal scale;
    a missing attribute and one without values count the same."""
    parts = []
    for a in sorted(attributes, key=lambda a: a.name):
        c = F.col(a.name) if a.many else F.array(F.col(a.name))
        values = F.array_sort(as_set(c, a))
        parts.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{len(a.name)}:{a.name}{a.kind.name}"), F.to_json(values))).otherwise(""))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def schema_fingerprint(attributes: list[Attribute]) -> str:
    import hashlib

    return hashlib.sha256(repr(sorted((a.name, a.kind.name, a.many) for a in attributes)).encode()).hexdigest()


def unchanged(incoming: DataFrame, stored: DataFrame, key: list[str], attributes: list[Attribute], full: bool = True) -> DataFrame:
    """Incoming rows whose hash and schema fingerprint are stored for a normal object: a full import may skip them."""
    if not full:
        return incoming.limit(0)
    known = stored.filter((F.col("status") == "normal") & (F.col("fingerprint") == schema_fingerprint(attributes)))
    return incoming.withColumn("hash", content_hash(attributes)).join(known.select(*key, "hash"), [*key, "hash"], "left_semi").drop("hash")


def deletions(staged: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Staged keys that a full import of the same scope no longer has; none if it has no rows at all."""
    return where_any(staged.select(*key), incoming).join(incoming.select(*key), key, "left_anti")


def where_any(df: DataFrame, other: DataFrame) -> DataFrame:
    """df if other has a row, else none of it, found out when the plan runs."""
    return df.join(F.broadcast(other.limit(1).select(F.lit(1).alias("_any"))), how="cross").drop("_any")  # one row


def single(values: Column) -> tuple[Column, Column]:
    """(value, conflict) of a list flowing into one value: more than one distinct value is a conflict and flows nothing."""
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(distinct) == 1, distinct[0]), F.coalesce(F.size(distinct) > 1, F.lit(False))


def flattened(versions: DataFrame, by: list[str], json: str) -> DataFrame:
    """by, path, value (JSON): a row for each value of a tree that is no object or list with something in it.

    Trees are read as variants, level by level in one recursive query; a path has the names and places on the way, each
    after a slash. A text that is no JSON has no rows. No tree may be deeper than Spark's limit for levels.
    """
    keys = ", ".join(f"`{k}`" for k in by)
    walk = f"""
        WITH RECURSIVE tree AS (
            SELECT {keys}, '' AS path, v FROM {{trees}}
            UNION ALL
            SELECT {", ".join(f"t.`{k}`" for k in by)}, concat(t.path, '/', coalesce(x.key, cast(x.pos AS string))), x.value
            FROM tree t, LATERAL variant_explode(t.v) x)
        SELECT {keys}, path, to_json(v) AS value FROM tree
        WHERE schema_of_variant(v) NOT LIKE 'OBJECT<_%>' AND (schema_of_variant(v) NOT LIKE 'ARRAY<%' OR to_json(v) = '[]')"""
    trees = versions.select(*by, F.try_parse_json(json).alias("v")).filter("v is not null")
    return versions.sparkSession.sql(walk, trees=trees)


def settings_changes(old: DataFrame, new: DataFrame, by: list[str], json: str) -> DataFrame:
    """by, path, change (added, removed, changed), old, new: how configuration trees differ, one full outer join."""
    a = flattened(old, by, json).withColumnRenamed("value", "old")
    b = flattened(new, by, json).withColumnRenamed("value", "new")
    both = a.join(b, [*by, "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select(*by, "path", change.alias("change"), "old", "new")
