"""Prioritised merge of attribute contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a contribution: it has a value, it applies but has none, or it doesn't apply.
WITH_VALUE, NO_VALUE, NOT_APPLICABLE = "value", "none", "na"


def resolve(contributions: DataFrame, key: list[str], all_keys: DataFrame | None = None) -> DataFrame:
    """key, outcome (value, asserted_null, no_contributor), value, rule and mapping_id.

    contributions: key, state, value, rule, priority, mapping_id, null_is_value. The eligible contribution with the
    least priority wins, ties by mapping id: one that has a value, or has none and asserts null. Map-side combined,
    so a key with very many contributions costs one row a task. all_keys adds keys without any contribution.
    """
    eligible = (F.col("state") == WITH_VALUE) | ((F.col("state") == NO_VALUE) & F.coalesce("null_is_value", F.lit(False)))
    row = F.struct("state", "value", "rule", "mapping_id")
    best = contributions.groupBy(*key).agg(F.min_by(F.when(eligible, row), F.when(eligible, F.struct("priority", "mapping_id"))).alias("w"))
    if all_keys is not None:
        best = all_keys.select(*key).join(best, key, "left")
    outcome = F.when(F.col("w").isNull(), "no_contributor").when(F.col("w.state") == WITH_VALUE, "value").otherwise("asserted_null")
    return best.select(
        *key, outcome.alias("outcome"), F.when(outcome == "value", F.col("w.value")).alias("value"), F.col("w.rule").alias("rule"), F.col("w.mapping_id").alias("mapping_id")
    )


def contributes(value: Column, applies: Column | None = None) -> Column:
    """The state of a contribution from its value and whether its rule applies to the object."""
    state = F.when(value.isNotNull(), WITH_VALUE).otherwise(NO_VALUE)
    return state if applies is None else F.when(F.coalesce(applies, F.lit(False)), state).otherwise(NOT_APPLICABLE)


def takes_over(newcomer_priority: Column, newcomer_mapping: Column, owner_priority: Column, owner_mapping: Column) -> Column:
    """Whether a newcomer beats the present owner, without looking at other contributors."""
    new = F.struct(newcomer_priority.alias("p"), newcomer_mapping.alias("m"))
    own = F.struct(owner_priority.alias("p"), owner_mapping.alias("m"))
    return owner_priority.isNull() | (new <= own)


def reelect(contributions: DataFrame, leaving: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The winners once some contributors (rows of `by`) have left; keys left without any have no contributor."""
    return resolve(contributions.join(leaving, by, "left_anti"), key, contributions.select(*key).distinct())


def provenance_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, value_changed, owner_changed: an owner may change though the value doesn't, and only values are exported."""
    a = before.select(*key, F.col("value").alias("v0"), F.col("rule").alias("r0"))
    b = after.select(*key, F.col("value").alias("v1"), F.col("rule").alias("r1"))
    both = a.join(b, key, "full")
    out = both.select(*key, (~F.col("v0").eqNullSafe(F.col("v1"))).alias("value_changed"), (~F.col("r0").eqNullSafe(F.col("r1"))).alias("owner_changed"))
    return out.filter("value_changed or owner_changed")


def contributor_counts(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("type", "attr").agg(F.count_distinct("mapping_id").alias("contributors"))
