"""Matching: external ids, rule cascades, references and containers."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.skew import with_answers
from rillstone.schema import Kind, canonical

#: Kinds that rules may match on.
MATCHABLE = (Kind.TEXT, Kind.NUMBER, Kind.LONG, Kind.DECIMAL, Kind.GUID)


@dataclass(frozen=True)
class MatchRule:
    """source (a column of staged rows, or an expression's column) equals target (a column of canonical rows).

    Of several sources the first that hits anything counts. A list, on either side, hits by any of its values.
    """

    order: int
    source: str | tuple[str, ...]
    target: str
    kind: Kind = Kind.TEXT
    case_sensitive: bool = False

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,) if isinstance(self.source, str) else self.source

    @property
    def space(self) -> str:
        """Names what keys are comparable: of one target, compared in one way."""
        return f"{self.target.lower()}|{self.kind.name}|{self.case_sensitive}"

    def key(self, c: Column) -> Column:
        if self.kind not in MATCHABLE:
            raise ValueError(f"rules don't match {self.kind.name}")
        c = canonical(c, self.kind)
        return F.lower(c) if self.kind is Kind.TEXT and not self.case_sensitive else c

    def keyed(self, rows: DataFrame, column: str, *keep: str | Column) -> DataFrame:
        """keep and _k, the column's key as text: a row for each distinct value of a list, none where there is no value."""
        if dict(rows.dtypes)[column].startswith("array"):
            key = F.explode(F.array_distinct(F.transform(column, lambda v: self.key(v).cast("string"))))
        else:
            key = self.key(F.col(column)).cast("string")
        return rows.select(*keep, key.alias("_k")).filter("_k is not null")


def reject_duplicates(incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unique rows, rejected rows): a key that occurs twice in a batch has no winner, all its rows are rejected.

    Counted by aggregation, so a key with very many rows is no one task's burden.
    """
    twice = incoming.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key)
    return incoming.join(twice, key, "left_anti"), incoming.join(twice, key, "left_semi")


def import_match(incoming: DataFrame, staged: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows with `staged_id` of the staged row of the same system, type and external id, null if there is none."""
    return incoming.join(staged.select(*key, F.col("id").alias("staged_id")), key, "left")


def match_cascade(staged: DataFrame, canonical_rows: DataFrame, rules: list[MatchRule], source_id: str, target_id: str, stop_at_ambiguity: bool = True) -> DataFrame:
    """source_id, outcome (joined, ambiguous, none), rule and target_id of every staged row.

    Rules are tried in their order: the first with one target joins. One with several targets stops the cascade for
    that row, or with stop_at_ambiguity off is passed over. All rules are one union of hash joins and one aggregation.
    """
    if not rules:
        none = F.lit(None)
        return staged.select(source_id, F.lit("none").alias("outcome"), none.cast("int").alias("rule"), none.cast("long").alias(target_id))
    hits = []
    for r in rules:
        # per key the least and greatest target: no product of equal keys
        b = r.keyed(canonical_rows, r.target, F.col(target_id).alias("_t")).groupBy("_k").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        for n, source in enumerate(r.sources):
            a = r.keyed(staged, source, source_id)
            hits.append(a.join(b, "_k").select(source_id, F.lit(r.order).alias("rule"), F.lit(n).alias("_n"), "_lo", "_hi"))
    found = functools.reduce(DataFrame.union, hits).groupBy(source_id, "rule", "_n").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    if not stop_at_ambiguity:
        found = found.filter("_lo = _hi")
    first = found.groupBy(source_id).agg(F.min_by(F.struct("rule", "_lo", "_hi"), F.struct("rule", "_n")).alias("_f"))
    out = staged.select(source_id).join(first, source_id, "left")
    outcome = F.when(F.col("_f").isNull(), "none").when(F.col("_f._lo") != F.col("_f._hi"), "ambiguous").otherwise("joined")
    return out.select(source_id, outcome.alias("outcome"), F.col("_f.rule").alias("rule"), F.when(outcome == "joined", F.col("_f._lo")).alias(target_id))


def claim_once(matches: DataFrame, existing: DataFrame, disconnecting: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """`outcome` already_joined for rows whose target has a row of the same system, or that a lesser row has claimed.

    Existing joins that this run takes apart don't count. A target's claimants meet by their least only, so a target that
    very many claim is no one task's.
    """
    held = existing.join(disconnecting, source_id, "left_anti").select(target_id).distinct().withColumn("_held", F.lit(True))
    joined = matches.filter("outcome = 'joined'")
    claims = joined.groupBy(target_id).agg(F.min(source_id).alias("_first")).join(held, target_id, "left")
    late = (F.col(source_id) > F.col("_first")) | F.coalesce("_held", F.lit(False))
    joined = with_answers(joined, [target_id], claims, source_id).withColumn("outcome", F.when(late, "already_joined").otherwise("joined"))
    return joined.select(*matches.columns).union(matches.filter("outcome <> 'joined'").select(*matches.columns))


def resolve_references(rows: DataFrame, objects: DataFrame, key: str, reference: str, target_type: str | None = None) -> DataFrame:
    """key, raw, state (resolved, unresolved, ambiguous) and object_id for each raw value of a reference column.

    objects: type, external_id, id. An attribute that declares its target's type looks only there; otherwise a value
    that objects of several types have is ambiguous. Values are case-sensitive.
    """
    many = dict(rows.dtypes)[reference].startswith("array")
    raw = F.explode(F.array_distinct(reference)) if many else F.col(reference)
    refs = rows.select(key, raw.alias("raw")).filter("raw is not null")
    known = objects if target_type is None else objects.filter(F.col("type") == target_type)
    known = known.groupBy(F.col("external_id").alias("raw")).agg(F.count("*").alias("_n"), F.min("id").alias("object_id"))
    state = F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return refs.join(known, "raw", "left").select(key, "raw", state.alias("state"), F.when(F.col("_n") == 1, F.col("object_id")).alias("object_id"))


def reference_report(resolved: DataFrame, handling: str) -> DataFrame:
    """What isn't resolved, as the handling says: rows of level error or warning, or nothing."""
    level = {"error": "error", "warn": "warning", "ignore": None}[handling]
    bad = resolved.filter("state <> 'resolved'")
    return bad.withColumn("level", F.lit(level)) if level else bad.withColumn("level", F.lit("")).limit(0)


def to_canonical(resolved: DataFrame, joins: DataFrame) -> DataFrame:
    """References to staged objects as references to the canonical objects they are joined to; after all joins are made."""
    return resolved.join(joins.select(F.col("id").alias("object_id"), "target_id"), "object_id", "left")


def referencing(deleted: DataFrame, values: DataFrame, target_values: DataFrame) -> DataFrame:
    """owner, attr, ref, held: who refers to deleted objects, and whether the target still holds the value."""
    owners = values.join(deleted.select(F.col("id").alias("ref")), "ref", "left_semi")
    held = target_values.select("owner", "attr", "ref").distinct().withColumn("held", F.lit(True))
    return owners.join(held, ["owner", "attr", "ref"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def container_scope(objects: DataFrame, rules: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """objects with in_scope and container. rules: path, include (bool), subtree (bool).

    A path's ancestors are exploded and joined by equality; the most specific rule wins, an exclusion before an
    inclusion of the same container. Objects under no rule are out of scope.
    """
    parts = F.split(F.col(path), F.lit("\\Q" + separator + "\\E"))
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), separator).alias("container")))
    each = objects.withColumn("_id", F.monotonically_increasing_id())
    up = each.select("_id", F.size(parts).alias("_own"), F.inline(steps))
    r = rules.select(F.col("path").alias("container"), "include", "subtree")
    hit = up.join(r, "container").filter(F.col("subtree") | (F.col("depth") >= F.col("_own") - 1))
    best = hit.groupBy("_id").agg(F.max_by(F.struct("include", "container"), F.struct("depth", ~F.col("include"))).alias("_r"))
    out = each.join(best, "_id", "left").drop("_id")
    return out.withColumn("in_scope", F.coalesce("_r.include", F.lit(False))).withColumn("container", F.col("_r.container")).drop("_r")


def discarded(scoped: DataFrame) -> DataFrame:
    """How many objects each excluded container discards."""
    return scoped.filter("not in_scope").groupBy("container").agg(F.count("*").alias("n"))
