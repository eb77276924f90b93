"""A whole reconciliation run as one plan: import differences, scope, match, project, merge, and outbound changes."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.expressions import attributes_of, coerced, compile_expression, with_missing_inputs
from rillstone.functions.scalars import process_text
from rillstone.operators import merge
from rillstone.operators.criteria import Group, in_scope
from rillstone.operators.diff import object_changes, where_any
from rillstone.operators.lifecycle import deletion_decision, deletion_timing
from rillstone.operators.match import MatchRule, claim_once, resolve_references
from rillstone.operators.outbound import ExportMapping, outbound_delta
from rillstone.operators.run_match import gives, known_keys, new_ids, run_matches, seeks
from rillstone.operators.skew import with_answers
from rillstone.schema import Attribute, Kind, ObjectType
from rillstone.session import scratch, stored


@dataclass(frozen=True)
class Flow:
    """An attribute flow into the canonical object: a source column, or an expression over `cs`, with text processing."""

    id: int
    target: str
    source: str | None = None
    expression: str | None = None
    priority: int = 1
    null_is_value: bool = False
    enabled: bool = True
    missing: str = "evaluate"
    text: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ImportRule:
    """What one system's objects of one type are in scope for, how they match, and what flows from them."""

    id: int
    type: ObjectType
    flows: tuple[Flow, ...]
    matching: tuple[MatchRule, ...] = ()
    scope: tuple[Group, ...] = ()
    project: bool = True
    out_of_scope: str = "disconnect"


def flow_value(f: Flow, t: ObjectType, target: Attribute) -> tuple[Column, Column]:
    """(value, error) of a flow for a staged row."""
    if f.expression is None:
        value, error = F.col(f.source), F.lit(None).cast("string")
    else:
        kinds = attributes_of({a.name: a.kind for a in t.attributes}, frozenset(a.name for a in t.attributes if a.many))
        x = compile_expression(f.expression, cs=kinds)
        x.column, error = with_missing_inputs(x, {}, kinds, "cs", f.missing)
        value, bad = coerced(x, target.kind)
        error = F.coalesce(error, bad)
    if f.text:
        value = process_text(value, **f.text)
    return value, error


def contributions(joined: DataFrame, rule: ImportRule, canonical_type: ObjectType) -> DataFrame:
    """entity, attr, state, value (text), rule, priority, mapping_id, null_is_value, error: a row per object and flow."""
    rows = []
    for f in rule.flows:
        if f.enabled:
            value, error = flow_value(f, rule.type, canonical_type.attribute(f.target))
            text = F.when(error.isNull(), value.cast("string"))
            state = F.when(error.isNotNull(), merge.NOT_APPLICABLE).otherwise(merge.contributes(text))
            rows.append(
                F.struct(
                    F.lit(f.target).alias("attr"), state.alias("state"), text.alias("value"), F.lit(rule.id).alias("rule"),
                    F.lit(f.priority).alias("priority"), F.lit(f.id).alias("mapping_id"), F.lit(f.null_is_value).alias("null_is_value"), error.alias("error"),
                )
            )
    return joined.select("entity", F.inline(F.array(*rows)))


@dataclass
class Run:
    """What a run finds; all frames are plans over its inputs.

    changes: rule, external_id, change, changed. outcomes: rule, external_id, outcome (kept, joined, ambiguous,
    already_joined, none), entity. disconnected: rule, external_id, entity, reason (deleted, out_of_scope). joins: rule,
    external_id, entity after the run. merged: what the joined objects give each entity. references: rule, external_id,
    attr, raw, state, entity. deletions: entity, remaining, decision, timing of entities that lost a connector.
    """

    changes: DataFrame
    outcomes: DataFrame
    merged: DataFrame
    errors: DataFrame
    disconnected: DataFrame
    joins: DataFrame
    references: DataFrame
    deletions: DataFrame


def full_run(
    staged: dict[int, DataFrame],
    incoming: dict[int, DataFrame],
    canonical_rows: DataFrame,
    rules: list[ImportRule],
    canonical_type: ObjectType,
    now: datetime,
    joins: DataFrame | None = None,
    lifetimes: DataFrame | None = None,
) -> Run:
    """staged and incoming by rule; canonical rows have `entity` and the attributes rules match on; joins (rule,
    external_id, entity) are those made before; lifetimes (entity, origin, rule, grace_days) say what may be deleted.

    First, joined objects that left or fell out of scope are disconnected (by an import with rows only), unless the rule
    lets those out of scope remain. Objects that stay keep their join and aren't matched again. All others are matched in
    the order of rules and external ids, with the entities from before and with those that earlier objects project: an
    entity is found by the values it had before the run, or by those its projecting object gives it. An entity that is held
    by another object of the same rule can't be joined, one released in this run can. New objects that match nothing are
    projected under an id of their own, from their rule and external id. Outcomes are written to the shared folder once.
    Once all joins are made, references are resolved to the objects' entities, and entities that lost a connector get their
    deletion decision.
    """
    spark, at = canonical_rows.sparkSession, scratch(canonical_rows.sparkSession)
    first = joins is None
    if first:
        joins = spark.createDataFrame([], "rule int, external_id string, entity long")
    every = [m for r in rules for m in r.matching]
    changes, left, kept, new, scoped = [], [], [], {}, {}
    for r in rules:
        key = r.type.key
        name = F.col(key).cast("string").alias("external_id")
        changes.append(object_changes(staged[r.id], incoming[r.id], [key], list(r.type.attributes)).select(F.lit(r.id).alias("rule"), name, "change", "changed"))
        scoped[r.id] = incoming[r.id].filter(in_scope(r.scope, r.type, now))
        mine = joins.filter(F.col("rule") == r.id).select("external_id", "entity")
        present = incoming[r.id].select(name, F.coalesce(in_scope(r.scope, r.type, now), F.lit(False)).alias("_in"))
        state = mine.join(present, "external_id", "left")
        reason = F.when(F.col("_in").isNull(), "deleted").when(~F.col("_in") & (F.lit(r.out_of_scope) == "disconnect"), "out_of_scope")
        gone = where_any(state.select("external_id", "entity", reason.alias("reason")).filter("reason is not null"), incoming[r.id])
        left.append(gone.select(F.lit(r.id).alias("rule"), "external_id", "entity", "reason"))
        held = mine.join(gone.select("external_id"), "external_id", "left_anti")
        kept.append(held.select(F.lit(r.id).alias("rule"), "external_id", "entity"))
        new[r.id] = scoped[r.id].withColumn("_name", name).join(held.select(F.col("external_id").alias("_name")), "_name", "left_anti")
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    lost, kept_all = union(left), joins if first else stored(union(kept), at, "kept")
    found = _matched(new, rules, every, canonical_rows, canonical_type, kept_all, at)
    names = union([scoped[r.id].select(F.lit(r.id).alias("rule"), F.col(r.type.key).cast("string").alias("external_id")) for r in rules])
    known = names.join(kept_all, ["rule", "external_id"]).select("rule", "external_id", F.lit("kept").alias("outcome"), "entity")
    outcomes = stored(known.unionByName(found), at, "outcomes")
    after = kept_all.unionByName(outcomes.filter("outcome <> 'kept' and entity is not null").select("rule", "external_id", "entity"))
    given = []
    for r in rules:
        own = outcomes.filter((F.col("rule") == r.id) & F.col("entity").isNotNull()).select(F.col("external_id").alias("_name"), "entity")
        given.append(contributions(scoped[r.id].withColumn("_name", F.col(r.type.key).cast("string")).join(own, "_name").drop("_name"), r, canonical_type))
    all_given = union(given)
    merged = merge.resolve(all_given, ["entity", "attr"])
    errors = all_given.filter("error is not null").select("entity", "attr", "error")
    return Run(union(changes), outcomes, merged, errors, lost, after, references(incoming, rules, after), deletions(lost, after, lifetimes))


def _place(n: int, r: ImportRule) -> Column:
    """Orders the objects of a run: by rule, then external id, whole numbers by value."""
    number = F.col(r.type.key).cast("decimal(38,0)") if r.type.attribute(r.type.key).kind in (Kind.NUMBER, Kind.LONG) else F.lit(None).cast("decimal(38,0)")
    return F.struct(F.lit(n).alias("n"), number.alias("number"), F.col("_name").alias("name"))


def _given_values(rows: DataFrame, r: ImportRule, t: ObjectType, targets: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """rows with a column for each target that flows give a value, by priority and then id; and the columns' names."""
    columns: dict[str, list[Column]] = {}
    for f in sorted(r.flows, key=lambda f: (f.priority, f.id)):
        if f.enabled and f.target in targets:
            value, error = flow_value(f, r.type, t.attribute(f.target))
            columns.setdefault(f.target, []).append(F.when(error.isNull(), value))
    names = {target: f"_to_{n}" for n, target in enumerate(columns)}
    return rows.withColumns({names[target]: F.coalesce(*values) for target, values in columns.items()}), names


def _matched(new: dict[int, DataFrame], rules: list[ImportRule], every: list[MatchRule], canonical_rows: DataFrame, t: ObjectType, held: DataFrame, at: str) -> DataFrame:
    """rule, external_id, outcome, entity of new objects."""
    objects, looks, offers = [], [], []
    for n, r in enumerate(rules):
        place = _place(n, r)
        objects.append(new[r.id].select(place.alias("ord"), F.lit(r.id).alias("rule"), F.col("_name").alias("external_id"), F.lit(r.project).alias("projects")))
        if r.matching:
            looks.append(seeks(new[r.id], list(r.matching), place))
        if r.project and every:
            rows, names = _given_values(new[r.id], r, t, {m.target for m in every})
            if (offer := gives(rows, every, names, place)) is not None:
                offers.append(offer)
    union = functools.partial(functools.reduce, DataFrame.union)
    whole = stored(union(objects), at, "objects")
    if looks:
        seek, give = union(looks), None
        if offers:  # they meet several times
            seek, give = stored(seek, at, "seeks"), stored(union(offers), at, "gives")
        found = run_matches(whole, seek, give, known_keys(canonical_rows, every, "entity"), at)
    else:
        none = F.lit(None)
        found = whole.select("ord", F.lit("none").alias("outcome"), none.cast("int").alias("rule"), none.cast("long").alias("entity"), F.when(F.col("projects"), F.col("ord")).alias("via"))
    found = stored(found.select("ord", "outcome", "entity", "via").join(whole.select("ord", "rule", "external_id"), "ord"), at, "found")
    made = found.filter("outcome = 'none' and via is not null").select("rule", "external_id", "ord")
    made = new_ids(made, ["rule", "external_id"], canonical_rows, f"{at}/ids").select(F.col("ord").alias("via"), F.col("entity").alias("_made"))
    found = with_answers(found, ["via"], made, "ord").withColumn("entity", F.coalesce("_made", "entity")).withColumn("_target", F.struct("rule", "entity"))
    nobody = F.lit(None).cast(whole.schema["ord"].dataType)
    held = held.select(nobody.alias("ord"), F.struct("rule", "entity").alias("_target"))
    owners = found.filter("outcome = 'none' and entity is not null").select("ord", "_target")
    found = claim_once(found, held.union(owners), held.limit(0), "ord", "_target")
    entity = F.when(F.col("outcome").isin("joined", "none"), F.col("entity"))
    return found.select("rule", "external_id", "outcome", entity.alias("entity"))


def references(incoming: dict[int, DataFrame], rules: list[ImportRule], joins: DataFrame) -> DataFrame:
    """The second pass: reference values of all rules' objects as entities, now that all joins are made."""
    objects = joins.select(F.col("rule").cast("string").alias("type"), "external_id", F.col("entity").alias("id"))
    found = []
    for r in rules:
        for a in r.type.attributes:
            if a.kind is Kind.REFERENCE:
                rows = resolve_references(incoming[r.id].select(F.col(r.type.key).cast("string").alias("external_id"), a.name), objects, "external_id", a.name, str(r.id))
                found.append(rows.select(F.lit(r.id).alias("rule"), "external_id", F.lit(a.name).alias("attr"), "raw", "state", F.col("object_id").alias("entity")))
    none = joins.sparkSession.createDataFrame([], "rule int, external_id string, attr string, raw string, state string, entity long")
    return functools.reduce(DataFrame.unionByName, found) if found else none


def deletions(lost: DataFrame, joins: DataFrame, lifetimes: DataFrame | None) -> DataFrame:
    """entity, remaining, decision, timing: what becomes of entities that lost a connector. Without lifetimes all are kept."""
    remaining = joins.groupBy("entity").agg(F.count("*").alias("remaining"))
    rows = lost.select("entity").distinct().join(remaining, "entity", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    if lifetimes is None:
        return rows.select("entity", "remaining", F.lit("keep").alias("decision"), F.lit("none").alias("timing"))
    rows = rows.join(lifetimes.select("entity", "origin", F.col("rule").alias("_rule"), "grace_days"), "entity", "left")
    decision = deletion_decision(F.col("origin"), F.col("_rule"), F.col("remaining"))
    return rows.select("entity", "remaining", decision.alias("decision"), deletion_timing(decision, F.col("grace_days")).alias("timing"))


def wide(merged: DataFrame, t: ObjectType) -> DataFrame:
    """The merged values as one row per entity, with their types."""
    own = [F.max(F.when(F.col("attr") == a.name, F.col("value"))).try_cast(a.kind.spark).alias(a.name) for a in t.attributes]
    return merged.filter("outcome = 'value'").groupBy("entity").agg(*own)


def outbound(merged: DataFrame, target: DataFrame, t: ObjectType, mappings: list[ExportMapping]) -> DataFrame:
    return outbound_delta(wide(merged, t), target, "entity", mappings)


def preview(before: Run, after: Run) -> DataFrame:
    """entity, attr, old, new of everything that another set of rules would change; nothing is written."""
    a = before.merged.select("entity", "attr", F.col("value").alias("old"), F.col("outcome").alias("o0"))
    b = after.merged.select("entity", "attr", F.col("value").alias("new"), F.col("outcome").alias("o1"))
    both = a.join(b, ["entity", "attr"], "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")) | ~F.col("o0").eqNullSafe(F.col("o1"))).select("entity", "attr", "old", "new")
