"""Lifecycle decisions: columns over joined flags, no joins of their own."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def projecting_rule(rules: list[dict]) -> Column:
    """The first active rule that projects a row's type, or null. rules: id, type, active, projects, in order."""
    out = F.lit(None).cast("int")
    for r in reversed(rules):
        if r["active"] and r["projects"]:
            out = F.when(F.col("type") == r["type"], F.lit(r["id"])).otherwise(out)
    return out


def out_of_scope_action(rules: list[dict]) -> Column:
    """What the first enabled import rule of the type does with an object that leaves scope; disconnect by default."""
    out = F.lit("disconnect")
    for r in reversed(rules):
        if r["active"]:
            out = F.when(F.col("type") == r["type"], F.lit(r.get("out_of_scope", "disconnect"))).otherwise(out)
    return out


def deletion_decision(
    origin: Column, rule: Column, remaining: Column, trigger_system: Column | None = None, trigger_mode: Column | None = None, triggers: Column | None = None, remaining_triggers: Column | None = None
) -> Column:
    """delete or keep when an object lost a connector.

    Without a rule, of internal origin or under rule manual it is kept. last_connector deletes when none remains.
    authoritative: the disconnecting system must be one of `triggers`; mode specific deletes at once, mode all once no
    trigger remains; without triggers it is last_connector.
    """
    last = F.when(remaining == 0, "delete").otherwise("keep")
    authoritative = last
    if triggers is not None:
        named = F.coalesce(F.size(triggers), F.lit(0)) > 0
        hit = F.coalesce(F.array_contains(triggers, trigger_system), F.lit(False))
        fires = hit & ((trigger_mode == "specific") | (F.coalesce(remaining_triggers, F.lit(0)) == 0))
        authoritative = F.when(~named, last).when(fires, "delete").otherwise("keep")
    return (
        F.when(rule.isNull() | (origin == "internal") | (rule == "manual"), "keep")
        .when(rule == "last_connector", last)
        .when(rule == "authoritative", authoritative)
        .otherwise("keep")
    )


def deletion_timing(decision: Column, grace_days: Column) -> Column:
    """none, immediate or scheduled: a grace period of null or none is immediate."""
    return F.when(decision != "delete", "none").when(F.coalesce(grace_days, F.lit(0)) <= 0, "immediate").otherwise("scheduled")


def cancels_deletion(rule: Column, mode: Column, rejoined_is_trigger: Column) -> Column:
    """Whether a new connector takes a scheduled deletion back: any one does, but under authoritative triggers only
    one of a trigger's (mode all: any trigger; mode specific: a trigger too)."""
    return F.when(rule == "authoritative", F.when(mode.isNotNull(), rejoined_is_trigger).otherwise(F.lit(True))).otherwise(rule == "last_connector")


def eligible_for_deletion(objects: DataFrame, now: datetime, most: int) -> DataFrame:
    """Projected objects whose marker is set and grace over (to the moment), that their rule still deletes: the oldest `most`.

    objects: id, origin, rule, marked_at, grace_days, remaining.
    """
    due = F.col("marked_at") + F.make_dt_interval(F.coalesce("grace_days", F.lit(0)))
    ok = (F.col("origin") == "projected") & F.col("marked_at").isNotNull() & (due <= F.lit(now).cast("timestamp"))
    rule = (F.col("rule") == "authoritative") | ((F.col("rule") == "last_connector") & (F.col("remaining") == 0))
    return objects.filter(ok & rule).orderBy("marked_at", "id").limit(most)


def deletion_exports(deleted: DataFrame, connectors: DataFrame, rules: DataFrame, pending: DataFrame) -> DataFrame:
    """staged_id, action (delete, disconnect), export (reuse, replace, new, none) of deleted objects' connectors.

    rules: system, type, on_delete; any delete wins. A pending delete is reused, any other pending change replaced.
    """
    wanted = rules.groupBy("system", "type").agg(F.max(F.col("on_delete") == "delete").alias("_delete"))
    rows = connectors.join(deleted.select("target_id"), "target_id", "left_semi").join(wanted, ["system", "type"], "left")
    rows = rows.join(pending.select("staged_id", F.col("change").alias("_p")), "staged_id", "left")
    delete = F.coalesce("_delete", F.lit(False))
    export = F.when(~delete, "none").when(F.col("_p") == "delete", "reuse").when(F.col("_p").isNotNull(), "replace").otherwise("new")
    return rows.select("staged_id", "target_id", F.when(delete, "delete").otherwise("disconnect").alias("action"), export.alias("export"))


def out_of_scope_export(action: Column) -> Column:
    return F.when(action == "disconnect", "disconnect").when(action == "delete", "delete").otherwise("nothing")


def last_connector_marker(remaining: Column, origin: Column, rule: Column) -> Column:
    return (remaining == 0) & (origin == "projected") & (rule == "last_connector")


def retry(errors: Column, now: Column, most: int = 5, base_seconds: int = 60, cap_seconds: int = 3600) -> tuple[Column, Column]:
    """(status, next_retry_at) after one more error: base x 2^(n-1), capped; failed at `most` errors."""
    n = errors + 1
    wait = F.least(F.lit(float(cap_seconds)), F.lit(float(base_seconds)) * F.pow(F.lit(2.0), n - 1))
    later = F.timestamp_micros(F.unix_micros(now) + (wait * 1_000_000).cast("bigint"))
    return F.when(n >= most, "failed").otherwise("pending"), F.when(n < most, later)


def retry_password(retryable: Column, attempts: Column, now: Column, expiry: Column, most: int = 5, delay_seconds: int = 60) -> tuple[Column, Column]:
    """(status, next_retry_at) of a queued password: parked when it can't be retried or was too often, else due at the
    delay's end or its expiry, whichever is first."""
    later = F.timestamp_micros(F.unix_micros(now) + delay_seconds * 1_000_000)
    park = ~retryable | (attempts > most)
    return F.when(park, "parked").otherwise("pending"), F.when(~park, F.least(later, expiry))


def executable(now: Column) -> Column:
    """Exports that may run: pending or not confirmed, due, and not wholly waiting for references."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return F.col("status").isin("pending", "not_confirmed") & due & ~F.coalesce("all_deferred", F.lit(False))


def may_skip_unchanged(changed_at: Column, applied_at: Column, config_changed_at: Column) -> Column:
    """An object not changed since it was last applied is skipped, unless the configuration is newer than that."""
    return F.coalesce((changed_at <= applied_at) & (config_changed_at.isNull() | (config_changed_at <= applied_at)), F.lit(False))


def due(df: DataFrame, at: str, now: datetime, by: str) -> DataFrame:
    """How many rows of a queue are due, by a column."""
    return df.filter(F.col(at) <= F.lit(now).cast("timestamp")).groupBy(by).agg(F.count("*").alias("n"), F.min(at).alias("oldest"))


def stale(tasks: DataFrame, heartbeat: str, now: datetime, seconds: int) -> DataFrame:
    """Tasks without a sign of life for longer than so many seconds."""
    return tasks.filter(F.unix_micros(F.coalesce(heartbeat, "started_at")) < F.unix_micros(F.lit(now).cast("timestamp")) - seconds * 1_000_000)


def next_steps(tasks: DataFrame, run: str, step: str, done: str) -> DataFrame:
    """The tasks that may start: of each run those of its least step that isn't done, all side by side."""
    open_ = tasks.filter(~F.col(done))
    least = open_.groupBy(run).agg(F.min(step).alias("_least"))
    return open_.join(least, run).filter(F.col(step) == F.col("_least")).drop("_least")


def last_full_syncs(activities: DataFrame) -> DataFrame:
    """system, started: the start of each system's latest full synchronisation that completed; none for one that has none.

    activities: system, kind, status, started. Runs that failed or were cancelled say nothing.
    """
    done = activities.filter("kind = 'full synchronisation' and status = 'complete'")
    return done.groupBy("system").agg(F.max("started").alias("started"))


#: Worst last.
OUTCOMES = ("complete", "complete with warning", "in progress", "complete with error", "failed", "cancelled")


def step_outcomes(activities: DataFrame) -> DataFrame:
    """execution, step, outcome, runs: how each step of a schedule's execution went: as its worst run did.

    activities: execution, step, status. A status that isn't known counts as worse than all.
    """
    place = functools.reduce(lambda c, x: c.when(F.col("status") == x[1], F.lit(x[0])), enumerate(OUTCOMES), F).otherwise(F.lit(len(OUTCOMES)))
    steps = activities.groupBy("execution", "step").agg(F.max_by("status", place).alias("outcome"), F.count("*").alias("runs"))
    return steps.select("execution", "step", "outcome", "runs")


def add_failed_logins(held: DataFrame, failures: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """held (prefix, address, reason, window_start, attempts, last_seen) after more failures (prefix, address, reason, at).

    A row counts the failures of one kind in one window of time; missing prefixes and addresses count as empty, so that
    they meet.
    """
    start = F.timestamp_seconds(F.floor(F.unix_seconds("at") / window_seconds) * window_seconds)
    new = failures.select(F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("address", F.lit("")).alias("address"), "reason", start.alias("window_start"), F.lit(1).cast("long").alias("attempts"), F.col("at").alias("last_seen"))
    rows = held.unionByName(new)
    return rows.groupBy("prefix", "address", "reason", "window_start").agg(F.sum("attempts").alias("attempts"), F.max("last_seen").alias("last_seen"))
