"""Confirmation of exported changes over time, as keyed state: attempts, errors, retries that come due, and an end.

Events of an object, in the order of seq: `request` (a value is to be exported; replaces what was pending), `sent` and
`error` (an attempt went out, or failed), `import` (what the target holds). A pending change is pending, exported,
not_confirmed or failed; it ends confirmed by an import that has its value, or expired after its time. A failed attempt is
tried again after a wait that doubles; then the change is pending again.

`confirmations` keeps a value state and timers for each object and gives the transitions of a stream; `confirmations_of`
gives the same rows from a whole table. Both take event times in order: what lies before an event's time, a retry or an
expiry, is settled before the event is, so it doesn't matter how events fall into batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EVENT = "object long, seq long, at timestamp, kind string, value string"
TRANSITION = "object long, seq long, at timestamp, kind string, status string, attempts int, errors int"
_STATE = "status string, expected string, attempts int, errors int, sent boolean, retry long, expires long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """Attempts and errors after which a change has failed, seconds of the first wait and of the longest, and of a change."""

    most_attempts: int = 5
    most_errors: int = 5
    base_seconds: int = 60
    cap_seconds: int = 3600
    keep_seconds: int = 7 * 86_400

    def wait(self, errors: int) -> int:
        return min(self.cap_seconds, self.base_seconds * 2 ** (errors - 1)) * 1000


@dataclass
class Pending:
    """The state of one object's change; times in milliseconds."""

    status: str
    expected: str | None
    attempts: int
    errors: int
    sent: bool
    retry: int | None
    expires: int

    def row(self) -> tuple:
        return (self.status, self.expected, self.attempts, self.errors, self.sent, self.retry, self.expires)


def settled(x: Pending | None, now: int) -> Iterator[tuple[Pending | None, int, str]]:
    """(state after, time, kind) of what comes due up to now: a retry, and the end of its time."""
    if x and x.retry is not None and x.retry <= now and x.retry < x.expires:
        x.status, at, x.retry = "pending", x.retry, None
        yield x, at, "retry"
    if x and x.expires <= now:
        yield None, x.expires, "expired"


def after(x: Pending | None, kind: str, value: str | None, at: int, p: Policy) -> tuple[Pending | None, str | None]:
    """(state, status) after an event; status is null where the event says nothing."""
    if kind == "request":
        return Pending("pending", value, 0, 0, False, None, at + p.keep_seconds * 1000), "pending"
    if x is None or x.status == "failed":
        return x, None
    if kind == "import":
        if not x.sent:
            return x, None
        if value == x.expected:
            return None, "confirmed"
        x.status, x.retry = "failed" if x.attempts >= p.most_attempts else "not_confirmed", None
    elif x.status == "exported":
        return x, None  # an attempt waits for its import
    elif kind == "sent":
        x.status, x.attempts, x.sent, x.retry = "exported", x.attempts + 1, True, None
    elif kind == "error":
        x.attempts, x.errors = x.attempts + 1, x.errors + 1
        x.status = "failed" if x.errors >= p.most_errors else "not_confirmed"
        x.retry = at + p.wait(x.errors) if x.status == "not_confirmed" else None
    else:
        return x, None
    return x, x.status


class Confirmation(StatefulProcessor):
    """Value state and timers of one object. State goes when a change ends."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("pending", _STATE)

    def _load(self) -> Pending | None:
        return Pending(*self.held.get()) if self.held.exists() else None

    def _keep(self, x: Pending | None, before: Pending | None) -> None:
        """Write the state; timers stand for its retry and its end."""
        old = {t for t in (before.retry, before.expires) if t is not None} if before else set()
        new = {t for t in (x.retry, x.expires) if t is not None} if x else set()
        for t in old - new:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)
        if x is None:
            self.held.clear()
        else:
            self.held.update(x.row())

    @staticmethod
    def _row(key: int, seq: int | None, at: int, kind: str, status: str, x: Pending | None, was: tuple[int, int]) -> Row:
        attempts, errors = (x.attempts, x.errors) if x else was
        return Row(object=key, seq=seq, at=at, kind=kind, status=status, attempts=attempts, errors=errors)

    def _settle(self, key: int, x: Pending | None, now: int) -> Iterator[tuple[Pending | None, Row]]:
        was = (x.attempts, x.errors) if x else (0, 0)
        for x, at, kind in settled(x, now):
            yield x, self._row(key, None, at, kind, x.status if x else "expired", x, was)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        x = self._load()
        before = Pending(*x.row()) if x else None
        for e in sorted(rows, key=lambda e: e["seq"]):
            for x, out in self._settle(key[0], x, e["ms"]):
                yield out
            was = (x.attempts, x.errors) if x else (0, 0)
            x, status = after(x, e["kind"], e["value"], e["ms"], self.policy)
            if status:
                yield self._row(key[0], e["seq"], e["ms"], e["kind"], status, x, was)
        self._keep(x, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        x = self._load()
        before = Pending(*x.row()) if x else None
        due = expiredTimerInfo.getExpiryTimeInMs()
        for x, out in self._settle(key[0], x, due):
            yield out
        # a fired timer is gone: only others are deleted or kept
        if before:
            before.retry = None if before.retry == due else before.retry
            if before.expires == due:
                before.expires = None
        self._keep(x, before)

    def close(self) -> None:
        pass


def confirmations(events: DataFrame, policy: Policy = Policy(), late: str = "1 hour") -> DataFrame:
    """The transitions of a stream of events (EVENT), as rows of TRANSITION; seq is null where a timer made them.

    Needs a state store with several states a key (RocksDB). Rows later than the watermark are left out.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that reads states' schemas may lack this package
    rows = events.withWatermark("at", late).select("object", "seq", "at", "kind", "value", F.unix_millis("at").alias("ms"))
    schema = TRANSITION.replace("at timestamp", "at long")
    made = rows.groupBy("object").transformWithState(Confirmation(policy), schema, "Append", "EventTime")
    return made.withColumn("at", F.timestamp_millis("at"))


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state needs, for streams that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_confirmations(spark: SparkSession, source: str, out: str, checkpoint: str, policy: Policy = Policy(), late: str = "1 hour") -> StreamingQuery:
    """Read what is new in a folder of events and append its transitions to a folder, exactly once; goes on from checkpoint."""
    with rocks(spark):
        found = confirmations(spark.readStream.schema(EVENT).parquet(source), policy, late)
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def confirmations_of(events: DataFrame, until: Column, policy: Policy = Policy()) -> DataFrame:
    """The transitions of a whole table of events, with what comes due up to `until` (milliseconds): rows of TRANSITION.

    An object's rows are folded from one request to the next, as nothing of a change outlives the next request.
    """
    w = Window.partitionBy("object").orderBy("seq")
    rows = events.select("object", "seq", F.unix_millis("at").alias("ms"), "kind", "value").withColumn("change", F.count(F.when(F.col("kind") == "request", 1)).over(w))
    starts = rows.filter("kind = 'request'")
    ends = starts.select("object", "change", F.lead("ms").over(w).alias("end"))
    each = rows.filter("change > 0").groupBy("object", "change").agg(F.array_sort(F.collect_list(F.struct("seq", "ms", "kind", "value"))).alias("events"))
    each = each.join(ends, ["object", "change"]).withColumn("end", F.coalesce("end", until))
    empty = F.array().cast("array<struct<seq:bigint,at:bigint,kind:string,status:string,attempts:int,errors:int>>")
    none = F.lit(None)
    zero = F.struct(
        none.cast("string").alias("status"), none.cast("string").alias("expected"), F.lit(0).alias("attempts"), F.lit(0).alias("errors"), F.lit(False).alias("sent"),
        none.cast("bigint").alias("retry"), none.cast("bigint").alias("expires"), empty.alias("out"),
    )

    def made(x: Column, **new: Column) -> Column:
        return F.struct(*(new.get(n, x[n]).alias(n) for n in ("status", "expected", "attempts", "errors", "sent", "retry", "expires", "out")))

    def told(x: Column, seq: Column, at: Column, kind: Column, status: Column, attempts: Column, errors: Column) -> Column:
        return F.concat(x["out"], F.array(F.struct(seq.cast("bigint").alias("seq"), at.alias("at"), kind.alias("kind"), status.alias("status"), attempts.alias("attempts"), errors.alias("errors"))))

    def settle(x: Column, now: Column) -> Column:
        return let(let(x, lambda y: again(y, now)), lambda y: ended(y, now))

    def again(x: Column, now: Column) -> Column:
        due = x["retry"].isNotNull() & (x["retry"] <= now) & (x["retry"] < x["expires"])
        row = told(x, none, x["retry"], F.lit("retry"), F.lit("pending"), x["attempts"], x["errors"])
        return F.when(due, made(x, status=F.lit("pending"), retry=none.cast("bigint"), out=row)).otherwise(x)

    def ended(x: Column, now: Column) -> Column:
        row = told(x, none, x["expires"], F.lit("expired"), F.lit("expired"), x["attempts"], x["errors"])
        return F.when(x["status"].isNotNull() & (x["expires"] <= now), made(x, status=none.cast("string"), out=row)).otherwise(x)

    def outcome(x: Column, e: Column) -> Column:
        """What an event does: new (the status it says, or null), attempts, errors, tried."""
        kind, status = e["kind"], x["status"]
        live = status.isNotNull() & (status != "failed")
        tried = F.coalesce(live & (status != "exported") & kind.isin("sent", "error"), F.lit(False))
        errors = F.when(kind == "request", 0).when(tried & (kind == "error"), x["errors"] + 1).otherwise(x["errors"])
        new = (
            F.when(kind == "request", "pending")
            .when(live & (kind == "import") & x["sent"], F.when(e["value"].eqNullSafe(x["expected"]), "confirmed").when(x["attempts"] >= policy.most_attempts, "failed").otherwise("not_confirmed"))
            .when(tried, F.when(kind == "sent", "exported").when(errors >= policy.most_errors, "failed").otherwise("not_confirmed"))
        )
        attempts = F.when(kind == "request", 0).when(tried, x["attempts"] + 1).otherwise(x["attempts"])
        return F.struct(new.alias("new"), attempts.alias("attempts"), errors.alias("errors"), tried.alias("tried"))

    def step(x: Column, e: Column) -> Column:
        return let(settle(x, e["ms"]), lambda y: let(outcome(y, e), lambda o: applied(y, e, o)))

    def applied(x: Column, e: Column, o: Column) -> Column:
        kind, new = e["kind"], o["new"]
        wait = F.least(F.lit(float(policy.cap_seconds)), F.lit(float(policy.base_seconds)) * F.pow(F.lit(2.0), o["errors"] - 1)) * 1000
        return made(
            x, status=F.when(new == "confirmed", none.cast("string")).otherwise(F.coalesce(new, x["status"])), expected=F.when(kind == "request", e["value"]).otherwise(x["expected"]),
            attempts=o["attempts"], errors=o["errors"], sent=F.when(kind == "request", False).otherwise(x["sent"] | (o["tried"] & (kind == "sent"))),
            retry=F.when(o["tried"] & (kind == "error") & (new == "not_confirmed"), e["ms"] + wait.cast("bigint")).when(new.isNull(), x["retry"]),
            expires=F.when(kind == "request", e["ms"] + policy.keep_seconds * 1000).otherwise(x["expires"]),
            out=F.when(new.isNull(), x["out"]).otherwise(told(x, e["seq"], e["ms"], kind, new, o["attempts"], o["errors"])),
        )

    folded = each.select("object", settle(F.aggregate("events", zero, step), F.col("end")).alias("x"))
    out = folded.select("object", F.inline("x.out"))
    return out.select("object", "seq", F.timestamp_millis("at").alias("at"), "kind", "status", "attempts", "errors")
