"""Confirmation over time: keyed state against the whole table, restarts, retries, and state that ends."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rillstone.streaming import confirmation as C

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
POLICY = C.Policy(most_attempts=3, most_errors=3, base_seconds=60, cap_seconds=100, keep_seconds=3600)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame(rows, C.EVENT)


def until(rows, late=3600):
    return F.lit(int(max(r[2] for r in rows).timestamp() * 1000) - late * 1000)


def told(df, base=T0):
    return [(r["seq"], (r["at"].replace(tzinfo=timezone.utc) - base).total_seconds(), r["kind"], r["status"], r["attempts"], r["errors"]) for r in df.orderBy("at", F.col("seq").asc_nulls_first()).collect()]


@pytest.mark.parametrize(
    "events, want",
    [
        ([("request", 0, "x"), ("sent", 5, None), ("import", 9, "x")], [("request", "pending", 0, 0), ("sent", "exported", 1, 0), ("import", "confirmed", 1, 0)]),
        # another value: retried at once, failed after the third attempt; what comes then is ignored
        (
            [("request", 0, "x"), ("sent", 1, None), ("import", 2, "y"), ("sent", 3, None), ("import", 4, None), ("sent", 5, None), ("import", 6, "y"), ("sent", 7, None), ("import", 8, "x")],
            [("request", "pending", 0, 0), ("sent", "exported", 1, 0), ("import", "not_confirmed", 1, 0), ("sent", "exported", 2, 0), ("import", "not_confirmed", 2, 0), ("sent", "exported", 3, 0), ("import", "failed", 3, 0)],
        ),
        # errors wait 60 s, then 100 s, then fail; an import of what was never sent says nothing
        (
            [("request", 0, "x"), ("error", 10, None), ("import", 20, "x"), ("error", 80, None), ("error", 200, None)],
            [("request", "pending", 0, 0), ("error", "not_confirmed", 1, 1), ("retry", "pending", 1, 1), ("error", "not_confirmed", 2, 2), ("retry", "pending", 2, 2), ("error", "failed", 3, 3)],
        ),
        # a sent attempt waits for its import; a second one says nothing
        ([("request", 0, "x"), ("sent", 1, None), ("sent", 2, None), ("error", 3, None)], [("request", "pending", 0, 0), ("sent", "exported", 1, 0)]),
        # a newer request replaces the change and its history
        ([("request", 0, "x"), ("error", 1, None), ("request", 2, "y"), ("sent", 3, None), ("import", 4, "y")], [("request", "pending", 0, 0), ("error", "not_confirmed", 1, 1), ("request", "pending", 0, 0), ("sent", "exported", 1, 0), ("import", "confirmed", 1, 0)]),
        # its time ends it, before what comes later
        ([("request", 0, "x"), ("sent", 1, None), ("import", 3601, "x")], [("request", "pending", 0, 0), ("sent", "exported", 1, 0), ("expired", "expired", 1, 0)]),
        ([("sent", 0, None), ("import", 1, "x"), ("unheard of", 2, "x")], []),
        ([("request", 0, None), ("sent", 1, None), ("import", 2, None)], [("request", "pending", 0, 0), ("sent", "exported", 1, 0), ("import", "confirmed", 1, 0)]),
    ],
)
def test_transitions(spark, events, want):
    rows = [(1, n, at(s), kind, value) for n, (kind, s, value) in enumerate(events)]
    got = told(C.confirmations_of(frame(spark, rows), until(rows), POLICY))
    assert [x[2:] for x in got] == want
    # and by the functions that the keyed state uses
    x, out = None, []
    for _, _, t, kind, value in rows:
        ms = int(t.timestamp() * 1000)
        for x, _, due in C.settled(x, ms):
            out.append((due, x.status if x else "expired"))
        x, status = C.after(x, kind, value, ms, POLICY)
        if status:
            out.append((kind, status))
    assert out == [w[:2] for w in want]


def random_events(seed, n=400, objects=12):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randrange(1, 240)
        out.append((rng.randrange(objects), i, at(t), rng.choice(["request", "sent", "sent", "error", "import", "import"]), rng.choice(["x", "y", None])))
    return out


def test_a_stream_in_parts_gives_what_the_table_gives(spark, tmp_path):
    """Four runs, each from the checkpoint of the last, one of them without new events; then all state has ended."""
    rows = random_events(1)
    end = (99, 10_000, at(10 * 86_400), "request", "last")  # moves the watermark beyond all others' time
    cuts = [rows[:150], rows[150:160], [], rows[160:], [end]]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = 0
    for part in cuts:
        if part:
            frame(spark, part).coalesce(2).write.mode("append").parquet(src)
        C.run_confirmations(spark, src, out, cp, POLICY)
        n = spark.read.schema(C.TRANSITION).parquet(out).count()
        assert n == seen if not part else n > seen
        seen = n
    got = spark.read.schema(C.TRANSITION).parquet(out)
    want = C.confirmations_of(frame(spark, [*rows, end]), until([*rows, end]), POLICY)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert {r["kind"] for r in got.select("kind").distinct().collect()} >= {"retry", "expired", "request", "sent", "error", "import"}
    with C.rocks(spark):
        state = spark.read.format("statestore").option("stateVarName", "pending").load(cp)
        assert [r["key"]["object"] for r in state.select("key").collect()] == [99]


def test_a_run_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    """A run that breaks off after its rows were read gives each transition once when it is run again."""
    rows = random_events(2, 60, 3)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    frame(spark, rows[:30]).write.parquet(src)
    C.run_confirmations(spark, src, out, cp, POLICY)
    frame(spark, rows[30:]).write.mode("append").parquet(src)
    real = C.Confirmation.handleInputRows

    def broken(self, key, rows, timerValues):
        yield from real(self, key, rows, timerValues)
        raise RuntimeError("lost")

    monkeypatch.setattr(C.Confirmation, "handleInputRows", broken)
    with pytest.raises(Exception, match="lost"):
        C.run_confirmations(spark, src, out, cp, POLICY)
    monkeypatch.undo()
    C.run_confirmations(spark, src, out, cp, POLICY)
    got, want = spark.read.schema(C.TRANSITION).parquet(out), C.confirmations_of(frame(spark, rows), until(rows), POLICY)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
