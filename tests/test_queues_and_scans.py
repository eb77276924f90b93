"""Numbering of large groups, databases, inference, capabilities, queues and previews with a budget."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillstone.operators import lifecycle, match, outbound, summarise
from rillstone.operators.skew import numbered
from rillstone.schema import Kind
from rillstone.session import scratch
from rillstone.sources import files, relational, rest

T0 = datetime(2024, 1, 1)


def wide(spark, fn):
    """fn with small partitions that aren't put together, so that groups span several."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_large_group_is_numbered_in_several_tasks(spark, tmp_path):
    n = F.col("id")
    df = spark.range(5000).select(F.when(n < 4000, "hot").when(n < 4010, None).otherwise((n % 90).cast("string")).alias("g"), (n * 7919 % 5000).alias("v"), n)
    got = wide(spark, lambda: numbered(df, ["g"], ["v"], at=str(tmp_path / "n")).collect())
    by = {}
    for r in sorted(got, key=lambda r: r["v"]):
        by.setdefault(r["g"], []).append(r["_n"])
    assert len(got) == 5000 and all(x == list(range(1, len(x) + 1)) for x in by.values()) and None in by
    files_of_hot = spark.read.parquet(str(tmp_path / "n" / "numbered")).filter("g = 'hot'").select(F.input_file_name()).distinct().count()
    assert files_of_hot > 1


def test_numbers_of_all_rows_and_of_equal_ones(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), ("a", 3), (None, 4)], "v string, w int").repartition(3)
    got = wide(spark, lambda: sorted((r["_n"], r["v"]) for r in numbered(df, [], ["v"]).collect()))
    assert got == [(1, None), (2, "a"), (3, "a"), (4, "a"), (5, "b")]
    assert numbered(df.limit(0), [], ["v"]).collect() == []


def test_chunks_of_a_large_modification(spark):
    df = spark.range(2500).select(F.lit(1).alias("o"), F.lit("member").alias("a"), (F.col("id") % 2400).alias("v"))
    got = wide(spark, lambda: outbound.chunked(df, ["o", "a"], "v", 1000).collect())
    chunks = {r["chunk"]: r["values"] for r in got}
    assert {k: len(v) for k, v in chunks.items()} == {0: 1000, 1: 1000, 2: 400} and sum(chunks.values(), []) and chunks[0] + chunks[1] + chunks[2] == list(range(2400))


def test_generated_keys_of_equal_rows(spark):
    t = spark.createDataFrame([(5, "x")], "k long, n string")
    new = spark.createDataFrame([(None, "insert", "same")] * 30 + [(None, "insert", "a")], "k long, op string, n string")
    after, keys = files.apply_dml(t, new, "k", "n")
    assert sorted(r["k"] for r in after.collect()) == [5, *range(6, 37)] and keys.count() == 31
    assert after.filter("n = 'a'").first()["k"] == 6


# --- databases ---


@pytest.fixture(scope="module")
def db(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = spark.range(1, 1001).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.lit(T0).cast("timestamp").alias("at"))
    rows = rows.withColumn("at", F.timestamp_micros(F.unix_micros("at") + F.col("k") * 1_000_000))
    rows.coalesce(1).write.jdbc(url, "people", properties={"createTableColumnTypes": "name VARCHAR(40)"})
    rows.limit(0).coalesce(1).write.jdbc(url, "nobody", properties={"createTableColumnTypes": "name VARCHAR(40)"})
    return url


def test_a_scan_has_a_partition_for_each_range_of_the_key(spark, db):
    df = relational.scan(spark, db, "people", "k", partitions=5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 1000
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 210
    assert relational.scan(spark, db, "nobody", "k").count() == 0


def test_filters_and_columns_go_to_the_database(spark, db):
    df = relational.scan(spark, db, "people", "k", partitions=3).filter("k > 990").select("name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,990)" in plan and "ReadSchema: struct<name:string>" in plan and df.count() == 10
    view = relational.scan(spark, db, '(SELECT "k", "name" FROM people WHERE "k" < 4) few')
    assert sorted(r["k"] for r in view.collect()) == [1, 2, 3]


def test_scans_above_a_mark_and_by_pages(spark, db):
    late = relational.scan_since(spark, db, "people", "at", T0 + timedelta(seconds=995), "k")
    assert "GreaterThan(at" in late._jdf.queryExecution().executedPlan().toString() and late.count() == 5
    assert relational.scan_since(spark, db, "people", "at", None).count() == 1000
    last, seen = None, []
    while page := relational.scan_page(spark, db, "people", ["k"], last, 300).collect():
        seen += [r["k"] for r in page]
        last = (seen[-1],)
    assert seen == list(range(1, 1001))


# --- capabilities ---


def test_what_a_source_cannot_do_is_not_planned(spark, db):
    files.FILE.check("full import", "export")
    with pytest.raises(files.Unsupported, match="delta import by watermark needs delta_import, watermark"):
        files.FILE.check("full import", "delta import by watermark")
    with pytest.raises(ValueError, match="no operation"):
        files.FILE.check("fly")
    plain = files.Capabilities()
    with pytest.raises(files.Unsupported, match="partitions"):
        relational.scan(spark, db, "people", "k", capabilities=plain)
    with pytest.raises(files.Unsupported, match="paging"):
        relational.scan_page(spark, db, "people", ["k"], None, 5, capabilities=plain)
    with pytest.raises(files.Unsupported, match="watermark"):
        relational.scan_since(spark, db, "people", "k", 5, capabilities=plain)
    with pytest.raises(files.Unsupported, match="parallel_export"):
        rest.send_all(spark.range(1), "none", "r", "l", 2, capabilities=files.Capabilities(export=True))
    with pytest.raises(files.Unsupported, match="export"):
        rest.send_all(spark.range(1), "none", "r", "l", 1, capabilities=plain)
    assert relational.scan(spark, db, "people", capabilities=plain).count() == 1000


# --- files ---


def test_a_large_file_is_read_in_pieces(spark, tmp_path):
    spark.range(200_000).select("id", F.repeat(F.lit("x"), 40).alias("t")).coalesce(1).write.csv(str(tmp_path / "f"), header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert files.read_text(spark, str(tmp_path / "f")).rdd.getNumPartitions() > 4
        assert files.read_text(spark, str(tmp_path / "f"), multi_line=True).rdd.getNumPartitions() == 1
        assert files.read_text(spark, str(tmp_path / "f")).count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_feeds_in_fields(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"x\ny"\n2,"p ""q"""\n')
    assert sorted(map(tuple, files.read_text(spark, str(tmp_path / "f.csv"), multi_line=True).collect())) == [("1", "x\ny"), ("2", 'p "q"')]


@pytest.mark.parametrize("values, kind", [(["1", "-2", None, " "], Kind.NUMBER), (["1", "3000000000"], Kind.LONG), (["1", "2.5e3"], Kind.DECIMAL), (["True", "false"], Kind.BOOLEAN), (["{6F9619FF-8B86-D011-B42D-00C04FC964FF}"], Kind.GUID), (["2024-01-01", "2024-02-29 10:00:00"], Kind.DATETIME), (["1", "x"], Kind.TEXT), ([None, ""], Kind.TEXT)])
def test_inferred(spark, values, kind):
    [a] = files.infer(spark.createDataFrame([(v,) for v in values], "c string"))
    assert a.kind is kind


# --- queues and reports ---


def test_password_retries(spark):
    rows = spark.createDataFrame([(True, 1, T0 + timedelta(hours=1)), (True, 1, T0 + timedelta(seconds=30)), (True, 6, T0 + timedelta(hours=1)), (False, 1, T0 + timedelta(hours=1)), (True, 5, T0 + timedelta(hours=1))], "retryable boolean, attempts int, expiry timestamp")
    status, at = lifecycle.retry_password(F.col("retryable"), F.col("attempts"), F.lit(T0).cast("timestamp"), F.col("expiry"))
    got = [tuple(r) for r in rows.select(status.alias("s"), at.alias("a")).collect()]
    minute = T0 + timedelta(minutes=1)
    assert got == [("pending", minute), ("pending", T0 + timedelta(seconds=30)), ("parked", None), ("parked", None), ("pending", minute)]


def test_last_full_syncs_and_outcomes(spark):
    a = spark.createDataFrame([(1, "full synchronisation", "complete", T0), (1, "full synchronisation", "failed", T0 + timedelta(days=2)), (1, "delta synchronisation", "complete", T0 + timedelta(days=3)), (2, "full synchronisation", "cancelled", T0)], "system int, kind string, status string, started timestamp")
    assert [tuple(r) for r in lifecycle.last_full_syncs(a).collect()] == [(1, T0)]
    s = spark.createDataFrame([(1, 0, "complete"), (1, 0, "failed"), (1, 1, "complete"), (1, 1, "complete with warning"), (2, 0, "exploded"), (2, 0, "cancelled")], "execution int, step int, status string")
    assert sorted(map(tuple, lifecycle.step_outcomes(s).collect())) == [(1, 0, "failed", 2), (1, 1, "complete with warning", 2), (2, 0, "exploded", 2)]


def test_failed_logins_meet_without_prefix(spark):
    held = spark.createDataFrame([("", "a", "bad key", T0, 4, T0 + timedelta(minutes=9))], "prefix string, address string, reason string, window_start timestamp, attempts long, last_seen timestamp")
    new = spark.createDataFrame([(None, "a", "bad key", T0 + timedelta(minutes=5)), ("", "a", "bad key", T0 + timedelta(minutes=50)), (None, None, "bad key", T0 + timedelta(minutes=61))], "prefix string, address string, reason string, at timestamp")
    got = sorted(map(tuple, lifecycle.add_failed_logins(held, new).collect()))
    assert got == [("", "", "bad key", T0 + timedelta(hours=1), 1, T0 + timedelta(minutes=61)), ("", "a", "bad key", T0, 6, T0 + timedelta(minutes=50))]


def test_reports_by_handling(spark):
    found = spark.createDataFrame([(1, "a", "resolved", 5), (2, "b", "unresolved", None), (3, "c", "ambiguous", None)], "k int, raw string, state string, object_id long")
    assert {r["level"] for r in match.reference_report(found, "error").collect()} == {"error"} and match.reference_report(found, "warn").count() == 2
    assert match.reference_report(found, "ignore").count() == 0
    scoped = spark.createDataFrame([("x", True), ("y", False), ("y", False), (None, False)], "container string, in_scope boolean")
    assert {r["container"]: r["n"] for r in match.discarded(scoped).collect()} == {"y": 2, None: 1}
    rows = spark.createDataFrame([(["a"],), (["b"],), ([],)], "changed array<string>")
    maps = [outbound.ExportMapping("a", None), outbound.ExportMapping("b", None, enabled=False)]
    assert [r[0] for r in rows.select(outbound.relevant(F.col("changed"), maps)).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(outbound.relevant(F.col("changed"), [], True)).collect()] == [True] * 3
    assert [r[0] for r in rows.select(outbound.relevant(F.col("changed"), [])).collect()] == [False] * 3


@pytest.mark.parametrize("seconds, want", [(100, 4), (0, 1), (25, 3)])
def test_a_preview_stops_when_its_time_is_up(spark, tmp_path, seconds, want):
    ticks = iter(range(0, 1000, 10))
    df = spark.range(1000)
    got, done = summarise.within_budget(df, "id", lambda x: x.select("id"), seconds, str(tmp_path / "p"), 4, clock=lambda: next(ticks))
    ids = [r["id"] for r in got.collect()]
    assert done == want and len(ids) == len(set(ids)) and abs(len(ids) - 250 * done) < 60


def test_a_budget_needs_slices(spark):
    with pytest.raises(ValueError):
        summarise.within_budget(spark.range(1), "id", lambda x: x, 1, scratch(spark), 0)


# --- batches and change logs ---


@pytest.mark.parametrize("rows_a_batch", [3, 10_000])
def test_batches_by_running_sums(spark, rows_a_batch):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 5, 40, 99, 100, 101, None])) for i in range(600)]
    want, state = {}, {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        batch, count, held = state.get(g, (0, 0, 0))
        size = n or 0
        if size > 100:
            want[i] = None
            continue
        if count and (count >= 6 or held + size > 100):
            batch, count, held = batch + 1, 0, 0
        state[g], want[i] = (batch, count + 1, held + size), batch
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = outbound.size_batches(spark.createDataFrame(rows, "g string, i int, n int").repartition(5), "i", "n", 100, 6, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["i"]: r["batch"] for r in got} == want


def test_a_change_log_that_is_only_appended(spark, tmp_path):
    from rillstone.streaming import changes

    schema = "k int, seq int, kind string, n string"
    src, at, cp = (str(tmp_path / x) for x in ("in", "rows", "cp"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        changes.append_changes(spark.readStream.schema(schema).parquet(src), at, "k", "seq", cp).awaitTermination()
        return sorted(map(tuple, changes.current_rows(spark, at, schema, "k", "seq", "kind").collect()))

    assert run([(1, 1, "I", "a"), (1, 2, "U", "b"), (2, 3, "I", "c"), (3, 4, "I", "d")]) == [(1, 2, "U", "b"), (2, 3, "I", "c"), (3, 4, "I", "d")]
    assert run([(1, 5, "D", None), (2, 1, "U", "late"), (4, 6, "I", "e")]) == [(2, 3, "I", "c"), (3, 4, "I", "d"), (4, 6, "I", "e")]
    changes.compact(spark, at, str(tmp_path / "small"), schema, "k", "seq")
    small = changes.current_rows(spark, str(tmp_path / "small"), schema, "k", "seq", "kind")
    assert sorted(map(tuple, small.collect())) == [(2, 3, "I", "c"), (3, 4, "I", "d"), (4, 6, "I", "e")]
    spark.createDataFrame([(1, 3, "U", "older than its deletion")], schema).write.parquet(str(tmp_path / "small" / "batch=7"))
    assert small.sparkSession.read.parquet(str(tmp_path / "small")).count() == 5
    assert sorted(r["k"] for r in changes.current_rows(spark, str(tmp_path / "small"), schema, "k", "seq", "kind").collect()) == [2, 3, 4]
