"""Bucketed staging: what plans shuffle, generations, and tables that another session wrote."""

import pytest
from pyspark.sql import functions as F

from rillstone.operators import diff, outbound
from rillstone.schema import Attribute, Kind
from rillstone.session import scratch
from rillstone.sources import staging

ATTRIBUTES = [Attribute("name"), Attribute("n", Kind.LONG)]


def shuffled_scans(df):
    """Of each scan of a plan: (bucketed, whether an exchange lies between it and the next join or aggregation above)."""
    found, path = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if not line.strip() or line.startswith("AdaptiveSparkPlan"):
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [p for p in path if p[0] < depth] + [(depth, line.strip(" :+-"))]
        if "FileScan" in line:
            above = [x for _, x in reversed(path[:-1])]
            near = next((i for i, x in enumerate(above) if "Join" in x or "HashAggregate" in x), len(above))
            found.append(("Bucketed: true" in line, any("Exchange" in x for x in above[:near])))
    return found


@pytest.fixture(autouse=True)
def sort_merge(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def people(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") + 100).alias("id"), F.concat(F.lit("p"), "id").alias("name"), (F.col("id") % 7).alias("n"))


@pytest.fixture()
def staged(spark, tmp_path):
    return staging.stage(people(spark), f"st_{tmp_path.name.replace('-', '_')}_{scratch(spark)[-8:]}", str(tmp_path / "staged"), ["k"], 8)


def as_file(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("full", [True, False])
def test_only_what_came_in_is_shuffled(spark, tmp_path, staged, full):
    incoming = as_file(spark, tmp_path, people(spark, 500).drop("id").withColumn("name", F.upper("name")), "incoming")
    run = staging.imported(spark, staged, incoming, ATTRIBUTES, "id", full)
    for df in (run.matched, run.changes, diff.deletions(staged.frame(spark), incoming, ["k"])):
        scans = shuffled_scans(df)
        assert (True, False) in scans and (True, True) not in scans, df._jdf.queryExecution().executedPlan().toString()
    scans = shuffled_scans(run.after)
    assert (True, True) not in scans and sum(b for b, _ in scans) >= 2
    following = staged.following(1)
    following.write(run.after)
    assert following.frame(spark).count() == (500 if full else 2000)
    assert (True, True) not in shuffled_scans(following.frame(spark).groupBy("k").agg(F.max("n")))
    assert following.frame(spark).filter("name like 'P%'").count() == 500


def test_outbound_and_pending_read_buckets(spark, tmp_path, staged):
    merged = as_file(spark, tmp_path, people(spark, 700).withColumn("name", F.lit("x")), "merged")
    pending = staging.stage(spark.range(300).select(F.col("id").alias("k"), F.lit("update").alias("waiting")), f"{staged.table}_pending", str(tmp_path / "pending"), ["k"], 8)
    delta = outbound.outbound_delta(merged, staged.frame(spark), "k", [outbound.ExportMapping("name", ATTRIBUTES[0])]).join(pending.frame(spark), "k", "left")
    assert [x for x in shuffled_scans(delta) if x[0]] == [(True, False)] * 2
    assert delta.count() == 700 and delta.filter("waiting is not null").count() == 300


def test_a_full_import_without_rows_deletes_nothing(spark, staged):
    none = people(spark, 0).drop("id")
    run = staging.imported(spark, staged, none, ATTRIBUTES, "id")
    assert run.changes.filter("change = 'delete'").count() == 0 and run.after.count() == 2000


def test_a_delta_deletes_what_it_says(spark, staged):
    delta = spark.createDataFrame([(1, "one", 1, None), (2, None, None, True), (9999, None, None, True), (5000, "new", 5, False), (3, "p3", 3, False)], "k long, name string, n long, deleted boolean")
    run = staging.imported(spark, staged, delta, ATTRIBUTES, "id", full=False)
    assert {(r["k"], r["change"]) for r in run.changes.collect()} == {(1, "update"), (2, "delete"), (5000, "add"), (3, "none")}
    after = staged.following(1).write(run.after).frame(spark)
    rows = {r["k"]: (r["id"], r["name"]) for r in after.filter("k in (1, 2, 3, 4, 5000, 9999)").collect()}
    assert rows == {1: (101, "one"), 3: (103, "p3"), 4: (104, "p4"), 5000: (None, "new")}
    assert after.count() == 2000


def test_another_session_reads_it_where_it_lies(spark, tmp_path, staged):
    spark.sql(f"DROP TABLE {staged.table}")  # of its own place: the files stay
    staged.register(spark, "k bigint, id bigint, name string, n bigint")
    incoming = as_file(spark, tmp_path, people(spark, 50).drop("id"), "incoming")
    found = staging.imported(spark, staged, incoming, ATTRIBUTES, "id").changes
    assert (True, True) not in shuffled_scans(found) and found.filter("change = 'delete'").count() == 1950


@pytest.mark.parametrize("size, buckets", [(0, 1), (1, 1), (256 << 20, 1), ((256 << 20) + 1, 2), (100 << 40, 1 << 16), (1 << 40, 4096)])
def test_buckets_by_size(size, buckets):
    assert staging.buckets_for(size) == buckets
