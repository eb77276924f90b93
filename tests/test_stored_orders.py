"""Rank indexes, ticks by day, Bloom-filtered recalls, recursive chains and trees of settings: answers and plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillstone.operators import diff, page_index, recall, summarise, ticks
from rillstone.operators.criteria import Criterion, Group, Relative
from rillstone.schema import Attribute, Kind, ObjectType
from rillstone.session import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_metrics(df):
    """Numbers of files and of rows out of each file scan, after df has run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec":
            m = node.metrics()
            found.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


# --- pages ---


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, *range(50)]), i, rng.choice(["x", "y", None])) for i in range(3000)]
    return data, spark.createDataFrame(data, "a int, b long, c string").repartition(5)


ORDERS = {
    "up": ([("a", False), ("b", False)], lambda r: (r[0] is not None, r[0] or 0, r[1])),
    "down": ([("a", True), ("b", False)], lambda r: (r[0] is None, -(r[0] or 0), r[1])),
    "both down": ([("a", True), ("b", True)], lambda r: (r[0] is None, -(r[0] or 0), -r[1])),
}


@pytest.mark.parametrize("name", ORDERS)
def test_pages_of_a_stored_order(spark, tmp_path, rows, name):
    data, df = rows
    keys, order = ORDERS[name]
    index = page_index.build(df, keys, str(tmp_path / "i"), 300)
    want = sorted(data, key=order)
    assert index.total(spark) == 3000 and index.parts(spark).count() >= 8
    for offset, count in [(0, 10), (-5, 3), (295, 10), (1500, 250), (2990, 50), (3000, 5), (9999, 5), (10, 0), (0, 10_000)]:
        got = [tuple(r) for r in index.range(spark, offset, count).collect()]
        assert got == want[max(0, offset) : max(0, offset) + min(count, 500)], (offset, count)
    for at in (0, 1, 299, 1234, 2990, 2999):
        last = (want[at][0], want[at][1])
        assert [tuple(r) for r in index.after(spark, last, 20).collect()] == want[at + 1 : at + 21], at
    assert [tuple(r) for r in index.after(spark, None, 7).collect()] == want[:7]
    absent = (25, 10**6)  # no such row: those behind where it would be
    assert [tuple(r) for r in index.after(spark, absent, 5).collect()] == [r for r in want if order((25, 10**6, None)) < order(r)][:5]


def test_all_pages_one_after_the_other_are_the_order(spark, tmp_path, rows):
    data, df = rows
    keys, order = ORDERS["down"]
    index, last, seen = page_index.build(df, keys, str(tmp_path / "i"), 700), None, []
    while got := [tuple(r) for r in index.after(spark, last, 500).collect()]:
        seen += got
        last = got[-1][:2]
    assert seen == sorted(data, key=order)


def test_a_deep_page_reads_two_parts_at_most(spark, tmp_path):
    df = spark.range(100_000).select(F.xxhash64("id").alias("k"), F.col("id"))
    index = page_index.build(df, [("k", False), ("id", False)], str(tmp_path / "i"), 5_000)
    assert index.parts(spark).count() >= 15
    page = index.range(spark, 50_000, 50)  # the thousandth page of fifty
    assert "part#" in plan_of(page).split("PartitionFilters: [")[1].split("]")[0]
    assert [n for n, _ in scan_metrics(page)] <= [2]
    at = page.first()
    page = index.after(spark, (at["k"], at["id"]), 50)
    assert [n for n, _ in scan_metrics(page)] <= [2] and page.count() == 50


def test_an_empty_order(spark, tmp_path):
    index = page_index.build(spark.createDataFrame([], "a int"), [("a", False)], str(tmp_path / "i"))
    assert index.total(spark) == 0 and index.range(spark, 0, 5).collect() == [] and index.after(spark, None, 5).collect() == []


# --- ticks ---

T = ObjectType("person", (Attribute("id", Kind.LONG), Attribute("start", Kind.DATETIME), Attribute("stop", Kind.DATETIME)), "id")
NOW = datetime(2024, 3, 10, 12)


def people(spark):
    data = [(i, datetime(2024, 1, 1) + timedelta(days=i % 100, hours=i % 24), None if i % 7 == 0 else datetime(2024, 1, 15) + timedelta(days=i % 90), i % 3 == 0) for i in range(2000)]
    return spark.createDataFrame(data, "id long, start timestamp, stop timestamp, on boolean")


RULES = {
    1: (Group((Criterion("start", "le", Relative(0, "days")), Criterion("stop", "gt", Relative(0, "days")))),),
    2: (Group((Criterion("start", "le", Relative(-7, "days")),)),),
    3: (Group((Criterion("id", "gt", 5),)),),  # no relative date: time doesn't touch it
}


@pytest.mark.parametrize("after", [None, datetime(2024, 3, 7, 9), NOW, datetime(2024, 4, 1)])
def test_ticks(spark, tmp_path, after):
    from rillstone.operators import criteria

    rows = people(spark)
    ticks.write_values(rows, T, ["start", "stop"], str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    found = ticks.candidates(values, ticks.windows(spark, RULES, T, after, NOW, scratch(spark)))
    want = {(n, r["id"]) for n, g in RULES.items() for r in rows.filter(criteria.crossed(g, T, after, NOW)).select("id").collect()}
    assert {tuple(r) for r in found.collect()} == want and (len(want) > 0) == (after in (None, datetime(2024, 3, 7, 9)))
    out = ticks.drifted(rows, T, found, RULES, "on", NOW)
    drift = {(n, r["id"]) for n, g in RULES.items() for r in rows.filter(criteria.scope_drift(g, T, F.col("on"), after, NOW)).select("id").collect()}
    assert {(r["rule"], r["key"]) for r in out.collect()} == drift


def test_a_tick_reads_the_days_of_its_windows(spark, tmp_path):
    ticks.write_values(people(spark), T, ["start", "stop"], str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    found = ticks.candidates(values, ticks.windows(spark, RULES, T, datetime(2024, 3, 8, 9), NOW, scratch(spark)))
    assert "dynamicpruning" in plan_of(found)
    found.collect()
    # windows end at midnight of 8 and 10 March, and a week before: six days of a hundred, however many files
    days = {str(r["day"]) for r in values.filter("day between '2024-03-01' and '2024-03-03' or day between '2024-03-08' and '2024-03-10'").select("day").distinct().collect()}
    read = [n for _, n in scan_metrics(found)]
    assert len(days) == 6 and values.filter(F.col("day").isin(list(days))).count() in read


# --- recalls ---


def test_deleted_ids_filter_references_where_they_are_read(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("owner"), F.lit("m").alias("attr"), (F.col("id") * 7 % 100_000).alias("ref")).write.parquet(str(tmp_path / "refs"))
    spark.range(100_000).select("id", F.when(F.col("id") % 5000 == 0, "delete").otherwise("none").alias("change")).write.parquet(str(tmp_path / "ch"))
    refs, changes = spark.read.parquet(str(tmp_path / "refs")), spark.read.parquet(str(tmp_path / "ch"))
    held = refs.filter("owner % 2 = 0")
    got = recall.recalled(changes, refs, held, scratch(spark))
    assert got.count() == 40 and got.filter("held").count() == 40 - got.filter("owner % 2 = 1").count()
    with recall.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), recall.bloom_filters(spark):
        df = refs.join(changes.filter("change = 'delete'").select(F.col("id").alias("ref")), "ref", "left_semi")
        plan = plan_of(df)
        assert plan.index("Exchange") < plan.index("might_contain") < plan.index("FileScan")  # the filter stands below the shuffle
        df.collect()
        final = df._jdf.queryExecution().executedPlan()
        todo, passed = [final], []
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
            if name == "FilterExec" and "might_contain" in node.condition().toString():
                passed.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert passed and 40 <= sum(passed) < 2_000  # of 200,000 references
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") in ("10GB", "10737418240b")


def test_nothing_deleted_recalls_nothing(spark):
    refs = spark.createDataFrame([(1, "m", 5)], "owner long, attr string, ref long")
    changes = spark.createDataFrame([(5, "none")], "id long, change string")
    assert recall.recalled(changes, refs, refs, scratch(spark)).count() == 0


# --- chains ---


def test_chains_that_meet_and_cycles(spark):
    ladder = [(f"a{i}", f"{s}{i - 1}") for i in range(1, 19) for s in "ab"] + [(f"b{i}", f"{s}{i - 1}") for i in range(1, 19) for s in "ab"]  # 2^18 paths
    edges = spark.createDataFrame([*ladder, ("a0", "a3"), ("x", "y"), ("y", "x"), ("z", None), (None, "z")], "effect string, cause string")
    got = summarise.causal_chain(edges, spark.createDataFrame([("a18",), ("x",), ("a18",), (None,), ("alone",)], "id string"), 20)
    rows = {(r["start"], r["node"]): r["steps"] for r in got.collect()}
    assert rows == {("a18", "a18"): 0, **{("a18", f"{s}{i}"): 18 - i for i in range(18) for s in "ab"}, ("x", "x"): 0, ("x", "y"): 1, ("alone", "alone"): 0}


def test_a_chain_beyond_its_depth(spark):
    line = spark.createDataFrame([(i, i - 1) for i in range(1, 8)], "effect int, cause int")
    start = spark.createDataFrame([(7,)], "id int")
    assert summarise.causal_chain(line, start, 7).count() == 8
    with pytest.raises(ValueError, match="more than 6 steps"):
        summarise.causal_chain(line, start, 6)


# --- settings ---


def test_trees_of_settings(spark):
    old = [(1, '{"a": {"b": [1, {"c": null}], "x": "y"}, "t": true, "e": {}, "l": [], "same": [[0]]}'), (2, "7"), (3, '{"gone": 1}'), (4, "{bad"), (5, None)]
    new = [(1, '{"a": {"b": [1, {"c": 2}, 3], "x": "y"}, "t": "true", "e": {"f": 1}, "l": [[]], "same": [[0]]}'), (2, "8"), (4, '{"now": "fine"}'), (5, None)]
    got = diff.settings_changes(*(spark.createDataFrame(x, "k int, j string") for x in (old, new)), ["k"], "j").collect()
    assert {(r["k"], r["path"]): (r["change"], r["old"], r["new"]) for r in got} == {
        (1, "/a/b/1/c"): ("changed", "null", "2"), (1, "/a/b/2"): ("added", None, "3"), (1, "/t"): ("changed", "true", '"true"'), (1, "/e"): ("removed", "{}", None),
        (1, "/e/f"): ("added", None, "1"), (1, "/l"): ("removed", "[]", None), (1, "/l/0"): ("added", None, "[]"), (2, ""): ("changed", "7", "8"),
        (3, "/gone"): ("removed", "1", None), (4, "/now"): ("added", None, '"fine"'),
    }


def test_deep_trees(spark):
    deep = "1"
    for n in range(60):
        deep = f'{{"n{n}": {deep}}}' if n % 2 else f"[{deep}]"
    [r] = diff.flattened(spark.createDataFrame([(1, deep)], "k int, j string"), ["k"], "j").collect()
    assert r["value"] == "1" and r["path"].count("/") == 60
