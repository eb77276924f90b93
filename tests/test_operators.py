"""Tables for operators whose rules have corners that the test tables don't reach."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone.operators import confirm, diff, lifecycle, match, merge, outbound, query, summarise
from rillstone.plans import pipeline
from rillstone.schema import Attribute, Kind, ObjectType, from_eav, to_eav

A = [Attribute("t"), Attribute("d", Kind.DECIMAL), Attribute("m", many=True), Attribute("w", Kind.DATETIME)]
SCHEMA = "id int, t string, d decimal(38,10), m array<string>, w timestamp"
T0 = datetime(2024, 1, 1)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_diff_changes_and_no_changes(spark):
    from decimal import Decimal as D

    a = frame(spark, [(1, "x", D("5.0"), ["a", "b"], T0), (2, "x", None, None, None), (3, "x", None, [], None), (4, "gone", None, [], None)])
    b = frame(spark, [(1, "x", D("5.00"), ["b", "a", "b"], T0), (2, "X", None, [], None), (3, "x", D("0"), ["c"], None), (5, "new", None, [], None)])
    assert got(diff.object_changes(a, b, ["id"], A), "id") == [(1, "none", []), (2, "update", ["t"]), (3, "update", ["d", "m"]), (4, "delete", []), (5, "add", [])]
    assert got(diff.object_changes(a, b.limit(0), ["id"], A), "id") == []
    assert {r["change"] for r in diff.object_changes(a, b, ["id"], A, detect_deletes=False).collect()} == {"none", "update", "add"}
    rows = diff.value_changes(a, b, ["id"], A).select("id", "attr", "value", "op")
    assert got(rows, "id", "attr", "op", "value") == [(2, "t", "X", "add"), (2, "t", "x", "remove"), (3, "d", "0", "add"), (3, "m", "c", "add"), (4, "t", "gone", "remove"), (5, "t", "new", "add")]
    h = lambda df: {r["id"]: r["h"] for r in df.select("id", diff.content_hash(A).alias("h")).collect()}
    assert h(a)[1] == h(b)[1] and h(a)[2] != h(b)[2] and h(a)[3] != h(b)[3]
    assert got(diff.deletions(a, b, ["id"]), "id") == [(4,)] and diff.deletions(a, b.limit(0), ["id"]).count() == 0


def test_eav_round_trip(spark):
    from decimal import Decimal as D

    a = frame(spark, [(1, "x", D("5.1"), ["a", "b"], T0), (2, None, D("-7"), None, None)])
    assert got(from_eav(to_eav(a, ["id"], A), ["id"], A), "id") == [(1, "x", D("5.1000000000"), ["a", "b"], T0), (2, None, D("-7.0000000000"), [], None)]


def test_cascade_stops_at_ambiguity(spark):
    s = frame(spark, [(1, "A", "p"), (2, "b", "q"), (3, "z", "q"), (4, "z", "none"), (5, None, None)], "sid int, x string, y string")
    c = frame(spark, [(10, "a", "p"), (20, "B", "q"), (21, "B", "r"), (30, "c", "q")], "cid int, x string, y string")
    rules = [match.MatchRule(1, "x", "x"), match.MatchRule(2, "y", "y")]
    want = [(1, "joined", 1, 10), (2, "ambiguous", 1, None), (3, "ambiguous", 2, None), (4, "none", None, None), (5, "none", None, None)]
    assert got(match.match_cascade(s, c, rules, "sid", "cid"), "sid") == want
    out = match.match_cascade(s, c, [match.MatchRule(1, "x", "x", case_sensitive=True), match.MatchRule(2, "y", "y")], "sid", "cid", stop_at_ambiguity=False)
    assert got(out, "sid")[:3] == [(1, "joined", 2, 10), (2, "none", None, None), (3, "none", None, None)]
    twice = frame(spark, [(1, "joined", 1, 10), (2, "joined", 1, 10), (3, "joined", 1, 20), (4, "none", None, None)], "sid int, outcome string, rule int, cid int")
    held = frame(spark, [(9, 20), (8, 30)], "sid int, cid int")
    assert [r[1] for r in got(match.claim_once(twice, held, held.filter("sid = 8"), "sid", "cid"), "sid")] == ["joined", "already_joined", "already_joined", "none"]
    with pytest.raises(ValueError, match="don't match"):
        match.MatchRule(1, "x", "x", Kind.BOOLEAN).key(F.lit(True))


def test_duplicates_have_no_winner(spark):
    ok, bad = match.reject_duplicates(frame(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "b")], "n int, k string"), ["k"])
    assert got(ok, "n") == [("a", 1)] and bad.count() == 3


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("value", "a", 1, 2, 1, False), ("value", "b", 2, 1, 2, False)], ("value", "b")),
        ([("none", None, 1, 1, 1, True), ("value", "b", 2, 2, 2, False)], ("asserted_null", None)),
        ([("none", None, 1, 1, 1, False), ("value", "b", 2, 2, 2, False)], ("value", "b")),
        ([("na", "x", 1, 1, 1, True), ("value", "b", 2, 2, 2, False)], ("value", "b")),
        ([("value", "a", 1, 1, 9, False), ("value", "b", 2, 1, 3, False)], ("value", "b")),
        ([("none", None, 1, 1, 1, False)], ("no_contributor", None)),
    ],
)
def test_priority(spark, rows, want):
    c = frame(spark, [(1, *r) for r in rows], "k int, state string, value string, rule int, priority int, mapping_id int, null_is_value boolean")
    r = merge.resolve(c, ["k"]).first()
    assert (r["outcome"], r["value"]) == want


def test_merge_changes_and_pairs(spark):
    c = frame(
        spark,
        [
            (1, "t", False, "update", "old", None, 1, False), (1, "t", False, "update", "new", None, 2, False), (1, "t", False, "update", "drift", None, 3, True),
            (1, "m", True, "add", "a", None, 1, False), (1, "m", True, "remove", "a", None, 2, False), (1, "m", True, "add", "b", None, 1, False),
            (1, "r", True, "add", "x", None, 1, False), (1, "r", True, "remove_all", None, None, 5, False), (1, "r", True, "add", "y", None, 6, False),
        ],
        "id int, attr string, many boolean, op string, value string, reference string, seq int, drift boolean",
    )
    rows = outbound.merge_changes(c, "id").select("attr", "op", "value")
    assert sorted(map(str, got(rows, "attr"))) == sorted(map(str, [("m", "add", "b"), ("m", "remove", "a"), ("r", "add", "y"), ("r", "remove_all", None), ("t", "update", "new")]))
    p = frame(spark, [(1, "create", "pending"), (1, "delete", "pending"), (2, "update", "pending"), (2, "delete", "pending"), (3, "create", "exported"), (3, "delete", "pending")], "id int, change string, status string")
    assert got(outbound.cancelled_pairs(p, "id"), "id", "change") == [(2, "delete", "pending"), (3, "create", "exported"), (3, "delete", "pending")]


def test_outbound_corners(spark):
    maps = [outbound.ExportMapping("one", Attribute("t")), outbound.ExportMapping("many", Attribute("s"), source_many=True), outbound.ExportMapping("many", Attribute("m", many=True), source_many=True), outbound.ExportMapping("one", Attribute("i"), initial_only=True)]
    a = frame(spark, [(1, "x", ["a"]), (2, None, ["a", "b"]), (3, None, [])], "id int, one string, many array<string>")
    t = frame(spark, [(1, "x", "z", ["a", "c"], "q"), (2, "y", "a", None, None)], "id int, t string, s string, m array<string>, i string")
    rows = outbound.outbound_delta(a, t, "id", maps)
    want = [(1, "update", "m", "remove", "c"), (1, "update", "s", "update", "a"), (2, "update", "m", "add", "a"), (2, "update", "m", "add", "b"), (2, "update", "s", "error", "several values"), (2, "update", "t", "update", None)]
    assert got(rows, "id", "attr", "value") == want


def test_confirmation(spark):
    c = frame(
        spark,
        [(1, "a", "update", "x"), (1, "b", "update", "x"), (1, "c", "update", ""), (1, "d", "remove", "x"), (1, "e", "remove_all", None), (1, "f", "add", "y"), (1, "g", "remove_all", None)],
        "id int, attr string, op string, value string",
    )
    held = frame(spark, [(1, "a", "x"), (1, "d", "y"), (1, "e", "z"), (1, "f", "y")], "id int, attr string, value string")
    assert [r[4] for r in got(confirm.confirmed_changes(c, held, "id"), "attr")] == [True, False, True, True, False, True, True]
    s = frame(spark, [(1, "pending", "create", 1, 2, 0), (2, "not_confirmed", "create", 1, 2, 0), (3, "not_confirmed", "update", 2, 2, 1), (4, "failed", "update", 0, 2, 1)], "id int, status string, change string, open int, total int, errors int")
    assert got(confirm.sync_confirmation(s), "id") == [(1, "pending", "create", 1, 2, 0), (2, "not_confirmed", "update", 1, 2, 0), (3, "not_confirmed", "update", 2, 2, 2)]
    ops = F.array(*(F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(o).alias("op"), F.lit(v).cast("string").alias("value")) for i, (o, v) in enumerate([("add", "b"), ("add", "a"), ("remove", "a"), ("add", "c")])))
    assert spark.range(1).select(confirm.apply_changes(F.array(F.lit("a")), ops)).first()[0] == ["b", "c"]


@pytest.mark.parametrize(
    ("origin", "rule", "remaining", "system", "mode", "triggers", "rest", "want"),
    [
        ("projected", None, 0, 1, "all", [], 0, "keep"),
        ("internal", "last_connector", 0, 1, "all", [], 0, "keep"),
        ("projected", "manual", 0, 1, "all", [], 0, "keep"),
        ("projected", "last_connector", 0, 1, "all", [], 0, "delete"),
        ("projected", "last_connector", 1, 1, "all", [], 0, "keep"),
        ("projected", "authoritative", 1, 1, "specific", [1, 2], 1, "delete"),
        ("projected", "authoritative", 1, 3, "specific", [1, 2], 1, "keep"),
        ("projected", "authoritative", 1, 1, "all", [1, 2], 1, "keep"),
        ("projected", "authoritative", 1, 1, "all", [1, 2], 0, "delete"),
        ("projected", "authoritative", 0, 9, "all", [], 0, "delete"),
    ],
)
def test_deletion(spark, origin, rule, remaining, system, mode, triggers, rest, want):
    t = F.array(*map(F.lit, triggers)).cast("array<int>")
    c = lifecycle.deletion_decision(F.lit(origin), F.lit(rule), F.lit(remaining), F.lit(system), F.lit(mode), t, F.lit(rest))
    assert spark.range(1).select(c).first()[0] == want


def test_references_and_recall(spark):
    rows = frame(spark, [(1, ["a", "b", "b", "x", None]), (2, None)], "k int, refs array<string>")
    objects = frame(spark, [("u", "a", 1), ("u", "b", 2), ("g", "b", 3)], "type string, external_id string, id int")
    assert got(match.resolve_references(rows, objects, "k", "refs"), "raw") == [(1, "a", "resolved", 1), (1, "b", "ambiguous", None), (1, "x", "unresolved", None)]
    assert got(match.resolve_references(rows, objects, "k", "refs", "g"), "raw")[1] == (1, "b", "resolved", 3)
    refs = frame(spark, [(1, "m", "r", True, True), (1, "m", "s", True, False), (1, "one", "r", False, False)], "owner int, attr string, ref string, many boolean, held boolean")
    assert got(outbound.recall_changes(refs), "attr") == [(1, "m", "remove", "r"), (1, "one", "update", None)]


def test_patterns_and_chain(spark):
    rows = frame(spark, [("a", "x@a.b", "x@c.d"), ("b", "cn=j,ou=x", "cn=j,ou=y"), ("c", "jane", "Jane"), ("d", "abc", "abc-1"), ("e", "abc", "ABC"), ("e", "abc", "abcd"), ("f", None, "x")], "g string, old string, new string")
    assert got(summarise.group_pattern(rows, ["g"]), "g") == [("a", "a.b to c.d"), ("b", "move to ou=y"), ("c", "casing"), ("d", "suffix+-1"), ("e", None), ("f", None)]
    edges = frame(spark, [(3, 2), (2, 1), (1, 3)], "effect int, cause int")
    assert got(summarise.causal_chain(edges, frame(spark, [(3,)], "id int")), "steps") == [(3, 3, 0), (3, 2, 1), (3, 1, 2)]


def test_two_runs_change_nothing(spark):
    person = ObjectType("person", (Attribute("k", Kind.NUMBER), Attribute("name")), "k")
    flows = (pipeline.Flow(1, "name", expression='Upper(Trim(cs["name"]))'),)
    rule = pipeline.ImportRule(1, person, flows, (match.MatchRule(1, "name", "name"),))
    people = frame(spark, [(1, " ann "), (2, "bob"), (3, None)], "k int, name string")
    known = frame(spark, [(77, "BOB")], "entity long, name string")
    first = pipeline.full_run({1: people.limit(0)}, {1: people}, known, [rule], person, T0)
    assert sorted(r["change"] for r in first.changes.collect()) == ["add"] * 3
    merged = pipeline.wide(first.merged, ObjectType("p", (Attribute("name"),), "name"))
    assert {r["name"] for r in merged.collect()} == {"ANN", "BOB"} and merged.filter("entity = 77").count() == 1
    target = ObjectType("p", (Attribute("name"),), "name")
    maps = [outbound.ExportMapping("name", Attribute("name"))]
    assert pipeline.outbound(first.merged, merged, target, maps).count() == 0
    again = pipeline.full_run({1: people}, {1: people}, known, [rule], person, T0)
    assert {r["change"] for r in again.changes.collect()} == {"none"}
    assert pipeline.preview(first, again).count() == 0


def test_rest_filters(spark):
    df = frame(spark, [(1, "Ann", True, "0f8fad5b-d9cb-469f-a165-70867728950e"), (2, "bob", False, "x")], "n int, name string, on boolean, g string")
    n = lambda t: query.rest_filter(df, t).count()
    assert [n(x) for x in ("NAME:eq:Ann", "name:contains:b", "n:gte:2", "on:eq:TRUE", "g:eq:0F8FAD5B-D9CB-469F-A165-70867728950E")] == [1] * 5
    assert [n(x) for x in (None, "", "x", "no:eq:1", "n:eq:z", "on:gt:true", "name:like:a", "n:contains:1")] == [2] * 8
    assert query.page_range(df.orderBy("n"), -3, 1, True)[1] == 2 and query.page_range(df, 9, 5)[0].count() == 0


def test_batches_are_packed(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), i // 150, r.choice([None, 0, 10, 90, 260, 300, 300, 499, 500, 501, 2000])) for i in range(900)] + [(900 + i, "six", 0, 300) for i in range(6)]
    found = {x["id"]: x["batch"] for x in outbound.size_batches(frame(spark, rows, "id int, system string, part int, n int").repartition(5), "id", "n", 500, 7, ["system", "part"]).collect()}
    assert len(found) == len(rows)
    for key in {x[1:3] for x in rows}:
        batch, n, held = 0, 0, 0
        for i, *_, size in sorted(x for x in rows if x[1:3] == key):
            if (size or 0) > 500:
                assert found[i] is None
                continue
            if n and (n == 7 or held + (size or 0) > 500):
                batch, n, held = batch + 1, 0, 0
            n, held = n + 1, held + (size or 0)
            assert found[i] == batch
    assert outbound.size_batches(frame(spark, rows, "id int, system string, part int, n int").limit(0), "id", "n", 500, 7, ["system"]).count() == 0


def test_optimistic_values_are_those_of_the_fold(spark):
    import random

    r = random.Random(5)
    sent = [(r.randrange(6), r.choice(["update", "update", "delete"]), r.choice("pq"), r.choice(["add", "add", "remove", "update", "remove_all"]), r.choice(["a", "b", "c", None]), i) for i in range(200)]
    held = [(k, a, v) for k in range(8) for a in "pq" for v in "ad"]
    changes = frame(spark, sent, "id int, change string, attr string, op string, value string, seq int")
    actual = frame(spark, held, "id int, attr string, value string")
    folded = changes.filter("change <> 'delete'").groupBy("id", "attr").agg(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "op", "value")).alias("c"))
    before = actual.groupBy("id", "attr").agg(F.collect_set("value").alias("v"))
    want = folded.join(before, ["id", "attr"], "left").select("id", "attr", F.sort_array(confirm.apply_changes(F.col("v"), F.col("c"))).alias("values"))
    assert got(confirm.optimistic(actual, changes, "id"), "id", "attr") == got(want, "id", "attr")


def test_optimistic_values_of_a_very_large_group(spark):
    held = spark.range(100_000).select(F.lit(1).alias("id"), F.lit("member").alias("attr"), F.concat(F.lit("m"), F.col("id")).alias("value"))
    sent = spark.range(60_000, 160_000).select(F.lit(1).alias("id"), F.lit("update").alias("change"), F.lit("member").alias("attr"), F.when(F.col("id") < 100_000, "remove").otherwise("add").alias("op"), F.concat(F.lit("m"), F.col("id")).alias("value"), F.col("id").alias("seq"))
    found = confirm.optimistic_values(held, sent, "id")
    assert found.count() == 120_000 and found.filter("substr(value, 2)::int between 60000 and 99999").isEmpty()


def test_generated_keys_over_ranges(spark):
    from rillstone.sources import files

    rows = spark.range(500).select(F.lit(None).cast("long").alias("id"), F.lit("insert").alias("op"), F.md5(F.col("id").cast("string")).alias("name"))
    table = frame(spark, [(7, "x")], "id long, name string")
    after, keys = files.apply_dml(table, rows, "id", generated="name")
    new = sorted((r["name"], r["id"]) for r in keys.collect())
    assert [k for _, k in new] == [*range(8, 508)] and after.count() == 501
    assert [n for n, _ in new] == sorted(n for n, _ in new)  # in the order of the column, whatever ranges were numbered apart


def test_ancestors_go_no_further_than_asked(spark):
    line = spark.range(70).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    for depth in (0, 1, 5, 50, 64):
        assert all(r["root"] == max(0, r["node"] - depth) for r in query.ancestors(line, "n", "p", depth).collect())


def test_causal_chain_beyond_its_depth_is_an_error(spark):
    line = frame(spark, [(i, i - 1) for i in range(1, 6)], "effect int, cause int")
    start = frame(spark, [(5,)], "id int")
    assert summarise.causal_chain(line, start, 5).count() == 6
    with pytest.raises(ValueError, match="steps"):
        summarise.causal_chain(line, start, 4)
