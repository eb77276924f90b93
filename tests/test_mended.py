"""Cases that once gave wrong answers: merged changes, cleared values in files, and expressions that can't be computed."""

import pytest
from pyspark.sql import functions as F

from rillstone.functions.expressions import attributes_of, coerced, compile_expression, with_missing_inputs
from rillstone.operators import match, outbound
from rillstone.plans import pipeline
from rillstone.schema import Attribute, Kind, ObjectType
from rillstone.sources import files

CHANGES = "id int, attr string, many boolean, op string, value string, reference string, seq int, drift boolean"


@pytest.mark.parametrize(
    "rows, want",
    [
        # a drift replacement after a current change of a list: both stay
        ([("a", "add", "x", 5, False), ("a", "replace", "z", 9, True)], {("add", "x"), ("replace", "z")}),
        ([("a", "add", "x", 5, False), ("a", "remove_all", None, 9, True)], {("add", "x"), ("remove_all", None)}),
        # among drift the later replacement supersedes
        ([("a", "add", "x", 5, True), ("a", "replace", "z", 9, True)], {("replace", "z")}),
        ([("a", "add", "x", 10, True), ("a", "replace", "z", 9, True)], {("add", "x"), ("replace", "z")}),
        # a current replacement supersedes all of drift, whatever its age, and what is current and older
        ([("a", "replace", "z", 1, False), ("a", "add", "x", 5, True), ("a", "remove", "y", 7, False)], {("replace", "z"), ("remove", "y")}),
        ([("a", "add", "x", 1, False), ("a", "replace", "z", 2, False)], {("replace", "z")}),
        # another attribute isn't touched
        ([("a", "replace", "z", 9, False), ("b", "add", "x", 1, True)], {("replace", "z"), ("add", "x")}),
    ],
)
def test_whole_changes_and_drift(spark, rows, want):
    c = spark.createDataFrame([(1, a, True, op, v, None, n, drift) for a, op, v, n, drift in rows], CHANGES)
    assert {(r["op"], r["value"]) for r in outbound.merge_changes(c, "id").collect()} == want


def test_an_update_clears_what_it_names(spark):
    have = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "k int, x string, y string")
    changes = spark.createDataFrame([(1, "update", ["x"], None, None, "new"), (2, "delete", [], None, None, None), (4, "create", ["x"], "g", None, None)], "k int, change string, changed array<string>, x string, y string, z string")
    assert sorted(map(tuple, files.merged_state(have, changes, "k").collect())) == [(1, None, "b", "new"), (3, "e", "f", None), (4, "g", None, None)]
    kept = files.merged_state(have, changes.drop("changed"), "k")  # without the marker null keeps
    assert sorted(map(tuple, kept.collect()))[0] == (1, "a", "b", "new")


def test_a_cleared_value_reaches_the_file(spark, tmp_path):
    a = [Attribute("mail"), Attribute("tags", many=True)]
    want = spark.createDataFrame([(1, None, ["p"]), (2, "b@x", []), (3, "c@x", ["q", "r"])], "k int, mail string, tags array<string>")
    have = spark.createDataFrame([(1, "a@x", ["p", "o"]), (2, "b@x", ["s"])], want.schema)
    delta = outbound.outbound_delta(want, have, "k", [outbound.ExportMapping(x.name, x, x.many) for x in a])
    delta = delta.union(spark.createDataFrame([(9, "delete", None, None, None)], delta.schema))
    have = have.union(spark.createDataFrame([(9, "gone@x", None)], have.schema))
    files.write_full_state(have, files.as_state_changes(delta, have, "k", a), "k", str(tmp_path / "f"))
    back = files.read_text(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.collect())) == [("1", None, "p"), ("2", "b@x", None), ("3", "c@x", "q|r")]


def test_remove_all_then_add(spark):
    have = spark.createDataFrame([(1, ["a", "b"])], "k int, tags array<string>")
    delta = spark.createDataFrame([(1, "update", "tags", "remove_all", None), (1, "update", "tags", "add", "c")], "k int, change string, attr string, op string, value string")
    [r] = files.as_state_changes(delta, have, "k", [Attribute("tags", many=True)]).collect()
    assert (r["changed"], r["tags"]) == (["tags"], ["c"])


BIG = 9223372036854775807


@pytest.mark.parametrize(
    "text, value, error",
    [
        ("9007199254740993 / 1", 9007199254740993, None),
        ("cs[\"B\"] / 1", BIG, None),
        ("cs[\"B\"] / -1", -BIG, None),
        ("(-cs[\"B\"] - 1) / -1", None, "out of range"),
        ("(-7) / 2", -3, None),
        ("cs[\"B\"] + 1", None, "out of range"),
        ("2147483647 + 1", None, "out of range"),
        ("cs[\"B\"] * 2 - 1", None, "out of range"),
        ("-(-cs[\"B\"] - 1)", None, "out of range"),
        ("cs[\"N\"] / 0", None, "division by zero"),
        ("cs[\"N\"] % 0", None, "division by zero"),
        ("cs[\"D\"] / 0", None, "division by zero"),
        ("cs[\"Nothing\"] / 0", None, None),
        ("cs[\"Nothing\"] + cs[\"B\"]", None, None),
        ("cs[\"N\"] > 0 ? 5 : 1 / 0", 5, None),
        ("cs[\"N\"] < 0 ? 5 : 1 / 0", None, "division by zero"),
        ("cs[\"N\"] > 0 || 1 / 0 > 1", True, None),
        ("cs[\"N\"] < 0 && 1 / 0 > 1", False, None),
        ("cs[\"N\"] < 0 || 1 / 0 > 1", None, "division by zero"),
        ("IIF(cs[\"N\"] > 0, 5, 1 / 0)", None, "division by zero"),  # arguments of calls are all computed
        ("\"x\" + (1 / 0)", None, "division by zero"),
        ("Substring(\"abc\", 2147483647, 5)", "", None),
        ("Substring(\"abc\", 1, 2147483647)", "bc", None),
    ],
)
def test_errors_of_a_row(spark, text, value, error):
    row = spark.sql(f"SELECT {BIG}L AS B, 7 AS N, CAST(2.5 AS DECIMAL(38,10)) AS D, CAST(NULL AS BIGINT) AS Nothing")
    x = compile_expression(text, cs=attributes_of({"B": Kind.LONG, "N": Kind.NUMBER, "D": Kind.DECIMAL, "Nothing": Kind.LONG}))
    assert tuple(row.select(x.column.alias("v"), x.errors.alias("e")).first()) == (value, error)


def test_one_bad_row_stops_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (2, BIG), (3, None)], "id long, n long")
    known = attributes_of({"n": Kind.LONG})
    value, error = coerced(compile_expression('cs["n"] + 1', cs=known), Kind.NUMBER)
    assert [tuple(r) for r in rows.orderBy("id").select(value.alias("v"), error.alias("e")).collect()] == [(2, None), (None, "out of range"), (None, None)]
    x = compile_expression('1 / (cs["n"] - cs["n"])', cs=known)
    x.column, gone = with_missing_inputs(x, {}, known, "cs", "no_value")
    value, error = coerced(x, Kind.NUMBER)  # what isn't evaluated has no error
    got = [tuple(r) for r in rows.orderBy("id").select(value.alias("v"), F.coalesce(gone, error).alias("e")).collect()]
    assert got == [(None, "division by zero"), (None, "division by zero"), (None, None)]


def test_an_error_gives_no_contribution(spark):
    """The object's other values flow; the attribute whose expression failed keeps what other systems give."""
    rows = spark.createDataFrame([(1, "a", 4), (2, "b", 0)], "id long, name string, n int")
    t = ObjectType("t", (Attribute("id", Kind.LONG), Attribute("name"), Attribute("n", Kind.NUMBER)), "id")
    flows = (pipeline.Flow(1, "name", "name"), pipeline.Flow(2, "share", expression='8 / cs["n"]'))
    rule = pipeline.ImportRule(1, t, flows, (match.MatchRule(1, "name", "name"),))
    known = spark.createDataFrame([], "entity long, name string")
    run = pipeline.full_run({1: rows}, {1: rows}, known, [rule], ObjectType("p", (Attribute("name"), Attribute("share", Kind.NUMBER)), "name"), __import__("datetime").datetime(2024, 1, 1))
    of = {r["entity"]: r["external_id"] for r in run.outcomes.collect()}
    assert {(of[r["entity"]], r["attr"]): r["value"] for r in run.merged.filter("outcome = 'value'").collect()} == {("1", "name"): "a", ("1", "share"): "2", ("2", "name"): "b"}
    assert [(of[r["entity"]], r["attr"], r["error"]) for r in run.errors.collect()] == [("2", "share", "division by zero")]
