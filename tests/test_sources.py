from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillstone.schema import Attribute, Kind, ObjectType
from rillstone.sources import files, relational, rest
from rillstone.streaming import changes

PERSON = ObjectType(
    "person",
    (Attribute("Id", Kind.NUMBER), Attribute("name"), Attribute("pay", Kind.DECIMAL), Attribute("on", Kind.BOOLEAN), Attribute("tags", Kind.NUMBER, many=True), Attribute("at", Kind.DATETIME)),
    "Id",
)


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,NAME,pay,on,tags,at,more\n1,"Ann ""A"", x",1.5E2,TRUE,1| 2 ||2,2024-01-02T03:04:05Z,q\n2,,x,,,,\n3,Bob,2,maybe,1|z,never,\n')
    return str(p)


def test_csv(spark, csv):
    raw = files.read_text(spark, csv)
    ok, bad = files.import_file(raw, PERSON)
    r = ok.first()
    assert (r["Id"], r["name"], r["pay"], r["on"], r["tags"], r["at"]) == (1, 'Ann "A", x', Decimal("150.0000000000"), True, [1, 2], datetime(2024, 1, 2, 3, 4, 5))
    assert {b["Id"]: len(b["errors"]) for b in bad.collect()} == {2: 1, 3: 3}
    with pytest.raises(ValueError, match="stopped"):
        files.import_file(raw, PERSON, stop_on_first=True)


def test_inference(spark):
    df = spark.createDataFrame([("1", "5000000000", "1e3", "true", "0f8fad5b-d9cb-469f-a165-70867728950e", "2024-01-02", "x", "")], "a string, b string, c string, d string, e string, f string, g string, h string")
    assert [a.kind.name for a in files.infer(df)] == ["NUMBER", "LONG", "DECIMAL", "BOOLEAN", "GUID", "DATETIME", "TEXT", "TEXT"]


def test_routing(spark):
    df = spark.createDataFrame([("User", 1), ("GROUP", 2), ("other", 3), (None, 4)], "type string, n int")
    routed, unknown = files.route_types(df, [ObjectType("user", (), "n"), ObjectType("group", (), "n")], {"user"}, "type")
    assert [r["n"] for r in routed["user"].collect()] == [1] and sorted(r["n"] for r in unknown.collect()) == [3, 4]


def test_full_state_file(spark, tmp_path):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")], "k string, n string, o string")
    new = spark.createDataFrame([("1", "A", ["p", "q"], "update"), ("2", None, None, "delete"), ("4", "d", ["r"], "create")], "k string, n string, m array<string>, change string")
    files.write_full_state(old, new.withColumn("m", F.array_join("m", "|")), "k", str(tmp_path / "out"))
    rows = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("1", "A", "x", "p|q"), ("3", "c", "z", None), ("4", "d", None, "r")]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, n string")
    c = spark.createDataFrame([(None, "insert", "n2"), (None, "insert", "n1"), (1, "update", "A"), (2, "delete", None)], "k int, op string, n string")
    after, keys = files.apply_dml(t, c, "k", generated="n")
    assert sorted(map(tuple, after.collect())) == [(1, "A"), (3, "c"), (4, "n1"), (5, "n2")] and keys.count() == 2


@pytest.mark.parametrize("value", [7, Decimal("1.50"), datetime(2024, 1, 2, 3), b"\x01\xff", "x"])
def test_watermark_values(value):
    assert relational.watermark_value(*relational.watermark_text(value)) == value


def test_watermarks():
    for bad in (True, None, 1.5, []):
        with pytest.raises(ValueError):
            relational.watermark_text(bad)
    w = relational.Watermarks("column", {"t": ("1", "long")}, {"c": ("2", "long")}, "dc1")
    assert relational.Watermarks.loads(w.dumps(), "column", "dc1") == w
    assert all(relational.Watermarks.loads(*x) is None for x in ((w.dumps(), "log", "dc1"), (w.dumps(), "column", "dc2"), ("{", "column", "dc1"), (None, "column", None)))


def test_change_log(spark):
    log = spark.createDataFrame([(1, 1, "I"), (2, 1, "D"), (3, 2, "I"), (4, 3, "U"), (5, 4, "D"), (6, 4, "I"), (0, 5, "U")], "seq int, k int, kind string")
    now = spark.createDataFrame([(2, None), (4, "d"), (5, "e")], "k int, n string")
    rows = relational.change_log(log, now, "k", "seq", "kind", 0).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "delete", None), (2, "upsert", None), (4, "upsert", "d")]


def test_related_without_mark_brings_all_parents(spark):
    p = spark.createDataFrame([(1, 1), (2, 9), (3, 1)], "k int, at int")
    c = spark.createDataFrame([(3, 0)], "fk int, at int")
    assert sorted(r["k"] for r in relational.changed_with_related(p, "k", ("at", 5), [(c, "fk", "at", None)]).collect()) == [2, 3]
    assert relational.changed_with_related(p, "k", ("at", None), []).count() == 3


PAGES = {"users": [{"id": i, "n": i * i} for i in range(7)], "groups": []}


def fetch(kind, q):
    start = int(q.get("startIndex", "1"))
    return {"rows": PAGES[kind][start - 1 : start - 1 + int(q["count"])], "total": len(PAGES[kind])}


def send(batch):
    assert len(batch) <= 2


def test_paged_source(spark):
    spark.dataSource.register(rest.PagedSource)
    df = spark.read.format("paged").options(fetch=f"{__name__}:fetch", kinds="users,groups", count="3").load()
    assert sorted(r["id"] for r in df.collect()) == [str(i) for i in range(7)]
    df.write.format("paged").options(send=f"{__name__}:send", max_operations="2").mode("append").save()
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert rest.delta_query(rest.next_mark(now), True) == 'meta.lastModified gt "2023-12-31T23:59:00Z"' and rest.delta_query(now, False) is None
    assert rest.page_query(None, 5, "c", "f", ("a", "b")) == {"count": "5", "cursor": "c", "filter": "f", "excludedAttributes": "a,b"}


def test_stream_of_changes(spark, tmp_path):
    schema = "k int, seq int, kind string, n string"
    make = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = changes.VersionedTable(spark, str(tmp_path / "table"), schema)

    def run():
        q = changes.stream_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, "k", "seq", "kind", str(tmp_path / "cp"))
        q.awaitTermination()
        return q

    make([(1, 1, "I", "a"), (1, 2, "U", "b"), (2, 3, "I", "c")], 0)
    run()
    assert sorted(map(tuple, table.read(0).collect())) == [(1, 2, "U", "b"), (2, 3, "I", "c")]
    make([(1, 4, "D", None), (2, 1, "U", "late"), (3, 5, "I", "e")], 1)
    run()
    assert sorted(map(tuple, table.read(1).collect())) == [(2, 3, "I", "c"), (3, 5, "I", "e")]
    make([(4, 6, "I", "f")], 2)
    run()
    assert table.read(2).count() == 3 and sorted(p.name for p in (tmp_path / "table").iterdir()) == ["v=1", "v=2"]


def test_schedules_that_are_due(spark):
    rows = spark.createDataFrame([(1, True, datetime(2024, 1, 1)), (2, True, datetime(2024, 1, 3)), (3, False, datetime(2024, 1, 1)), (4, True, None)], "id int, enabled boolean, next_run timestamp")
    assert [(r["id"], r["late"]) for r in changes.due_now(rows, datetime(2024, 1, 2)).collect()] == [(1, 86_400)]


def test_delta_run(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "at int")
    seen = []
    assert changes.delta_run(df, "at", 1, lambda x: seen.append(x.count())) == 5 and seen == [2]
    assert changes.delta_run(df, "at", 5, lambda x: seen.append(x.count())) == 5 and seen == [2, 0]
    assert changes.delta_run(df, "at", 1, lambda x: None, lambda: True) == 1
