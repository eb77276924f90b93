"""Planned paging with pushed filters, a sink whose tasks may be run again, and change hints."""

import json
import os
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rillstone.session import scratch
from rillstone.sources import rest
from rillstone.streaming import hints

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def server(log, n=1000, total=True, most=10**6, cursor=False):
    """A transport with n users and one group; each request is a line of the log."""

    def fetch(kind, q):
        with open(log, "a") as f:
            f.write(json.dumps([kind, q]) + "\n")
        rows = [{"id": i, "name": f"n{i}", "secret": "s", "meta": {"lastModified": (T0 + timedelta(seconds=i, milliseconds=500)).isoformat()}} for i in range(n)] if kind == "users" else [{"id": "g", "name": "all"}]
        if "filter" in q:
            since = datetime.fromisoformat(q["filter"].split('"')[1].replace("Z", "+00:00"))
            rows = [r for r in rows if "meta" in r and datetime.fromisoformat(r["meta"]["lastModified"]) >= since]
        if "attributes" in q:
            rows = [{k: v for k, v in r.items() if k in ("id", "meta", *q["attributes"].split(","))} for r in rows]
        first = int(q["cursor"]) if "cursor" in q else int(q.get("startIndex", "1")) - 1
        page = rows[first : first + min(int(q["count"]), most)]
        more = str(first + len(page)) if first + len(page) < len(rows) else None
        return {"rows": page} | ({"total": len(rows)} if total else {}) | ({"next": more} if cursor else {})

    return fetch


def asked(log):
    return [json.loads(x) for x in open(log)]


@pytest.fixture()
def log(tmp_path):
    return str(tmp_path / "log")


def read(spark, fetch, schema="kind string, id string, last_modified timestamp, name string", **options):
    form = rest.paged_source(spark, fetch=fetch)
    return spark.read.format(form).schema(schema).options(**{"kinds": "users,groups", "count": "40", "partition_rows": "100", "supports_filter": "true"} | options).load()


def test_a_range_of_pages_is_a_partition(spark, log):
    df = read(spark, server(log, 250))
    assert df.rdd.getNumPartitions() == 4  # three of users, one of groups
    rows = df.collect()
    assert sorted(int(r["id"]) for r in rows if r["kind"] == "users") == list(range(250)) and len(rows) == 251
    starts = Counter(q["startIndex"] for kind, q in asked(log) if kind == "users" and q["count"] != "1")
    assert {"1", "41", "81", "101", "141", "181", "201", "241"} <= set(starts)


def test_a_server_with_smaller_pages_loses_nothing(spark, log):
    assert read(spark, server(log, 230, most=7)).filter("kind = 'users'").count() == 230


@pytest.mark.parametrize("n", [0, 1, 40, 81])
def test_without_a_total_pages_are_read_until_an_empty_one(spark, log, n):
    df = read(spark, server(log, n, total=False))
    assert df.rdd.getNumPartitions() == 2 and df.filter("kind = 'users'").count() == n


def test_cursors(spark, log):
    df = read(spark, server(log, 130, cursor=True), paging="cursor")
    assert sorted(int(r["id"]) for r in df.filter("kind = 'users'").collect()) == list(range(130))
    assert not any("startIndex" in q for _, q in asked(log))


def test_filters_reach_the_requests_and_the_plan(spark, log):
    df = read(spark, server(log)).filter((F.col("kind") == "users") & (F.col("last_modified") > F.lit(T0 + timedelta(seconds=700, milliseconds=500))) & (F.col("name") != "n800"))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(last_modified" in plan and "EqualTo(kind,users)" in plan and df.rdd.getNumPartitions() == 3
    assert sorted(int(r["id"]) for r in df.collect()) == [*range(701, 800), *range(801, 1000)]  # 700 is the bound itself
    assert {q["filter"] for _, q in asked(log)} == {'meta.lastModified ge "2024-01-01T00:11:40Z"'} and {k for k, _ in asked(log)} == {"users"}


def test_a_server_without_filters_is_filtered_here(spark, log):
    df = read(spark, server(log), supports_filter="false").filter(F.col("last_modified") >= F.lit(T0 + timedelta(seconds=990)))
    assert df.count() == 10 and not any("filter" in q for _, q in asked(log))


def test_only_the_schemas_attributes_are_asked_for(spark, log):
    rows = read(spark, server(log, 3), schema="id string, name string").collect()
    assert sorted(map(tuple, rows)) == [("0", "n0"), ("1", "n1"), ("2", "n2"), ("g", "all")]
    assert {q["attributes"] for _, q in asked(log)} == {"name"}
    [r] = read(spark, server(log, 1), kinds="users", schema="body string").collect()
    assert json.loads(r["body"])["secret"] == "s"


def test_too_many_pages_are_an_error(spark, log, monkeypatch):
    monkeypatch.setattr(rest, "MOST_PAGES", 3)
    with pytest.raises(Exception, match="more than 3 pages"):
        read(spark, server(log, 250)).collect()


# --- requests ---


def box(folder, break_after=None):
    """A transport that keeps what it gets; break_after: it fails once it has that many requests, unless mended."""

    def send(key, operations):
        have = os.listdir(folder)
        if break_after is not None and len(have) >= break_after and not os.path.exists(f"{folder}.mended"):
            raise ConnectionError("the target is gone")
        with open(f"{folder}/{len(have)}-{os.urandom(4).hex()}", "w") as f:
            json.dump([key, operations], f)

    return send


def received(folder):
    return [json.load(open(f"{folder}/{x}")) for x in os.listdir(folder)]


def operations(spark, n=100, parts=3):
    return spark.range(n).select(F.lit("user").alias("kind"), F.col("id").cast("string").alias("id"), F.concat(F.lit("body "), "id").alias("body")).repartition(parts)


@pytest.mark.parametrize("broken", [1, 4])
def test_a_run_that_breaks_off_sends_each_operation_once(spark, tmp_path, broken):
    folder, ledger = str(tmp_path / "box"), str(tmp_path / "ledger")
    os.mkdir(folder)
    form = rest.paged_source(spark, send=box(folder, broken))
    with pytest.raises(Exception, match="the target is gone"):
        rest.send_all(operations(spark), form, "r1", ledger, 2, max_operations="10")
    assert 0 < sum(len(ops) for _, ops in received(folder)) < 100
    open(f"{folder}.mended", "w").close()
    # the rows come in other partitions, and in another order: requests are the same
    rest.send_all(operations(spark, parts=7), form, "r1", ledger, 2, max_operations="10")
    got = Counter(op[1] for _, ops in received(folder) for op in ops)
    assert got == Counter(str(i) for i in range(100))
    rest.send_all(operations(spark), form, "r1", ledger, 2, max_operations="10")  # it is done
    assert sum(len(ops) for _, ops in received(folder)) == 100
    noted = json.load(open(f"{ledger}/r1/committed"))
    assert noted["sent"] + noted["skipped"] == 100 and noted["skipped"] > 0
    rest.send_all(operations(spark), form, "r2", ledger, 2, max_operations="10")  # another run sends again
    assert sum(len(ops) for _, ops in received(folder)) == 200


def test_a_request_that_went_out_unnoted_has_the_same_key(spark, tmp_path, monkeypatch):
    """The task is lost between the request and its note: the request comes twice, under one key."""
    folder, ledger = str(tmp_path / "box"), str(tmp_path / "ledger")
    os.mkdir(folder)
    writer = lambda: rest.BatchWriter(box(folder), {"run": "r", "ledger": ledger, "max_operations": "2"})
    rows = [{"kind": "u", "id": str(i), "body": "b"} for i in range(5)]
    first = writer()
    monkeypatch.setattr(rest.Ledger, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        first.write(iter(rows))
    monkeypatch.undo()
    sent = writer().write(iter(rows))
    keys = Counter(key for key, _ in received(folder))
    assert (sent.sent, sent.requests) == (5, 3) and sorted(keys.values()) == [1, 1, 2]
    assert writer().write(iter(rows)).skipped == 5


def test_operations_that_are_too_large_are_refused(spark, tmp_path):
    folder, ledger = str(tmp_path / "box"), str(tmp_path / "ledger")
    os.mkdir(folder)
    form = rest.paged_source(spark, send=box(folder))
    rows = operations(spark, 10).union(spark.createDataFrame([("user", "large", "é" * 60), ("user", "none", None)], "kind string, id string, body string"))
    rest.send_all(rows, form, "r", ledger, 1, max_bytes="100")
    assert {op[1] for _, ops in received(folder) for op in ops} == {*map(str, range(10)), "none"}
    assert all(sum(len((op[2] or "").encode()) for op in ops) <= 100 for _, ops in received(folder))
    assert json.load(open(f"{ledger}/r/committed"))["refused"] == 1


def test_without_a_ledger_it_sends(spark, tmp_path):
    folder = str(tmp_path / "box")
    os.mkdir(folder)
    form = rest.paged_source(spark, send=box(folder))
    operations(spark, 25, 1).write.format(form).options(max_operations="10").mode("append").save()
    assert sorted(len(ops) for _, ops in received(folder)) == [5, 10, 10]


# --- hints ---


class Numbers:
    """Hints from a list of ids; forget notes how far it is done."""

    def __init__(self, ids, path):
        self.all, self.path = ids, path

    def latest(self):
        return len(self.all)

    def ids(self, first, last):
        yield from ((n, self.all[n - 1]) for n in range(first, last + 1) if self.all[n - 1] is not None)

    def forget(self, upto):
        with open(self.path, "a") as f:
            f.write(f"{upto}\n")


SCHEMA = "id long, version long, name string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(looked):
    return sorted(map(tuple, looked.state("id").select("id", "version", "name").collect()))


def test_hints_lost_and_repeated(spark, tmp_path):
    looked, cp, forgot = hints.Looked(spark, str(tmp_path / "l"), SCHEMA), str(tmp_path / "cp"), str(tmp_path / "f")
    one = [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]
    hints.follow(hints.hint_stream(spark, Numbers([1, 2, 2, 1], forgot)), lambda: table(spark, one), "id", looked, cp, 0)
    assert state(looked) == one[:2]  # 3 was never hinted
    mark = hints.sweep(table(spark, one), "id", "version", None, looked, 0)
    assert state(looked) == one and mark == 3
    # 1 changes without a hint, 2 goes with one, 3 goes without, 4 is new, and 9 was never there
    two = [(1, 5, "A"), (4, 4, "d")]
    hints.follow(hints.hint_stream(spark, Numbers([1, 2, 2, 1, 2, 4, 9, None, 4], forgot)), lambda: table(spark, two), "id", looked, cp, 1)
    assert state(looked) == [(1, 1, "a"), (3, 3, "c"), (4, 4, "d")]
    mark = hints.sweep(table(spark, two), "id", "version", mark, looked, 1)
    assert state(looked) == [(1, 5, "A"), (4, 4, "d")] and mark == 5
    # nothing new: nothing changes, though all is looked at again
    hints.follow(hints.hint_stream(spark, Numbers([1, 2, 2, 1, 2, 4, 9, None, 4], forgot)), lambda: table(spark, two), "id", looked, cp, 2)
    assert hints.sweep(table(spark, two), "id", "version", mark, looked, 2) == 5
    assert state(looked) == [(1, 5, "A"), (4, 4, "d")]
    assert int(open(forgot).read().split()[-1]) >= 4


def test_hints_are_read_in_ranges(spark, tmp_path):
    reader = hints.HintReader(Numbers(list(range(25)), ""), {"partition_hints": "10"})
    spans = reader.partitions({"seq": 3}, reader.latestOffset())
    assert [(s.first, s.last) for s in spans] == [(4, 13), (14, 23), (24, 25)]
    assert [i for s in spans for _, i in reader.read(s)] == list(range(3, 25))
    assert reader.partitions({"seq": 25}, {"seq": 25}) == [] and reader.initialOffset() == {"seq": 0}


def test_a_batch_that_is_done_again_overwrites(spark, tmp_path):
    looked = hints.Looked(spark, str(tmp_path / "l"), SCHEMA)
    rows = table(spark, [(1, 1, "a")])
    for _ in range(2):
        looked.add(hints.named(spark.createDataFrame([(1, 1), (2, 7)], "seq long, id long"), rows, "id"), 5)
    assert state(looked) == [(1, 1, "a")]


def test_a_sweep_reads_above_its_mark(spark, tmp_path):
    table(spark, [(i, i, "x") for i in range(100)]).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = hints.newer(t, "id", "version", 90, t.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(version,90)" in plan
