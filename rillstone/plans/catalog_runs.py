"""Registered queries of whole runs, beside those of the catalogue."""

from __future__ import annotations

import json
import uuid
import zipfile
from datetime import datetime, timedelta, timezone
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.expressions import attributes_of, coerced, compile_expression
from rillstone.operators import criteria, diff, lifecycle, match, outbound, page_index, recall, summarise, ticks
from rillstone.operators.criteria import Criterion, Group, Relative
from rillstone.plans import pipeline
from rillstone.plans.catalog import CHANGED, CUSTOMER, MAPPINGS, NOW, ORDER, QUERIES, SQL, query_for, snapshots, table, target_rows
from rillstone.schema import Attribute, Kind, ObjectType
from rillstone.session import scratch, stored
from rillstone.sources import files, relational, rest, staging
from rillstone.streaming import changes, confirmation, hints

__all__ = ["QUERIES", "SQL"]

# --- matching within a run --------------------------------------------------------------------------------------

PERSON = ObjectType("person", (Attribute("id", Kind.LONG), Attribute("badge"), Attribute("mails", many=True), Attribute("mail")), "id")


@query_for("""WITH RECURSIVE obj AS (SELECT row_number() OVER (ORDER BY sys, id) AS i, * FROM (
        SELECT 1 AS sys, c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN 'b' || c_custkey % 900 END AS badge, ['m' || c_custkey % 331, 'm' || c_custkey * 7 % 577] AS mails FROM customer
        UNION ALL SELECT 2, s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'b' || s_suppkey * 7 % 1200 END, ['m' || s_suppkey * 5 % 331, 'm' || s_nationkey] FROM supplier)),
    known AS (SELECT p_partkey AS entity, 'b' || p_partkey AS badge, 'm' || (p_partkey % 400) AS mail FROM part WHERE p_partkey % 17 = 0),
    hits AS (SELECT i, count(DISTINCT k.entity) FILTER (WHERE k.badge = o.badge) AS n1, min(k.entity) FILTER (WHERE k.badge = o.badge) AS e1,
        count(DISTINCT k.entity) FILTER (WHERE list_contains(mails, k.mail)) AS n2, min(k.entity) FILTER (WHERE list_contains(mails, k.mail)) AS e2 FROM obj o LEFT JOIN known k ON k.badge = o.badge OR list_contains(mails, k.mail) GROUP BY i),
    step AS (SELECT 0::BIGINT AS i, []::STRUCT(i BIGINT, badge VARCHAR, mail VARCHAR)[] AS made, NULL::BIGINT AS n, NULL::INT AS rule, NULL::VARCHAR AS target
        UNION ALL SELECT i, CASE WHEN n = 0 THEN list_append(made, {'i': i, 'badge': badge, 'mail': mails[1]}) ELSE made END, n, rule, CASE WHEN n = 0 THEN 'object ' || i WHEN n = 1 THEN target END FROM (
            SELECT *, CASE WHEN n1 + len(b) > 0 THEN n1 + len(b) ELSE n2 + len(m) END AS n, CASE WHEN n1 + len(b) > 0 THEN 1 WHEN n2 + len(m) > 0 THEN 2 END AS rule,
                CASE WHEN n1 + len(b) > 0 THEN CASE WHEN n1 > 0 THEN 'part ' || e1 ELSE 'object ' || b[1].i END ELSE CASE WHEN n2 > 0 THEN 'part ' || e2 ELSE 'object ' || m[1].i END END AS target FROM (
                SELECT o.*, h.* EXCLUDE (i), s.made, list_filter(s.made, lambda x: x.badge = o.badge) AS b, list_filter(s.made, lambda x: list_contains(o.mails, x.mail)) AS m
                FROM step s JOIN obj o ON o.i = s.i + 1 JOIN hits h ON h.i = o.i))),
    claims AS (SELECT step.*, sys, id, row_number() OVER (PARTITION BY sys, target ORDER BY step.i) AS k FROM step JOIN obj USING (i))
    SELECT sys AS rule, id::VARCHAR AS external_id, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN k > 1 THEN 'already_joined' ELSE 'joined' END AS outcome,
        CASE WHEN n <= 1 AND k = 1 THEN coalesce((SELECT o.sys || ':' || o.id FROM obj o WHERE 'object ' || o.i = target), target) END AS target FROM claims""")
def twins_in_run(spark, d):
    """Customers and suppliers that are new in one run: same persons by badge or else mail meet, in either system or in both."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    mail = lambda x: F.concat(F.lit("m"), x)
    one = table(spark, d, "customer").select(c.alias("id"), F.when(c % 4 > 0, F.concat(F.lit("B"), c % 900)).alias("badge"), F.array(mail(c % 331), mail(c * 7 % 577)).alias("mails"))
    two = table(spark, d, "supplier").select(s.alias("id"), F.when(s % 3 > 0, F.concat(F.lit("b"), s * 7 % 1200)).alias("badge"), F.array(mail(s * 5 % 331), mail(F.col("s_nationkey"))).alias("mails"))
    p = F.col("p_partkey")
    known = table(spark, d, "part").filter(p % 17 == 0).select(p.alias("entity"), F.concat(F.lit("b"), p).alias("badge"), mail(p % 400).alias("mail"))
    systems = {n: x.withColumn("mail", F.col("mails")[0]) for n, x in ((1, one), (2, two))}
    flows = (pipeline.Flow(1, "badge", "badge"), pipeline.Flow(2, "mail", "mail"))
    rules = [pipeline.ImportRule(n, PERSON, flows, (match.MatchRule(1, "badge", "badge"), match.MatchRule(2, "mails", "mail"))) for n in systems]
    found = pipeline.full_run(systems, systems, known, rules, ObjectType("party", (Attribute("badge"), Attribute("mail")), "badge"), NOW).outcomes
    owner = found.filter("outcome = 'none'").select("entity", F.concat_ws(":", "rule", "external_id").alias("target"))
    owner = owner.union(known.select("entity", F.concat(F.lit("part "), "entity")))
    return found.join(owner, "entity", "left").select("rule", "external_id", "outcome", "target")


# --- expressions ------------------------------------------------------------------------------------------------


@query_for("""SELECT p_partkey, CASE WHEN p_partkey < 2 THEN p_partkey * 4611686018427387904 END AS big, CASE WHEN p_partkey >= 2 THEN 'out of range' END AS big_error,
    trunc(1000.0 / nullif(p_size - 10, 0))::INT AS share, CASE WHEN p_size = 10 THEN 'division by zero' END AS share_error,
    9007199254740993 + p_partkey AS exact, CASE WHEN p_size = 10 THEN 0 ELSE 100 % (p_size - 10) END AS lazy, '' AS tail,
    CASE WHEN p_partkey * 2000000 <= 2147483647 THEN (p_partkey * 2000000)::INT END AS narrow, CASE WHEN p_partkey * 2000000 > 2147483647 THEN 'out of range for NUMBER' END AS narrow_error FROM part""")
def expr_errors(spark, d):
    """What can't be computed is an error of its row, with the reason, and stops nothing; whole numbers divide exactly."""
    known = attributes_of({"p_partkey": Kind.LONG, "p_size": Kind.NUMBER, "p_name": Kind.TEXT})
    make = lambda text: compile_expression(text, cs=known)
    big, share, exact = make('cs["p_partkey"] * 4611686018427387904'), make('1000 / (cs["p_size"] - 10)'), make('(9007199254740993 + cs["p_partkey"]) / 1')
    lazy, tail = make('cs["p_size"] == 10 ? 0 : 100 % (cs["p_size"] - 10)'), make('Substring(cs["p_name"], 2147483647, 2147483647)')
    narrow, error = coerced(make('cs["p_partkey"] * 2000000'), Kind.NUMBER)
    return table(spark, d, "part").select(
        "p_partkey", big.column.alias("big"), big.errors.alias("big_error"), share.column.alias("share"), share.errors.alias("share_error"), exact.column.alias("exact"),
        lazy.column.alias("lazy"), tail.column.alias("tail"), narrow.alias("narrow"), error.alias("narrow_error"),
    )


# --- staged tables ----------------------------------------------------------------------------------------------


def staged_customers(spark, d, buckets: int = 16) -> staging.Staging:
    """Customers as a bucketed table of their own, with the ids that they are staged under."""
    at, rows = scratch(spark), snapshots(spark, d)[0].withColumn("id", F.col("c_custkey") * 10)
    return staging.stage(rows, f"staged_{at[-32:]}", f"{at}/staged", ["c_custkey"], buckets)


@query_for(f"""WITH {CHANGED} SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey * 10 AS staged_id, CASE WHEN a.c_custkey IS NULL THEN 'add' WHEN b.c_custkey IS NULL THEN 'delete'
    WHEN a.c_nationkey <> b.c_nationkey OR a.c_mktsegment <> b.c_mktsegment THEN 'update' ELSE 'none' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def staged_import(spark, d):
    """Matches, changes and deletions of an import over a bucketed table."""
    s = staged_customers(spark, d)
    run = staging.imported(spark, s, snapshots(spark, d)[1], list(CUSTOMER.attributes[1:]), "id")
    gone = run.changes.filter("change = 'delete'").join(s.frame(spark).select("c_custkey", F.col("id").alias("staged_id")), "c_custkey")
    came = run.changes.filter("change <> 'delete'").join(run.matched.select("c_custkey", "staged_id"), "c_custkey")
    return came.unionByName(gone).select("c_custkey", "staged_id", "change")


@query_for(f"""WITH {CHANGED}, f AS (SELECT b.*, a.c_custkey * 10 AS id FROM b LEFT JOIN a USING (c_custkey))
    SELECT c_custkey, id, c_name, c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN 'LATE' ELSE c_mktsegment END AS c_mktsegment FROM f WHERE c_custkey % 17 <> 0
    UNION ALL SELECT c_custkey + 5000000, NULL, 'new', 1, 'NEW' FROM f WHERE c_custkey % 19 = 0""")
def staged_generations(spark, d):
    """A full import, then a delta with changes, deletions and new objects: the third generation of a bucketed table."""
    s = staged_customers(spark, d)
    attributes = list(CUSTOMER.attributes[1:])
    full = s.following(1)
    full.write(staging.imported(spark, s, snapshots(spark, d)[1], attributes, "id").after)
    k, now = F.col("c_custkey"), full.frame(spark).drop("id")
    changed = now.filter(k % 13 == 0).withColumn("c_mktsegment", F.lit("LATE")).withColumn("deleted", F.lit(False))
    new = now.filter(k % 19 == 0).withColumns({"c_custkey": k + 5_000_000, "c_name": F.lit("new"), "c_nationkey": F.lit(1), "c_mktsegment": F.lit("NEW"), "deleted": F.lit(False)})
    gone = now.filter(k % 17 == 0).withColumn("deleted", F.lit(True))
    unknown = gone.withColumn("c_custkey", k + 9_000_000)
    delta = changed.filter(k % 17 != 0).unionByName(new).unionByName(gone).unionByName(unknown)
    last = full.following(2)
    last.write(staging.imported(spark, full, delta, attributes, "id", full=False).after)
    return last.frame(spark).select("c_custkey", "id", "c_name", "c_nationkey", "c_mktsegment")


@query_for("""WITH d AS (SELECT c_custkey, 'create' AS change, attr, value FROM (SELECT c_custkey, 'name' AS attr, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer) WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'update', 'segment', c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AND c_mktsegment <> 'OLD'),
    p AS (SELECT user_id, max(event_id) AS pending_id FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT d.*, pending_id FROM d LEFT JOIN p ON user_id = c_custkey""")
def staged_outbound(spark, d):
    """Outbound changes of all entities against a bucketed target, with what is pending for them in a bucketed queue."""
    at = scratch(spark)
    target = staging.stage(target_rows(spark, d), f"target_{at[-32:]}", f"{at}/target", ["c_custkey"], 16)
    e = table(spark, d, "events").filter("event_id % 3 = 0").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("pending_id"))
    pending = staging.stage(e, f"pending_{at[-32:]}", f"{at}/pending", ["c_custkey"], 16)
    delta = outbound.outbound_delta(table(spark, d, "customer"), target.frame(spark), "c_custkey", MAPPINGS)
    return delta.join(pending.frame(spark), "c_custkey", "left").select("c_custkey", "change", "attr", "value", "pending_id")


# --- confirmation over time -------------------------------------------------------------------------------------

POLICY = confirmation.Policy(most_attempts=3, most_errors=2, base_seconds=7200, cap_seconds=86_400, keep_seconds=4 * 86_400)


def export_events(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "click", "sent").when(F.col("event_type") == "error", "error").otherwise("import")
    at = F.timestamp_millis(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    return table(spark, d, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("seq"), at.alias("at"), kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("value"))


CONFIRMED = """WITH RECURSIVE e AS (SELECT user_id AS object, event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'request' WHEN 'click' THEN 'sent' WHEN 'error' THEN 'error' ELSE 'import' END AS kind,
        'v' || event_id % 3 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT object, 0::BIGINT AS k, NULL::VARCHAR AS status, NULL::VARCHAR AS expected, 0 AS attempts, 0 AS errors, false AS sent, NULL::BIGINT AS retry, NULL::BIGINT AS expires,
            []::STRUCT(seq BIGINT, ms BIGINT, kind VARCHAR, status VARCHAR, attempts INT, errors INT)[] AS made FROM e GROUP BY object
        UNION ALL SELECT object, k, CASE WHEN new = 'confirmed' THEN NULL ELSE coalesce(new, status) END, CASE WHEN kind = 'request' THEN value ELSE expected END, attempts, errors, sent,
            CASE WHEN kind = 'error' AND new = 'not_confirmed' THEN ms + least(86400, 7200 * 2 ** (errors - 1))::BIGINT * 1000 WHEN new IS NULL THEN retry END,
            CASE WHEN kind = 'request' THEN ms + 345600000 ELSE expires END,
            CASE WHEN new IS NULL THEN made ELSE list_append(made, {'seq': seq, 'ms': ms, 'kind': kind, 'status': new, 'attempts': attempts, 'errors': errors}) END FROM (
            SELECT * REPLACE (CASE WHEN kind = 'request' THEN 0 WHEN tried THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN kind = 'request' THEN 0 WHEN tried AND kind = 'error' THEN errors + 1 ELSE errors END AS errors,
                    kind <> 'request' AND (sent OR (tried AND kind = 'sent')) AS sent),
                CASE WHEN kind = 'request' THEN 'pending' WHEN looked THEN CASE WHEN value = expected THEN 'confirmed' WHEN attempts >= 3 THEN 'failed' ELSE 'not_confirmed' END
                    WHEN tried THEN CASE WHEN kind = 'sent' THEN 'exported' WHEN errors + 1 >= 2 THEN 'failed' ELSE 'not_confirmed' END END AS new FROM (
                SELECT *, coalesce(status <> 'failed', false) AND kind = 'import' AND sent AS looked, coalesce(status NOT IN ('failed', 'exported'), false) AND kind IN ('sent', 'error') AS tried FROM (
                    SELECT * REPLACE (CASE WHEN status IS NOT NULL AND expires <= ms THEN NULL ELSE status END AS status,
                        CASE WHEN status IS NOT NULL AND expires <= ms THEN list_append(made, {'seq': NULL, 'ms': expires, 'kind': 'expired', 'status': 'expired', 'attempts': attempts, 'errors': errors}) ELSE made END AS made) FROM (
                        SELECT * REPLACE (CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN NULL ELSE retry END AS retry,
                            CASE WHEN again THEN list_append(made, {'seq': NULL, 'ms': retry, 'kind': 'retry', 'status': 'pending', 'attempts': attempts, 'errors': errors}) ELSE made END AS made) FROM (
                            SELECT r.object, e.k, r.* EXCLUDE (object, k), e.seq, e.ms, e.kind, e.value, coalesce(r.status IS NOT NULL AND r.retry <= e.ms AND r.retry < r.expires, false) AS again FROM r JOIN e ON e.object = r.object AND e.k = r.k + 1)))))),
    z AS (SELECT r.*, coalesce(status IS NOT NULL AND retry <= w AND retry < expires, false) AS again, coalesce(status IS NOT NULL AND expires <= w, false) AS ended FROM r, (SELECT max(ms) - 3600000 AS w FROM e) QUALIFY row_number() OVER (PARTITION BY object ORDER BY k DESC) = 1),
    x AS (SELECT object, unnest(made, recursive := true) FROM z UNION ALL SELECT object, NULL, retry, 'retry', 'pending', attempts, errors FROM z WHERE again UNION ALL SELECT object, NULL, expires, 'expired', 'expired', attempts, errors FROM z WHERE ended)
    SELECT object, seq, ms, kind, status, attempts, errors FROM x"""


@query_for(CONFIRMED)
def confirmation_batch(spark, d):
    """Transitions of change sets over time, from the whole table of events."""
    e = export_events(spark, d)
    top = e.agg(F.unix_millis(F.max("at")).alias("top")).first()["top"] or 0
    return confirmation.confirmations_of(e, F.lit(top - 3_600_000), POLICY).select("object", "seq", F.unix_millis("at").alias("ms"), "kind", "status", "attempts", "errors")


@query_for(CONFIRMED)
def confirmation_stream(spark, d):
    """The same by keyed state: events come in three parts, each read by a run that goes on from the last one's checkpoint."""
    at, e = scratch(spark), export_events(spark, d)
    third = (e.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    for n in range(3):
        e.filter(F.floor(F.col("seq") / third) == n).write.mode("append").parquet(f"{at}/events")
        confirmation.run_confirmations(spark, f"{at}/events", f"{at}/transitions", f"{at}/checkpoint", POLICY)
    found = spark.read.schema(confirmation.TRANSITION).parquet(f"{at}/transitions")
    return found.select("object", "seq", F.unix_millis("at").alias("ms"), "kind", "status", "attempts", "errors")


# --- hints, pages and requests ----------------------------------------------------------------------------------


def rows_of(path: str, columns: list[str], lo: int, hi: int) -> list[dict]:
    """Rows of a Parquet table whose first column lies in [lo, hi], in its order: what a transport serves."""
    import pyarrow.dataset as ds

    found = ds.dataset(path).to_table(columns=columns, filter=(ds.field(columns[0]) >= lo) & (ds.field(columns[0]) <= hi))
    return found.sort_by(columns[0]).to_pylist()


class EventHints:
    """Hints of users with an event, up to a number: every seventh is lost, every fifth comes twice."""

    def __init__(self, path: str, upto: int):
        self.path, self.upto = path, upto

    def latest(self) -> int:
        return self.upto

    def ids(self, first: int, last: int):
        for r in rows_of(self.path, ["event_id", "user_id"], first - 1, last - 1):
            n = r["event_id"] + 1
            if n % 7:
                yield from [(n, r["user_id"])] * (2 if n % 5 == 0 else 1)


@query_for("""SELECT user_id, event_id AS version, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""")
def hinted_rows(spark, d):
    """Users' latest events, where an error takes a user away, followed by hints of which some get lost and some repeat."""
    at, e = scratch(spark), table(spark, d, "events")
    top = e.agg(F.max("event_id")).first()[0] or 0
    looked = hints.Looked(spark, f"{at}/looked", "user_id long, version long, event_type string")
    mark = None
    for number, upto in enumerate((top // 2, top)):
        last = e.filter(F.col("event_id") <= upto).groupBy("user_id").agg(F.max("event_id").alias("version"), F.max_by("event_type", "event_id").alias("event_type"))
        now = last.filter("event_type <> 'error'")
        stream = hints.hint_stream(spark, EventHints(f"{d}/events.parquet", upto + 1), partition_hints="2000")
        hints.follow(stream, lambda now=now: now, "user_id", looked, f"{at}/checkpoint", number)
        mark = hints.sweep(now, "user_id", "version", mark, looked, number)
    return looked.state("user_id").select("user_id", "version", "event_type")


@query_for("""SELECT 'customers' AS kind, c_custkey::VARCHAR AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey > 500""")
def paged_customers(spark, d):
    """Customers from a paged service, several ranges of pages side by side, with the filter in the requests."""
    keys = table(spark, d, "customer").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"), F.count("*").alias("n")).first()
    path, lo, hi = f"{d}/customer.parquet", keys["lo"] or 0, keys["hi"] or 0

    def time(key: int) -> str:
        return (SERVED_FROM + timedelta(seconds=key)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def fetch(kind: str, q: dict) -> dict:
        since = datetime.strptime(q["filter"].split('"')[1], "%Y-%m-%dT%H:%M:%SZ") if "filter" in q else SERVED_FROM
        first = max(lo, int((since - SERVED_FROM).total_seconds())) + int(q["startIndex"]) - 1  # keys leave none out
        rows = rows_of(path, ["c_custkey", "c_name", "c_nationkey"], first, first + int(q["count"]) - 1)
        served = [{"id": r["c_custkey"], "name": r["c_name"], "nation": r["c_nationkey"], "meta": {"lastModified": time(r["c_custkey"])}} for r in rows]
        return {"rows": served, "total": max(0, hi - max(lo, int((since - SERVED_FROM).total_seconds())) + 1)}

    form = rest.paged_source(spark, fetch=fetch)
    rows = spark.read.format(form).schema("kind string, id string, last_modified timestamp, name string, nation int")
    rows = rows.options(kinds="customers,groups", count="250", partition_rows="500", supports_filter="true").load()
    late = F.lit((SERVED_FROM + timedelta(seconds=500)).replace(tzinfo=timezone.utc))
    return rows.filter((F.col("kind") == "customers") & (F.col("last_modified") > late)).select("kind", "id", "name", "nation")


SERVED_FROM = datetime(2024, 1, 1)


@query_for("""SELECT 'orders' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority || ' ' || o_orderstatus AS body FROM orders WHERE o_orderkey % 50 <> 0""")
def sent_requests(spark, d):
    """What a service gets from two runs of one name, of which the second finds all of it sent: operations once each."""
    at = scratch(spark)
    box = f"{at}/box"

    def send(key: str, operations: list) -> None:
        system, path = fs.FileSystem.from_uri(box)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{uuid.uuid4().hex}.json") as f:
            f.write("".join(json.dumps({"key": key, "kind": k, "id": i, "body": b}) + "\n" for k, i, b in operations).encode())

    form = rest.paged_source(spark, send=send)
    o = table(spark, d, "orders").select(F.lit("orders").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 50 == 0, F.repeat(F.lit("too large "), 500)).otherwise(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("body"))
    for _ in range(2):
        rest.send_all(o, form, "orders", f"{at}/ledger", 8, max_operations="200", max_bytes="4000")
    return spark.read.schema("kind string, id string, body string").json(box)


# --- pages of a stored order, ticks, recalls, chains, settings --------------------------------------------------


def line_index(spark, d, keys) -> page_index.PageIndex:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("price"))
    return page_index.build(rows, keys, f"{scratch(spark)}/index", 10_000)


LINES = "(SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"


@query_for(f"""SELECT * FROM {LINES} ORDER BY price DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM {LINES})""")
def deep_range_page(spark, d):
    """A page nine tenths down an order of all lines, from the parts it lies in."""
    index = line_index(spark, d, [("price", True), ("l_orderkey", False), ("l_linenumber", False)])
    return index.range(spark, index.total(spark) * 9 // 10, 50)


@query_for(f"""SELECT * FROM {LINES} WHERE l_orderkey > (SELECT max(l_orderkey) * 3 // 4 FROM lineitem) ORDER BY l_orderkey, l_linenumber LIMIT 500""")
def deep_keyset_page(spark, d):
    """The lines after a key three quarters down, from the parts they lie in."""
    index = line_index(spark, d, [("l_orderkey", False), ("l_linenumber", False)])
    last = table(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] * 3 // 4
    return index.after(spark, (last, 1 << 30), 500)


@query_for("""WITH w(rule, lo, hi) AS (VALUES (1, TIMESTAMP '1997-10-21', TIMESTAMP '1997-12-01'), (2, TIMESTAMP '1997-11-07', TIMESTAMP '1997-12-18'), (2, TIMESTAMP '1994-11-21', TIMESTAMP '1995-01-01'), (3, TIMESTAMP '1997-11-18 08:00:00', TIMESTAMP '1997-12-29 12:30:00')),
    c AS (SELECT DISTINCT rule, o_orderkey, o_orderdate, o_orderstatus FROM orders JOIN w ON o_orderdate > lo AND o_orderdate <= hi)
    SELECT rule, o_orderkey AS key, s AS in_scope FROM (SELECT *, CASE rule WHEN 1 THEN o_orderdate <= TIMESTAMP '1997-12-01' WHEN 2 THEN o_orderdate <= TIMESTAMP '1997-12-18' AND o_orderdate > TIMESTAMP '1995-01-01' ELSE o_orderdate > TIMESTAMP '1997-12-29 12:30:00' END AS s FROM c) WHERE s <> (o_orderstatus = 'F')""")
def tick_drift(spark, d):
    """Orders whose scope a tick finds changed, from the days of its windows."""
    at = scratch(spark)
    rules = {
        1: (Group((Criterion("o_orderdate", "le", Relative(-1, "months")),)),),
        2: (Group((Criterion("o_orderdate", "le", Relative(-2, "weeks")), Criterion("o_orderdate", "gt", Relative(-3, "years")))),),
        3: (Group((Criterion("o_orderdate", "gt", Relative(-72, "hours")),)),),
    }
    orders = table(spark, d, "orders")
    ticks.write_values(orders, ORDER, ["o_orderdate"], f"{at}/values")
    passed = ticks.windows(spark, rules, ORDER, datetime(1997, 11, 21, 8), NOW, at)
    found = ticks.candidates(spark.read.parquet(f"{at}/values"), passed)
    return ticks.drifted(orders.withColumn("_on", F.col("o_orderstatus") == "F"), ORDER, found, rules, "_on", NOW)


@query_for("""SELECT o_orderkey AS owner, o_custkey AS ref, o_orderkey % 2 = 0 AS held FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def bloom_recall(spark, d):
    """Orders' references to customers that a run deletes, filtered where they are read."""
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), F.lit("customer").alias("attr"), F.col("o_custkey").alias("ref"))
    deleted = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "delete").otherwise("none").alias("change"))
    return recall.recalled(deleted, refs, refs.filter("owner % 2 = 0"), scratch(spark)).select("owner", "ref", "held")


@query_for("""WITH RECURSIVE e AS (SELECT o_orderkey AS effect, o_orderkey // 2 AS cause FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 5 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 1, 3),
    t AS (SELECT o_orderkey AS start, o_orderkey AS node, 0 AS steps FROM orders WHERE o_orderstatus = 'P' UNION SELECT start, cause, steps + 1 FROM t JOIN e ON effect = node WHERE steps <= 40)
    SELECT start, node, min(steps)::INT AS steps FROM t GROUP BY 1, 2""")
def causal_chain(spark, d):
    """What led to every open order, along two kinds of causes and a cycle."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    edges = o.select(k.alias("effect"), F.floor(k / 2).alias("cause")).union(o.filter(k % 5 == 0).select(k, F.floor(k / 5))).union(spark.range(1, 2).select("id", F.lit(3).cast("long")))
    return summarise.causal_chain(edges, o.filter("o_orderstatus = 'P'").select(k.alias("id")), 40)


def settings_of(spark, d, last: bool) -> DataFrame:
    e = table(spark, d, "events")
    pick = F.max_by if last else F.min_by
    tree = F.concat(
        F.lit('{"event": {"type": "'), "event_type", F.lit('", "id": '), F.col("event_id") % 7, F.lit('}, "props": '), "props", F.lit(', "list": ['), F.col("event_id") % 3, F.lit(", {"),
        F.when(F.col("event_id") % 2 == 0, F.lit('"even": true')).otherwise(F.lit("")), F.lit("}]"), F.when(F.col("event_id") % 4 == 0, F.lit(', "extra": null')).otherwise(F.lit("")), F.lit("}"),
    )
    return e.groupBy("user_id").agg(pick(tree, "event_id").alias("tree"))


@query_for("""WITH j AS (SELECT user_id, event_id, '{"event": {"type": "' || event_type || '", "id": ' || event_id % 7 || '}, "props": ' || props || ', "list": [' || event_id % 3 || ', {' || CASE WHEN event_id % 2 = 0 THEN '"even": true' ELSE '' END || '}]' || CASE WHEN event_id % 4 = 0 THEN ', "extra": null' ELSE '' END || '}' AS tree FROM events),
    v AS (SELECT user_id, arg_min(tree, event_id) AS a, arg_max(tree, event_id) AS b FROM j GROUP BY 1),
    x AS (SELECT user_id, s, replace(replace(replace(replace(fullkey, '$', ''), '.', '/'), '[', '/'), ']', '') AS path, t.value::VARCHAR AS value FROM (SELECT user_id, 'a' AS s, a::JSON AS t FROM v UNION ALL SELECT user_id, 'b', b::JSON FROM v) w, json_tree(w.t) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{}', '[]'))
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.path, b.path) AS path, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change, a.value AS old, b.value AS new
    FROM (SELECT * FROM x WHERE s = 'a') a FULL JOIN (SELECT * FROM x WHERE s = 'b') b ON a.user_id = b.user_id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def settings_changes(spark, d):
    """How the trees of users' first and last events differ, path by path."""
    return diff.settings_changes(settings_of(spark, d, False), settings_of(spark, d, True), ["user_id"], "tree")


# --- databases, inference, queues, reports ----------------------------------------------------------------------


def derby(spark, d) -> str:
    """Customers as a table of the database that comes with Spark; its address.

    Only one process at a time may have such a database open for writing. So the driver's database loads what tasks wrote as
    text, file by file, and is then put into an archive in the shared folder, which executors open together, for reading.
    """
    at = scratch(spark).removeprefix("file://").removeprefix("file:")
    if "://" in at:
        raise ValueError("the database needs spark.checkpoint.dir as a folder that the driver and all executors have mounted")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    c.write.csv(f"file://{at}/rows", escape='"')
    url = f"jdbc:derby:{at}/base"
    connect = spark._jvm.java.sql.DriverManager.getConnection
    db = connect(f"{url};create=true")
    run = db.createStatement()
    run.execute('CREATE TABLE customers ("c_custkey" BIGINT, "c_name" VARCHAR(100), "c_nationkey" INTEGER, "c_acctbal" DOUBLE, "c_mktsegment" VARCHAR(20))')
    for f in sorted(Path(at, "rows").glob("*.csv")):
        run.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'CUSTOMERS', '{f}', ',', '\"', 'UTF-8', 0)")
    db.close()
    try:
        connect(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # this one says that the database is shut
            raise
    with zipfile.ZipFile(f"{at}/base.jar", "w", zipfile.ZIP_STORED) as z:  # stored: pages are found by their place
        for f in sorted(Path(at, "base").rglob("*")):
            z.write(f, f.relative_to(at))
    return f"jdbc:derby:jar:({at}/base.jar)base"


@query_for("""SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey >= 5 AND c_mktsegment <> 'BUILDING'""")
def jdbc_scan(spark, d):
    """A table of a database in ranges of its key, filtered there."""
    rows = relational.scan(spark, derby(spark, d), "customers", "c_custkey", partitions=4)
    return rows.filter("c_nationkey >= 5 and c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query_for("""SELECT c_custkey, c_name FROM customer WHERE c_custkey > (SELECT max(c_custkey) // 2 FROM customer) ORDER BY c_custkey LIMIT 100""")
def jdbc_page(spark, d):
    half = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0] // 2
    return relational.scan_page(spark, derby(spark, d), "customers", ["c_custkey"], (half,), 100).select("c_custkey", "c_name")


INFER = "CASE WHEN count(x) = 0 THEN 'TEXT' WHEN bool_and(regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS INT) IS NOT NULL) THEN 'NUMBER' WHEN bool_and(regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL) THEN 'LONG' WHEN bool_and(try_cast(x AS DECIMAL(38,10)) IS NOT NULL) THEN 'DECIMAL' WHEN bool_and(lower(x) IN ('true', 'false')) THEN 'BOOLEAN' WHEN bool_and(try_cast(x AS UUID) IS NOT NULL) THEN 'GUID' WHEN bool_and(try_cast(x AS TIMESTAMP) IS NOT NULL) THEN 'DATETIME' ELSE 'TEXT' END"
INFERRED = {
    "key": "o_orderkey", "wide": "o_orderkey * 3000000000", "price": "round(o_totalprice * 100)::BIGINT / 100.0", "status": "o_orderstatus", "flag": "o_orderkey % 2 = 0", "day": "o_orderdate",
    "mixed": "CASE WHEN o_orderkey % 50 = 0 THEN 'none' ELSE o_orderkey::VARCHAR END", "blank": "NULL", "some": "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END",
}


@query_for(" UNION ALL ".join(f"SELECT '{n}' AS name, {INFER} AS kind FROM (SELECT ({x})::VARCHAR AS x FROM orders) WHERE x IS NOT NULL" for n, x in INFERRED.items()))
def inferred_types(spark, d):
    """Types of a file's columns, from all of their values."""
    k, at = F.col("o_orderkey"), scratch(spark)
    o = table(spark, d, "orders").select(
        k.alias("key"), (k * 3_000_000_000).alias("wide"), F.round("o_totalprice", 2).cast("decimal(12,2)").alias("price"), F.col("o_orderstatus").alias("status"), (k % 2 == 0).alias("flag"), F.col("o_orderdate").cast("string").alias("day"),
        F.when(k % 50 == 0, "none").otherwise(k.cast("string")).alias("mixed"), F.lit(None).cast("string").alias("blank"), F.when(k % 7 == 0, F.col("o_custkey")).alias("some"),
    )
    o.select(*(F.col(c).cast("string") for c in o.columns)).write.csv(f"{at}/orders", header=True)
    found = files.infer(files.read_text(spark, f"{at}/orders"))
    return spark.createDataFrame([(a.name, a.kind.name) for a in found], "name string, kind string")


@query_for("""SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 8 > 5 THEN 'parked' ELSE 'pending' END AS status,
    CASE WHEN event_type <> 'error' AND event_id % 8 <= 5 THEN least(ts + INTERVAL 90 SECOND, ts + INTERVAL 1 SECOND * (event_id % 200)) END AS next_retry FROM events""")
def password_retries(spark, d):
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    expiry = F.timestamp_micros(F.unix_micros(ts) + (i % 200) * 1_000_000)
    status, later = lifecycle.retry_password(F.col("event_type") != "error", i % 8, ts, expiry, 5, 90)
    return table(spark, d, "events").select("event_id", status.alias("status"), later.alias("next_retry"))


@query_for("""SELECT user_id AS system, max(ts) AS started FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 > 0 GROUP BY 1""")
def last_full_syncs(spark, d):
    i = F.col("event_id") % 3
    kind = F.when(F.col("event_type").isin("click", "view"), "full synchronisation").otherwise("delta synchronisation")
    rows = table(spark, d, "events").select(F.col("user_id").alias("system"), kind.alias("kind"), F.when(i == 0, "failed").otherwise("complete").alias("status"), F.col("ts").alias("started"))
    return lifecycle.last_full_syncs(rows)


@query_for("""WITH a AS (SELECT user_id AS execution, event_id % 4 AS step, ['complete', 'complete with warning', 'in progress', 'complete with error', 'failed', 'cancelled'][1 + (event_id // 7 % 6)] AS status, event_id // 7 % 6 AS place FROM events)
    SELECT execution, step, arg_max(status, place) AS outcome, count(*) AS runs FROM a GROUP BY 1, 2""")
def step_outcomes(spark, d):
    i = F.col("event_id")
    status = F.get(F.array(*map(F.lit, lifecycle.OUTCOMES)), (F.floor(i / 7) % 6).cast("int"))
    return lifecycle.step_outcomes(table(spark, d, "events").select(F.col("user_id").alias("execution"), (i % 4).alias("step"), status.alias("status")))


@query_for("""SELECT CASE WHEN user_id % 5 = 0 THEN '' ELSE 'k' || user_id % 5 END AS prefix, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'a' || user_id % 3 END AS address, event_type AS reason,
    time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS attempts, max(ts) AS last_seen FROM events GROUP BY 1, 2, 3, 4""")
def failed_logins(spark, d):
    """Failures counted by kind and window, in two batches, the second added to what the first left."""
    u, at = F.col("user_id"), scratch(spark)
    rows = table(spark, d, "events").select(F.when(u % 5 > 0, F.concat(F.lit("k"), u % 5)).alias("prefix"), F.when(u % 3 > 0, F.concat(F.lit("a"), u % 3)).alias("address"), F.col("event_type").alias("reason"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    held = spark.createDataFrame([], "prefix string, address string, reason string, window_start timestamp, attempts long, last_seen timestamp")
    for n in range(2):
        held = stored(lifecycle.add_failed_logins(held, rows.filter(F.col("event_id") % 2 == n).drop("event_id"), 6 * 3600), at, f"held-{n}")
    return held


@query_for("""SELECT 'root/' || CASE WHEN p_size % 2 = 0 THEN 'even/10' ELSE 'odd' END AS container, count(*) AS n FROM part WHERE p_size % 2 = 1 OR p_size = 10 GROUP BY 1""")
def discarded_by_container(spark, d):
    path = F.concat_ws("/", F.lit("root"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"), F.col("p_size").cast("string"), "p_partkey")
    rules = spark.createDataFrame([("root/even", True, True), ("root/even/10", False, True), ("root/odd", False, True)], "path string, include boolean, subtree boolean")
    return match.discarded(match.container_scope(table(spark, d, "part").select("p_partkey", path.alias("path")), rules, "path"))


@query_for("""SELECT o_orderkey, (o_custkey + 1)::VARCHAR AS raw, 'unresolved' AS state, 'warning' AS level FROM orders WHERE o_custkey + 1 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)""")
def reference_warnings(spark, d):
    refs = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 1).cast("string").alias("ref"))
    objects = table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_custkey").alias("id"))
    found = match.resolve_references(refs, objects, "o_orderkey", "ref", "customer")
    return match.reference_report(found, "warn").select("o_orderkey", "raw", "state", "level")


@query_for(f"""WITH {CHANGED} SELECT b.c_custkey, a.c_mktsegment <> b.c_mktsegment AS mapped, a.c_nationkey <> b.c_nationkey OR a.c_mktsegment <> b.c_mktsegment AS either FROM a JOIN b USING (c_custkey)""")
def relevant_changes(spark, d):
    """Whether what changed of a customer matters to exports of the segment, or of the segment and the nation."""
    found = diff.object_changes(*snapshots(spark, d), ["c_custkey"], list(CUSTOMER.attributes[1:])).filter("change in ('update', 'none')")
    one, two = ([outbound.ExportMapping(n, Attribute(n)) for n in names] for names in (("c_mktsegment",), ("c_mktsegment", "c_nationkey")))
    return found.select("c_custkey", outbound.relevant(F.col("changed"), one).alias("mapped"), outbound.relevant(F.col("changed"), two).alias("either"))


@query_for("""SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1""")
def preview_within_budget(spark, d):
    """Categories counted slice by slice; the time is enough for all slices."""
    count = lambda df: df.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    parts, done = summarise.within_budget(table(spark, d, "events"), "user_id", count, 3600, f"{scratch(spark)}/preview", 4)
    return parts.groupBy("category").agg(F.sum("n").alias("n"))


@query_for("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(list(DISTINCT o_orderpriority), lambda x: x[1] <> '1'), ['0-NEW', '5-LOW']))), ',') AS values FROM orders GROUP BY 1""")
def applied_adds(spark, d):
    """Lists after removes and adds, some of which are there already."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    after = diff.applied(F.col("p"), F.filter("p", lambda x: x.startswith("1")), F.array(F.lit("0-NEW"), F.lit("5-LOW")))
    return rows.select("o_custkey", F.array_join(F.array_sort(after), ",").alias("values"))


@query_for("""SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 5 <> 0""")
def cdc_stream(spark, d):
    """A change log read in two runs, of which the second brings some older changes too; the rows that it amounts to."""
    at, schema = scratch(spark), "event_id long, user_id long, event_type string, kind string"
    kind = F.when(F.col("event_id") % 5 == 0, "D").otherwise("U")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", kind.alias("kind"))
    for part in (e.filter("event_id % 4 < 3"), e.filter("event_id % 4 = 3")):
        part.write.mode("append").parquet(f"{at}/log")
        changes.append_changes(spark.readStream.schema(schema).parquet(f"{at}/log"), f"{at}/rows", "user_id", "event_id", f"{at}/checkpoint").awaitTermination()
    return changes.current_rows(spark, f"{at}/rows", schema, "user_id", "event_id", "kind").select("event_id", "user_id", "event_type")


@query_for("""SELECT event_id, user_id, event_type FROM events""")
def delta_cycle(spark, d):
    """Three delta runs over a log that grows, each from the stored watermark of the last: rows that came late lie within the
    overlap and are read again, and an upsert takes them once."""
    at = scratch(spark)
    micros = F.unix_micros(F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros.alias("at"))
    ends = e.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    marks, held, late = None, None, 3_600_000_000
    for n in range(3):
        upto = lo + (hi - lo) * (n + 1) // 3
        # a row with an id divisible by seven is seen half an hour after its time
        seen = e.filter(F.col("at") + F.when(F.col("event_id") % 7 == 0, late // 2).otherwise(0) <= (upto if n < 2 else hi + late))
        known = relational.Watermarks.loads(marks, "column")
        mark = relational.watermark_value(*known.own["events"]) if known else None
        top = seen.agg(F.max("at")).first()[0] or 0  # when the run begins
        new = relational.changed_since(seen, "at", None if mark is None else mark - late)
        held = stored(new if held is None else files.upsert(held, new, ["event_id"]), at, f"run-{n}")
        marks = relational.Watermarks("column", {"events": relational.watermark_text(top)}).dumps()
    return held.select("event_id", "user_id", "event_type")


@query_for("""SELECT o_orderstatus AS type, min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1""")
def value_ranges(spark, d):
    """The least and greatest key and date of each type: bounds of a parallel scan and marks of the next delta."""
    return summarise.ranges(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "type"), ["type"], {"o_orderkey": ("low", "high"), "o_orderdate": ("first", "last")})


@query_for("""SELECT o_custkey, list_contains(list(o_orderpriority), '1-URGENT') AS urgent, min(o_orderpriority) = '1-URGENT' AS first_is, min(o_orderpriority) >= '2' AS later, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1""")
def list_values(spark, d):
    """Lists in expressions, and in criteria, where their least value counts."""
    t = ObjectType("customer", (Attribute("o_custkey", Kind.LONG), Attribute("priorities", many=True)), "o_custkey")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"))
    known = attributes_of({"priorities": Kind.TEXT}, frozenset({"priorities"}))
    holds = compile_expression('CollectionContains(cs["priorities"], "1-URGENT")', cs=known).column
    first = criteria.criterion(Criterion("priorities", "eq", "1-URGENT"), t, NOW)
    later = ~criteria.criterion(Criterion("priorities", "starts", "1"), t, NOW)
    return rows.select("o_custkey", holds.alias("urgent"), first.alias("first_is"), later.alias("later"), F.size("priorities").cast("long").alias("n"))
