"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import scalars as S
from rillstone.functions.expressions import attributes_of, compile_expression, with_missing_inputs
from rillstone.operators import confirm, criteria, diff, lifecycle, match, merge, outbound, query, summarise
from rillstone.operators.criteria import Criterion, Group, Relative
from rillstone.plans import pipeline
from rillstone.schema import Attribute, Kind, ObjectType, Write, from_eav, to_eav
from rillstone.session import scratch
from rillstone.sources import files, relational, synthetic
from rillstone.streaming import changes as stream

NOW = datetime(1998, 1, 1, 12, 30)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query_for(sql: str | None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CUSTOMER = ObjectType(
    "customer",
    (
        Attribute("c_custkey", Kind.LONG),
        Attribute("c_name"),
        Attribute("c_nationkey", Kind.NUMBER),
        Attribute("c_acctbal", Kind.DECIMAL),
        Attribute("c_mktsegment"),
    ),
    "c_custkey",
)
ORDER = ObjectType(
    "order",
    (
        Attribute("o_orderkey", Kind.LONG),
        Attribute("o_custkey", Kind.LONG),
        Attribute("o_orderstatus"),
        Attribute("o_totalprice", Kind.DECIMAL),
        Attribute("o_orderdate", Kind.DATETIME),
        Attribute("o_orderpriority"),
    ),
    "o_orderkey",
)
PART = ObjectType(
    "part",
    (
        Attribute("p_partkey", Kind.LONG),
        Attribute("p_name"),
        Attribute("p_brand"),
        Attribute("p_type"),
        Attribute("p_size", Kind.NUMBER),
        Attribute("p_retailprice", Kind.DECIMAL),
    ),
    "p_partkey",
)


# --- criteria ---------------------------------------------------------------------------------------------------


@query_for("""SELECT p_partkey, p_type = 'STANDARD' AS eq, p_type <> 'STANDARD' AS ne, starts_with(p_name, 'part 1') AS sw,
    NOT starts_with(p_name, 'part 1') AS nsw, suffix(p_brand, '3') AS ew, NOT suffix(p_brand, '3') AS new, contains(p_type, 'A') AS ct,
    NOT contains(p_type, 'A') AS nct FROM part""")
def crit_text_ops(spark, d):
    c = lambda a, op, v: criteria.criterion(Criterion(a, op, v), PART, NOW)
    return table(spark, d, "part").select(
        "p_partkey", c("p_type", "eq", "STANDARD").alias("eq"), c("p_type", "ne", "STANDARD").alias("ne"), c("p_name", "starts", "part 1").alias("sw"),
        c("p_name", "not_starts", "part 1").alias("nsw"), c("p_brand", "ends", "3").alias("ew"), c("p_brand", "not_ends", "3").alias("new"),
        c("p_type", "contains", "A").alias("ct"), c("p_type", "not_contains", "A").alias("nct"),
    )


@query_for("""SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR starts_with(lower(c_name), 'customer#00000001')""")
def crit_text_ci(spark, d):
    scope = (Group((Criterion("c_mktsegment", "eq", "BuIlDiNg", True), Criterion("c_name", "starts", "CUSTOMER#00000001", True)), all=False),)
    return table(spark, d, "customer").filter(criteria.in_scope(scope, CUSTOMER, NOW)).select("c_custkey")


@query_for("""SELECT c_custkey, c_nationkey = 7 AS eq, c_nationkey <> 7 AS ne, c_nationkey < 7 AS lt, c_nationkey <= 7 AS le, c_nationkey > 7 AS gt,
    c_nationkey >= 7 AS ge, c_custkey > 100 AS long_gt FROM customer""")
def crit_numeric_ops(spark, d):
    ops = [criteria.criterion(Criterion("c_nationkey", o, 7), CUSTOMER, NOW).alias(o) for o in ("eq", "ne", "lt", "le", "gt", "ge")]
    return table(spark, d, "customer").select("c_custkey", *ops, criteria.criterion(Criterion("c_custkey", "gt", 100), CUSTOMER, NOW).alias("long_gt"))


@query_for("""SELECT o_orderkey FROM orders WHERE o_totalprice::DECIMAL(38,10) >= 150000.50 AND o_totalprice::DECIMAL(38,10) <> 200000""")
def crit_decimal_ops(spark, d):
    scope = (Group((Criterion("o_totalprice", "ge", "150000.500"), Criterion("o_totalprice", "ne", "200000.00"))),)
    return table(spark, d, "orders").filter(criteria.in_scope(scope, ORDER, NOW)).select("o_orderkey")


@query_for("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '1997-03-01 12:00:00'""")
def crit_date_abs(spark, d):
    scope = (Group((Criterion("o_orderdate", "ge", datetime(1996, 2, 29)), Criterion("o_orderdate", "lt", datetime(1997, 3, 1, 12)))),)
    return table(spark, d, "orders").filter(criteria.in_scope(scope, ORDER, NOW)).select("o_orderkey")


@query_for("""SELECT o_orderkey, o_orderdate > TIMESTAMP '1997-12-01' AS month, o_orderdate >= TIMESTAMP '1996-01-01' AS years,
    o_orderdate < TIMESTAMP '1997-12-18' AS weeks, o_orderdate <= TIMESTAMP '1997-12-30 12:30:00' AS hours FROM orders""")
def crit_date_relative(spark, d):
    c = lambda op, n, u: criteria.criterion(Criterion("o_orderdate", op, Relative(n, u)), ORDER, NOW)
    return table(spark, d, "orders").select(
        "o_orderkey", c("gt", -1, "months").alias("month"), c("ge", -2, "years").alias("years"), c("lt", -2, "weeks").alias("weeks"), c("le", -48, "hours").alias("hours")
    )


TREE = (
    Group(
        (
            Criterion("c_name", "starts", "Customer#"),
            Group((Criterion("c_mktsegment", "eq", "BUILDING"), Criterion("c_acctbal", "gt", 5000)), all=False),
            Group((Criterion("c_nationkey", "ge", 3), Group((Criterion("c_nationkey", "lt", 20), Criterion("c_nationkey", "ne", 7))))),
        )
    ),
)


@query_for("""SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE starts_with(c_name, 'Customer#')
    AND (c_mktsegment = 'BUILDING' OR c_acctbal::DECIMAL(38,10) > 5000) AND c_nationkey >= 3 AND c_nationkey < 20 AND c_nationkey <> 7""")
def crit_tree_nested(spark, d):
    rows = table(spark, d, "customer").filter(criteria.in_scope(TREE, CUSTOMER, NOW))
    return rows.join(table(spark, d, "nation"), rows.c_nationkey == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query_for("""SELECT c_custkey, o_orderkey, coalesce(o_orderstatus = 'F', false) AS eq, coalesce(o_orderstatus <> 'F', false) AS ne,
    coalesce(NOT starts_with(o_orderpriority, '1'), false) AS nsw, o_orderstatus IS NULL AS missing, coalesce(o_orderkey < 1000, false) AS lt
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 3 = 0""")
def crit_missing_semantics(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    rows = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = lambda a, op, v: criteria.criterion(Criterion(a, op, v), ORDER, NOW)
    return rows.select(
        "c_custkey", "o_orderkey", c("o_orderstatus", "eq", "F").alias("eq"), c("o_orderstatus", "ne", "F").alias("ne"),
        c("o_orderpriority", "not_starts", "1").alias("nsw"), c("o_orderstatus", "eq", None).alias("missing"), c("o_orderkey", "lt", 1000).alias("lt"),
    )


@query_for("""SELECT o_orderkey, o_orderdate > TIMESTAMP '1997-11-01' AND o_orderdate <= TIMESTAMP '1997-12-01' AS crossed,
    o_orderdate > TIMESTAMP '1997-11-01' AND o_orderdate <= TIMESTAMP '1997-12-01' AND (o_orderdate <= TIMESTAMP '1997-12-01') <> (o_orderstatus = 'F') AS drifted
    FROM orders""")
def temporal_window(spark, d):
    scope = (Group((Criterion("o_orderdate", "le", Relative(-1, "months")),)),)
    after = datetime(1997, 12, 1, 8)
    return table(spark, d, "orders").select(
        "o_orderkey", criteria.crossed(scope, ORDER, after, NOW).alias("crossed"),
        criteria.scope_drift(scope, ORDER, F.col("o_orderstatus") == "F", after, NOW).alias("drifted"),
    )


# --- lists, pages, projections ----------------------------------------------------------------------------------


@query_for("""SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE contains(s_name, '1') ORDER BY s_name DESC, s_suppkey LIMIT 10 OFFSET 10""")
def rest_filter_sort_page(spark, d):
    rows = query.rest_filter(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "S_Name:contains:1")
    rows = query.rest_filter(rows, "nonsense:eq:1")
    return query.page(query.rest_sort(rows, "S_NAME", True, "s_suppkey"), 2, 10)


@query_for("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 500""")
def keyset_page(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return query.keyset_page(rows, ["l_orderkey", "l_linenumber"], (100, 2), 500)


@query_for("""SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_name, c_custkey LIMIT 500 OFFSET 20""")
def range_page(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_name", "c_custkey")
    return query.page_range(rows, 20, 10_000)[0]


@query_for("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IS NOT NULL)""")
def has_attribute(spark, d):
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("Priority").alias("attr"), F.col("o_orderpriority").alias("value")).filter("value is not null")
    return query.has_attribute(table(spark, d, "customer").select("c_custkey", "c_name"), values, "c_custkey", "PRIORITY")


@query_for("""SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value >= 10
    AND (contains(lower(event_type), 'i') OR contains(lower(props), '1'))""")
def list_filters(spark, d):
    rows = query.list_filter(table(spark, d, "events"), {"event_type": ["click", "view", "purchase"]}, {"value": (10.0, None)}, "I", ["event_type"])
    more = query.list_filter(table(spark, d, "events"), {"event_type": ["click", "view", "purchase"]}, {"value": (10.0, None)}, "1", ["props"])
    return rows.union(more).select("event_id", "event_type", "user_id").distinct()


@query_for("""SELECT c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer""")
def eav_pivot(spark, d):
    attributes = [a for a in CUSTOMER.attributes if a.name in ("c_name", "c_mktsegment", "c_nationkey")]
    return query.pivoted(to_eav(table(spark, d, "customer"), ["c_custkey"], attributes), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query_for("""SELECT p_partkey, p_name, p_size, p_retailprice::DECIMAL(38,10)::DOUBLE AS price FROM part""")
def eav_roundtrip(spark, d):
    attributes = [PART.attribute(n) for n in ("p_name", "p_size", "p_retailprice")]
    back = from_eav(to_eav(table(spark, d, "part"), ["p_partkey"], attributes), ["p_partkey"], attributes)
    return back.select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("double").alias("price"))


@query_for("""SELECT l_orderkey, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 3), ',') AS parts,
    count(DISTINCT l_partkey)::INT AS parts_total FROM lineitem GROUP BY l_orderkey""")
def capped_values(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    rows = rows.select("l_orderkey", *query.capped("parts", 3))
    return rows.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), "parts_total")


@query_for("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""")
def latest_child(spark, d):
    return query.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderdate"])


@query_for("""WITH RECURSIVE p AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent FROM nation),
    t AS (SELECT node, node AS top, 0 AS steps FROM p UNION ALL SELECT t.node, p.parent, steps + 1 FROM t JOIN p ON p.node = t.top WHERE p.parent IS NOT NULL)
    SELECT node, arg_max(top, steps) AS root FROM t GROUP BY node""")
def ancestor_walk(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent"))
    return query.ancestors(n, "n_nationkey", "parent", None)


@query_for("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#') AND (c_mktsegment = 'BUILDING'
    OR c_acctbal::DECIMAL(38,10) > 5000) AND c_nationkey >= 3 AND c_nationkey < 20 AND c_nationkey <> 7 ORDER BY c_name DESC, c_custkey LIMIT 50""")
def stored_search(spark, d):
    return query.Search("rich builders", CUSTOMER, ("c_name", "c_acctbal"), TREE, "c_name", True).run(table(spark, d, "customer"), "c_custkey", 0, 50, NOW)


# --- functions --------------------------------------------------------------------------------------------------


@query_for("""SELECT p_partkey, trim(p_name) AS t, upper(p_name) AS u, lower(p_brand) AS l, replace(p_name, 'a', 'oo') AS r, starts_with(p_name, 'part') AS sw,
    suffix(p_brand, '1') AS ew, contains(p_type, 'AN') AS ct, length(p_name)::INT AS n, p_name = '' AS e, trim(p_name) = '' AS w FROM part""")
def fn_string(spark, d):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", S.trim(n).alias("t"), F.upper(n).alias("u"), F.lower(b).alias("l"), S.replace(n, F.lit("a"), F.lit("oo")).alias("r"), S.starts_with(n, F.lit("part")).alias("sw"),
        S.ends_with(b, F.lit("1")).alias("ew"), S.contains(t, F.lit("AN")).alias("ct"), S.length(n).alias("n"), S.is_null_or_empty(n).alias("e"), S.is_null_or_whitespace(n).alias("w"),
    )


@query_for("""SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || '-' || 'O''Neil' AS name FROM customer""")
def fn_capitalise(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.capitalise(F.concat("c_mktsegment", F.lit("-o'neil"))).alias("name"))


@query_for("""SELECT s_suppkey, left(s_name, 4) AS l, right(s_name, 3) AS r, '' AS l0, substring(s_name, 3, 5) AS s, substring(s_name, 1, 2) AS s0, '' AS far FROM supplier""")
def fn_substring(spark, d):
    n = F.col("s_name")
    i = F.lit
    return table(spark, d, "supplier").select(
        "s_suppkey", S.left(n, i(4)).alias("l"), S.right(n, i(3)).alias("r"), S.left(n, i(-2)).alias("l0"), S.substring(n, i(2), i(5)).alias("s"),
        S.substring(n, i(-5), i(2)).alias("s0"), S.substring(n, i(1000), i(2)).alias("far"),
    )


@query_for("""SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(c_name || '## ' || c_mktsegment || '#', '#'), lambda x: trim(x)), lambda x: x <> ''), '|') AS j,
    NULL::VARCHAR AS empty FROM customer""")
def fn_split_join(spark, d):
    parts = S.split(F.concat("c_name", F.lit("## "), "c_mktsegment", F.lit("#")), F.lit("#"))
    return table(spark, d, "customer").select("c_custkey", S.join(parts, F.lit("|")).alias("j"), S.join(S.split(F.lit(""), F.lit("#"))).alias("empty"))


@query_for("""SELECT o_orderkey, (o_custkey & ~2)::INT AS en, (o_custkey | 2)::INT AS dis, (o_custkey | 64)::INT AS sb, (o_custkey & ~5)::INT AS cb, (o_custkey & 5) = 5 AS hb FROM orders""")
def fn_bits(spark, d):
    c, i = F.col("o_custkey"), F.lit
    return table(spark, d, "orders").select(
        "o_orderkey", S.enable_user(c).alias("en"), S.disable_user(c).alias("dis"), S.set_bit(c, i(64)).alias("sb"), S.clear_bit(c, i(5)).alias("cb"), S.has_bit(c, i(5)).alias("hb")
    )


@query_for("""SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 116444736000000000 AS ft, o_orderdate AS back, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders""")
def fn_filetime(spark, d):
    ft = S.to_file_time(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", ft.alias("ft"), S.from_file_time(ft).alias("back"), S.today(F.col("o_orderdate").cast("timestamp")).alias("day"))


@query_for("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso, strftime(o_orderdate, '%A, %d %B %Y') AS long, strftime(o_orderdate, '%a %I:%M %p') AS time FROM orders""")
def fn_format_date(spark, d):
    c = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(
        "o_orderkey", S.format_date(c, "yyyy-MM-dd HH:mm:ss").alias("iso"), S.format_date(c, "dddd, dd MMMM yyyy").alias("long"), S.format_date(c, "ddd hh:mm tt").alias("time")
    )


@query_for("""SELECT p_partkey, 'CN=' || regexp_replace(p_brand || ', ' || p_type || '; "x"', '([,+"\\\\<>;=])', '\\\\\\1', 'g') AS dn FROM part""")
def fn_escape_dn(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("CN="), S.escape_dn(F.concat("p_brand", F.lit(", "), "p_type", F.lit('; "x"')))).alias("dn"))


CUSTOMER_KINDS = {a.name: a.kind for a in CUSTOMER.attributes}


@query_for("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(left(c_name, 3)) ELSE coalesce(lower(c_mktsegment), 'none') END AS a,
    'Key ' || c_custkey || ' of ' || c_nationkey AS b, (c_nationkey // 4 + c_nationkey % 4 * 2 - 1)::INT AS c, c_nationkey > 5 AND NOT c_mktsegment = 'MACHINERY' AS d,
    c_nationkey = 5 AS e FROM customer""")
def expr_language(spark, d):
    known = attributes_of(CUSTOMER_KINDS)
    make = lambda t: compile_expression(t, cs=known).column
    return table(spark, d, "customer").select(
        "c_custkey",
        make('IIF(Eq(cs["c_mktsegment"], "BUILDING"), Upper(Left(cs["C_Name"], 3)), Coalesce(Lower(cs["c_mktsegment"]), "none"))').alias("a"),
        make('"Key " + cs["c_custkey"] + " of " + cs["c_nationkey"]').alias("b"),
        make('cs["c_nationkey"] / 4 + cs["c_nationkey"] % 4 * 2 - 1').alias("c"),
        make('cs["c_nationkey"] > 5 && !Eq(cs["c_mktsegment"], "MACHINERY")').alias("d"),
        make('Eq(cs["c_nationkey"], "5")').alias("e"),
    )


@query_for("""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')))) AS low,
    CASE WHEN doc_id % 2 = 0 THEN 'x' END AS blank FROM documents""")
def text_processing(spark, d):
    c = F.col("text")
    blank = F.when(F.col("doc_id") % 2 == 0, F.lit(" x ")).otherwise(F.lit("  "))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(S.process_text(c, True, True, "lower")).alias("low"), S.process_text(blank, trim_ends=True, blank_is_null=True).alias("blank")
    )


@query_for("""SELECT c_custkey, o_orderkey, 'Order ' || coalesce(o_orderstatus, '') AS anyway, CASE WHEN o_orderstatus IS NOT NULL THEN 'Order ' || o_orderstatus END AS none,
    CASE WHEN o_orderstatus IS NULL THEN 'mapping: missing input' END AS error FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey % 3 = 0""")
def missing_input(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    rows = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    known = attributes_of({"o_orderstatus": Kind.TEXT})
    x = compile_expression('"Order " + cs["o_orderstatus"]', cs=known)
    (a, _), (n, _), (_, e) = (with_missing_inputs(x, {}, known, "cs", b) for b in ("evaluate", "no_value", "fail_mapping"))
    return rows.select("c_custkey", "o_orderkey", a.alias("anyway"), n.alias("none"), e.alias("error"))


# --- differences, matching, merging -----------------------------------------------------------------------------


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers, and the same with some gone, some new, some changed."""
    a = table(spark, d, "customer")
    b = a.filter("c_custkey % 10 <> 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    b = b.withColumn("c_nationkey", F.when(F.col("c_custkey") % 11 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    new = a.filter("c_custkey % 20 = 3").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return a, b.unionByName(new)


CHANGED = """a AS (SELECT * FROM customer), b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_acctbal,
    CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 3
    UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 20 = 3)"""


@query_for(f"""WITH {CHANGED} SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'add' WHEN b.c_custkey IS NULL THEN 'delete'
    WHEN a.c_nationkey <> b.c_nationkey OR a.c_mktsegment <> b.c_mktsegment THEN 'update' ELSE 'none' END AS change,
    CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c_nationkey <> b.c_nationkey THEN 'c_nationkey' END,
    CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' END) END AS changed FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def import_diff(spark, d):
    found = diff.object_changes(*snapshots(spark, d), ["c_custkey"], list(CUSTOMER.attributes[1:]))
    return found.select("c_custkey", "change", F.array_join("changed", ",").alias("changed"))


@query_for(f"""WITH {CHANGED}, x AS (SELECT c_custkey, 'c_mktsegment' AS attr, c_mktsegment AS value FROM a UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM a),
    y AS (SELECT c_custkey, 'c_mktsegment' AS attr, c_mktsegment AS value FROM b UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM b)
    SELECT c_custkey, attr, value, 'remove' AS op FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT c_custkey, attr, value, 'add' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def import_value_diff(spark, d):
    found = diff.value_changes(*snapshots(spark, d), ["c_custkey"], [CUSTOMER.attribute("c_mktsegment"), CUSTOMER.attribute("c_nationkey")])
    return found.select("c_custkey", "attr", "value", "op")


@query_for(f"""WITH {CHANGED} SELECT b.c_custkey FROM a JOIN b USING (c_custkey) WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment""")
def hash_skip(spark, d):
    a, b = snapshots(spark, d)
    attributes = list(CUSTOMER.attributes[1:])
    stored = a.select("c_custkey", diff.content_hash(attributes).alias("hash"), F.lit("normal").alias("status"), F.lit(diff.schema_fingerprint(attributes)).alias("fingerprint"))
    return diff.unchanged(b, stored, ["c_custkey"], attributes).select("c_custkey")


@query_for(f"""WITH {CHANGED} SELECT c_custkey FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""")
def deletion_detection(spark, d):
    return diff.deletions(*snapshots(spark, d), ["c_custkey"])


@query_for("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS value, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY 1""")
def single_value_conflict(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    value, conflict = diff.single(F.col("p"))
    return rows.select("o_custkey", value.alias("value"), conflict.alias("conflict"))


@query_for("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE NOT starts_with(o_orderpriority, '1')) ), ',') AS left_over FROM orders
    GROUP BY 1 HAVING count(*) FILTER (WHERE NOT starts_with(o_orderpriority, '1')) > 0""")
def applied_changes(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    gone = F.filter("p", lambda x: x.startswith("1"))
    return rows.select("o_custkey", F.array_join(F.array_sort(diff.applied(F.col("p"), gone, F.array().cast("array<string>"))), ",").alias("left_over")).filter("left_over <> ''")


@query_for("""WITH h AS (SELECT s_suppkey, 1 AS rule, c_custkey FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name) WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 2, c_custkey FROM supplier JOIN customer ON s_nationkey * 1000 + floor(s_acctbal / 500) = c_nationkey * 1000 + floor(c_acctbal / 500)),
    f AS (SELECT s_suppkey, min(rule) AS rule FROM h GROUP BY 1), n AS (SELECT s_suppkey, rule, count(DISTINCT c_custkey) AS n, min(c_custkey) AS c FROM h JOIN f USING (s_suppkey, rule) GROUP BY 1, 2)
    SELECT s.s_suppkey, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'joined' END AS outcome, rule, CASE WHEN n = 1 THEN c END AS c_custkey
    FROM supplier s LEFT JOIN n USING (s_suppkey)""")
def match_cascade(spark, d):
    s = table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"),
        (F.col("s_nationkey") * 1000 + F.floor(F.col("s_acctbal") / 500)).alias("bucket"),
    )
    c = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") * 1000 + F.floor(F.col("c_acctbal") / 500)).alias("bucket"))
    rules = [match.MatchRule(1, "name", "c_name"), match.MatchRule(2, "bucket", "bucket", Kind.LONG)]
    return match.match_cascade(s, c, rules, "s_suppkey", "c_custkey")


@query_for("""SELECT event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) > 1)""")
def duplicate_keys_rejected(spark, d):
    return match.reject_duplicates(table(spark, d, "events"), ["user_id", "event_type"])[1].select("event_id")


@query_for("""WITH r AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 5 = 0 THEN 'x' || l_partkey ELSE l_partkey::VARCHAR END AS raw FROM lineitem),
    o AS (SELECT p_partkey::VARCHAR AS e, count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1)
    SELECT DISTINCT key, raw, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN 'p' || raw END AS object_id FROM r LEFT JOIN o ON raw = e""")
def reference_resolution(spark, d):
    raw = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("x"), "l_partkey")).otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set(raw).alias("refs"))
    p = table(spark, d, "part").select(F.lit("part").alias("type"), F.col("p_partkey").cast("string").alias("external_id"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("type"), F.col("s_suppkey").cast("string").alias("external_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return match.resolve_references(rows, p.union(s), "key", "refs")


@query_for("""SELECT p_partkey, p_size % 2 = 0 AND p_size <> 10 AS in_scope FROM part""")
def container_scope(spark, d):
    path = F.concat_ws("/", F.lit("root"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"), F.col("p_size").cast("string"), "p_partkey")
    rules = spark.createDataFrame([("root/even", True, True), ("root/even/10", False, True), ("root/odd", True, False)], "path string, include boolean, subtree boolean")
    return match.container_scope(table(spark, d, "part").select("p_partkey", path.alias("path")), rules, "path").select("p_partkey", "in_scope")


CONTRIBUTIONS = """c AS (SELECT o_custkey AS k, 'value' AS state, max(o_orderpriority) AS value, 1 AS rule, 2 AS priority, 10 AS mapping_id, false AS niv FROM orders GROUP BY 1
    UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'na' WHEN c_custkey % 4 = 1 THEN 'none' ELSE 'value' END, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment END, 2, 1, 20, c_custkey % 3 = 0 FROM customer
    UNION ALL SELECT user_id, 'value', max(event_type), 3, 2, 5, false FROM events GROUP BY 1)"""


def contributions(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("value"))
    o = o.select("k", F.lit("value").alias("state"), "value", F.lit(1).alias("rule"), F.lit(2).alias("priority"), F.lit(10).alias("mapping_id"), F.lit(False).alias("null_is_value"))
    m = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.when(m == 0, merge.NOT_APPLICABLE).when(m == 1, merge.NO_VALUE).otherwise(merge.WITH_VALUE).alias("state"),
        F.when(m > 1, F.col("c_mktsegment")).alias("value"), F.lit(2).alias("rule"), F.lit(1).alias("priority"), F.lit(20).alias("mapping_id"), (F.col("c_custkey") % 3 == 0).alias("null_is_value"),
    )
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("event_type").alias("value"))
    e = e.select("k", F.lit("value").alias("state"), "value", F.lit(3).alias("rule"), F.lit(2).alias("priority"), F.lit(5).alias("mapping_id"), F.lit(False).alias("null_is_value"))
    return o.union(c).union(e)


PICKED = f"""WITH {CONTRIBUTIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, mapping_id) AS n FROM c WHERE state = 'value' OR (state = 'none' AND niv))"""


@query_for(f"""{PICKED} SELECT t.k, CASE WHEN n IS NULL THEN 'no_contributor' WHEN state = 'value' THEN 'value' ELSE 'asserted_null' END AS outcome, value, rule, mapping_id
    FROM (SELECT DISTINCT k FROM c) t LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (k)""")
def priority_merge(spark, d):
    return merge.resolve(contributions(spark, d), ["k"])


@query_for(f"""{PICKED} SELECT k, state <> 'value' AS asserted FROM w WHERE n = 1 AND state <> 'value'""")
def priority_null_is_value(spark, d):
    return merge.resolve(contributions(spark, d), ["k"]).filter("outcome = 'asserted_null'").select("k", F.lit(True).alias("asserted"))


@query_for(f"""WITH {CONTRIBUTIONS}, x AS (SELECT * FROM c WHERE rule <> 2), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, mapping_id) AS n FROM x WHERE state = 'value')
    SELECT t.k, CASE WHEN n IS NULL THEN 'no_contributor' ELSE 'value' END AS outcome, value, rule, mapping_id FROM (SELECT DISTINCT k FROM c) t LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (k)""")
def reelection(spark, d):
    return merge.reelect(contributions(spark, d), spark.range(1).select(F.lit(2).alias("rule")), ["k"], ["rule"])


@query_for(f"""{PICKED}, v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN rule = 3 THEN 0 ELSE priority END, mapping_id) AS n FROM c WHERE state = 'value' OR (state = 'none' AND niv))
    SELECT k, w.value IS DISTINCT FROM v.value AS value_changed, w.rule <> v.rule AS owner_changed FROM (SELECT * FROM w WHERE n = 1) w JOIN (SELECT * FROM v WHERE n = 1) v USING (k)
    WHERE w.rule <> v.rule OR w.value IS DISTINCT FROM v.value""")
def provenance_takeover(spark, d):
    c = contributions(spark, d)
    later = c.withColumn("priority", F.when(F.col("rule") == 3, 0).otherwise(F.col("priority")))
    return merge.provenance_changes(merge.resolve(c, ["k"]), merge.resolve(later, ["k"]), ["k"])


# --- outbound, confirmation -------------------------------------------------------------------------------------

MAPPINGS = [
    outbound.ExportMapping("c_name", Attribute("name")),
    outbound.ExportMapping("c_mktsegment", Attribute("segment")),
    outbound.ExportMapping("c_nationkey", Attribute("nation", Kind.NUMBER, write=Write.ON_CREATE)),
    outbound.ExportMapping("c_acctbal", Attribute("off"), enabled=False),
]


def target_rows(spark, d) -> DataFrame:
    t = table(spark, d, "customer").filter("c_custkey % 5 <> 0")
    return t.select(
        "c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("segment"), (F.col("c_nationkey") + 1).alias("nation")
    )


@query_for("""SELECT c_custkey, 'create' AS change, attr, 'update' AS op, value FROM (SELECT c_custkey, 'name' AS attr, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer) WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'update', 'segment', 'update', c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AND c_mktsegment <> 'OLD'""")
def outbound_delta(spark, d):
    return outbound.outbound_delta(table(spark, d, "customer"), target_rows(spark, d), "c_custkey", MAPPINGS)


@query_for("""SELECT 'segment' AS attr, count(*) AS skipped FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0
    UNION ALL SELECT 'name', count(*) FROM customer WHERE c_custkey % 5 <> 0""")
def no_net_change(spark, d):
    c = table(spark, d, "customer")
    changes = to_eav(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), ["c_custkey"], [Attribute("name"), Attribute("segment")])
    held = to_eav(target_rows(spark, d), ["c_custkey"], [Attribute("name"), Attribute("segment")])
    return outbound.without_no_ops(changes.withColumn("op", F.lit("update")), held, "c_custkey")[1]


@query_for("""WITH c AS (SELECT user_id, event_type AS attr, event_type < 'm' AS many, event_id AS seq, event_id % 4 = 0 AS drift, CASE WHEN event_id % 3 > 0 THEN 'v' || event_id % 3 END AS value, CASE WHEN event_id % 10 = 0 THEN 'r' || event_id % 20 END AS reference,
        CASE WHEN event_id % 11 = 0 THEN 'replace' WHEN event_id % 13 = 0 THEN 'remove_all' WHEN event_type >= 'm' THEN 'update' WHEN event_id % 2 = 0 THEN 'add' ELSE 'remove' END AS op FROM events),
    best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, attr, CASE WHEN many THEN coalesce(reference, value, '') END ORDER BY drift, seq DESC) = 1)
    SELECT user_id, attr, op, coalesce(reference, value, '') AS value, seq, drift FROM best b WHERE NOT EXISTS (SELECT 1 FROM c w WHERE w.user_id = b.user_id AND w.attr = b.attr AND w.op IN ('replace', 'remove_all')
        AND ((NOT w.drift AND (b.drift OR w.seq > b.seq)) OR (w.drift AND b.drift AND w.seq > b.seq)))""")
def change_merge(spark, d):
    """Single values and lists, with references, by current evaluation and by drift, among them whole replacements."""
    i, many = F.col("event_id"), F.col("event_type") < "m"
    op = F.when(i % 11 == 0, "replace").when(i % 13 == 0, "remove_all").when(~many, "update").when(i % 2 == 0, "add").otherwise("remove")
    c = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("attr"), many.alias("many"), op.alias("op"), F.when(i % 3 > 0, F.concat(F.lit("v"), i % 3)).alias("value"),
        F.when(i % 10 == 0, F.concat(F.lit("r"), i % 20)).alias("reference"), i.alias("seq"), (i % 4 == 0).alias("drift"),
    )
    return outbound.merge_changes(c, "user_id").select("user_id", "attr", "op", F.coalesce("reference", "value", F.lit("")).alias("value"), "seq", "drift")


@query_for("""WITH p AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS change, CASE WHEN event_id % 4 = 0 THEN 'exported' ELSE 'pending' END AS status FROM events),
    f AS (SELECT user_id, bool_or(status = 'pending' AND change = 'create') AS c, bool_or(status = 'pending' AND change = 'delete') AS d FROM p GROUP BY 1)
    SELECT event_id FROM p JOIN f USING (user_id) WHERE NOT (status = 'pending' AND d AND (change IN ('create', 'update') OR (change = 'delete' AND c)))""")
def create_delete_cancel(spark, d):
    m = F.col("event_id") % 3
    p = table(spark, d, "events").select(
        "event_id", "user_id", F.when(m == 0, "create").when(m == 1, "update").otherwise("delete").alias("change"), F.when(F.col("event_id") % 4 == 0, "exported").otherwise("pending").alias("status")
    )
    return outbound.cancelled_pairs(p, "user_id").select("event_id")


def sent_changes(spark, d) -> DataFrame:
    """What should hold of customers' segments and names."""
    c = to_eav(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), ["c_custkey"], [Attribute("name"), Attribute("segment")])
    return c.withColumn("op", F.when((F.col("c_custkey") % 6 == 0) & (F.col("attr") == "segment"), "remove").otherwise("update"))


SENT = """e AS (SELECT c_custkey, 'name' AS attr, c_name AS value, 'update' AS op, c_custkey % 5 <> 0 AS ok FROM customer UNION ALL
    SELECT c_custkey, 'segment', c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 'remove' ELSE 'update' END,
    CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 ELSE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 END FROM customer)"""


@query_for(f"""WITH {SENT} SELECT c_custkey, attr, op, ok AS confirmed FROM e""")
def confirm_changes(spark, d):
    held = to_eav(target_rows(spark, d), ["c_custkey"], [Attribute("name"), Attribute("segment")])
    return confirm.confirmed_changes(sent_changes(spark, d), held, "c_custkey").select("c_custkey", "attr", "op", "confirmed")


@query_for(f"""WITH {SENT}, s AS (SELECT *, CASE WHEN ok THEN 'confirmed' WHEN c_custkey % 8 >= 5 THEN 'failed' ELSE 'not_confirmed' END AS st FROM e)
    SELECT c_custkey, CASE WHEN count(*) FILTER (WHERE st = 'failed') = count(*) FILTER (WHERE st <> 'confirmed') THEN 'failed' ELSE 'not_confirmed' END AS status,
    CASE WHEN c_custkey % 2 = 0 AND NOT bool_or(attr = 'name' AND ok) THEN 'create' ELSE 'update' END AS change, count(*) FILTER (WHERE st <> 'confirmed') AS open
    FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE st <> 'confirmed') > 0""")
def confirm_state(spark, d):
    held = to_eav(target_rows(spark, d), ["c_custkey"], [Attribute("name"), Attribute("segment")])
    rows = confirm.confirmed_changes(sent_changes(spark, d), held, "c_custkey").select(
        "c_custkey", "attr", "confirmed", F.when(F.col("c_custkey") % 2 == 0, "create").otherwise("update").alias("change"), (F.col("attr") == "name").alias("second_key"), (F.col("c_custkey") % 8).alias("attempts")
    )
    return confirm.confirm_state(rows, "c_custkey")


@query_for("""SELECT o_custkey, 'p' AS attr, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1""")
def optimistic_apply(spark, d):
    o = table(spark, d, "orders")
    sent = o.select("o_custkey", F.lit("update").alias("change"), F.lit("p").alias("attr"), F.lit("update").alias("op"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    held = o.select("o_custkey", F.lit("p").alias("attr"), F.lit("old").alias("value"))
    return confirm.optimistic(held, sent, "o_custkey").select("o_custkey", "attr", F.array_join("values", ",").alias("value"))


@query_for("""SELECT l_orderkey, floor((n - 1) / 2)::INT AS chunk, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts
    FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) GROUP BY 1, 2""")
def chunked_changes(spark, d):
    rows = outbound.chunked(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", 2)
    return rows.select("l_orderkey", "chunk", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("parts"))


@query_for("""WITH RECURSIVE e AS (SELECT event_id, event_type, event_id // 2000 AS part, length(props) * 10 AS n, row_number() OVER (PARTITION BY event_type, event_id // 2000 ORDER BY event_id) AS k FROM events),
    r AS (SELECT event_id, event_type, part, k, CASE WHEN n > 500 THEN NULL ELSE 0 END AS batch, 0 AS at, CASE WHEN n > 500 THEN 0 ELSE n END AS held, CASE WHEN n > 500 THEN 0 ELSE 1 END AS many FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.event_type, e.part, e.k, CASE WHEN e.n > 500 THEN NULL WHEN r.many > 0 AND (r.many >= 20 OR r.held + e.n > 500) THEN r.at + 1 ELSE r.at END,
    CASE WHEN e.n <= 500 AND r.many > 0 AND (r.many >= 20 OR r.held + e.n > 500) THEN r.at + 1 ELSE r.at END,
    CASE WHEN e.n > 500 THEN r.held WHEN r.many > 0 AND (r.many >= 20 OR r.held + e.n > 500) THEN e.n ELSE r.held + e.n END,
    CASE WHEN e.n > 500 THEN r.many WHEN r.many > 0 AND (r.many >= 20 OR r.held + e.n > 500) THEN 1 ELSE r.many + 1 END
    FROM r JOIN e ON e.event_type = r.event_type AND e.part = r.part AND e.k = r.k + 1) SELECT event_id, part::BIGINT AS part, batch::INT AS batch FROM r""")
def size_batches(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 2000).alias("part"), (F.length("props") * 10).alias("n"))
    return outbound.size_batches(rows, "event_id", "n", 500, 20, ["event_type", "part"]).select("event_id", "part", "batch")


@query_for("""WITH c AS (SELECT o_custkey, o_orderkey AS seq, ['add', 'remove', 'add', 'update', 'remove', 'add', 'add', 'remove_all', 'add', 'add', 'add'][1 + o_orderkey % 11] AS op, o_orderpriority AS v FROM orders),
    h AS (SELECT DISTINCT o_custkey, '3-MEDIUM' AS v FROM orders WHERE o_custkey % 2 = 0), w AS (SELECT o_custkey, max(seq) AS since FROM c WHERE op IN ('update', 'remove_all') GROUP BY 1),
    x AS (SELECT o_custkey, v, -1 AS seq, true AS held FROM h UNION ALL SELECT o_custkey, v, seq, op <> 'remove' FROM c WHERE op <> 'remove_all'),
    l AS (SELECT o_custkey, v, arg_max(held, seq) AS held, max(seq) AS seq FROM x GROUP BY 1, 2)
    SELECT l.o_custkey, 'p' AS attr, v AS value FROM l LEFT JOIN w USING (o_custkey) WHERE held AND (since IS NULL OR seq >= since)""")
def optimistic_values(spark, d):
    o = table(spark, d, "orders")
    ops = F.array(*map(F.lit, ("add", "remove", "add", "update", "remove", "add", "add", "remove_all", "add", "add", "add")))
    sent = o.select("o_custkey", F.lit("update").alias("change"), F.lit("p").alias("attr"), F.get(ops, (F.col("o_orderkey") % 11).cast("int")).alias("op"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    held = o.filter("o_custkey % 2 = 0").select("o_custkey", F.lit("p").alias("attr"), F.lit("3-MEDIUM").alias("value"))
    return confirm.optimistic_values(held, sent, "o_custkey")


@query_for("""SELECT c_custkey, 1 AS system, 'segment' AS attr, c_mktsegment AS value FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 3 = 0 AND c_mktsegment <> 'OLD')""")
def drift_corrections(spark, d):
    expected = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("system"), F.explode(F.map_from_arrays(F.array(F.lit("segment"), F.lit("name")), F.array("c_mktsegment", "c_name"))).alias("attr", "value"))
    actual = to_eav(target_rows(spark, d), ["c_custkey"], [Attribute("segment"), Attribute("name")]).withColumn("system", F.lit(1)).drop("kind")
    return outbound.drift(expected, actual, spark.range(1).select(F.lit(1).alias("system"), F.lit("name").alias("attr")), "c_custkey")


# --- lifecycle --------------------------------------------------------------------------------------------------


def connected(spark, d) -> DataFrame:
    n = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("remaining"))
    c = table(spark, d, "customer").join(n, "c_custkey", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    m = F.col("c_custkey") % 4
    return c.withColumn("rule", F.when(m == 0, "manual").when(m == 1, "last_connector").when(m == 2, "authoritative")).withColumn("origin", F.when(F.col("c_custkey") % 9 == 0, "internal").otherwise("projected"))


LIFE = """c AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS remaining, CASE c_custkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'last_connector' WHEN 2 THEN 'authoritative' END AS rule,
    CASE WHEN c_custkey % 9 = 0 THEN 'internal' ELSE 'projected' END AS origin FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL)"""


@query_for(f"""WITH {LIFE}, x AS (SELECT *, CASE WHEN rule IS NULL OR origin = 'internal' OR rule = 'manual' THEN 'keep' WHEN rule = 'last_connector' THEN CASE WHEN remaining = 0 THEN 'delete' ELSE 'keep' END
    ELSE CASE WHEN c_nationkey IN (1, 2, 3, 4, 5) THEN 'delete' ELSE 'keep' END END AS decision FROM c)
    SELECT c_custkey, decision, CASE WHEN decision <> 'delete' THEN 'none' WHEN c_nationkey % 3 = 0 THEN 'immediate' ELSE 'scheduled' END AS timing FROM x""")
def deletion_rules(spark, d):
    rows = connected(spark, d)
    decision = lifecycle.deletion_decision(
        F.col("origin"), F.col("rule"), F.col("remaining"), F.col("c_nationkey"), F.lit("specific"), F.array(*map(F.lit, (1, 2, 3, 4, 5))), F.col("remaining")
    )
    return rows.select("c_custkey", decision.alias("decision"), lifecycle.deletion_timing(decision, F.col("c_nationkey") % 3).alias("timing"))


@query_for(f"""WITH {LIFE} SELECT c_custkey FROM c WHERE origin = 'projected' AND rule IN ('authoritative', 'last_connector') AND (rule = 'authoritative' OR remaining = 0)
    AND TIMESTAMP '1997-12-20' + INTERVAL (c_nationkey) DAY <= TIMESTAMP '1998-01-01 12:30:00' ORDER BY c_custkey LIMIT 50""")
def eligible_for_deletion(spark, d):
    rows = connected(spark, d).select(F.col("c_custkey").alias("id"), "origin", "rule", "remaining", F.lit(datetime(1997, 12, 20)).cast("timestamp").alias("marked_at"), F.col("c_nationkey").alias("grace_days"))
    return lifecycle.eligible_for_deletion(rows, NOW, 50).select(F.col("id").alias("c_custkey"))


@query_for("""SELECT o_orderkey, CASE WHEN o_custkey % 7 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN o_custkey % 7 + 1 < 5 THEN o_orderdate + INTERVAL (least(3600, 60 * 2 ** (o_custkey % 7))::INT) SECOND END AS next_retry_at FROM orders""")
def export_backoff(spark, d):
    status, at = lifecycle.retry((F.col("o_custkey") % 7).cast("int"), F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"), at.alias("next_retry_at"))


# --- incremental ------------------------------------------------------------------------------------------------


@query_for("""SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)""")
def delta_watermark(spark, d):
    e = table(spark, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return relational.changed_since(e.select("event_id", "ts"), "ts", low + (high - low) / 2)


@query_for("""SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01')""")
def delta_related(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return relational.changed_with_related(o, "o_orderkey", ("o_orderdate", datetime(1998, 1, 1)), [(line, "l_orderkey", "l_shipdate", datetime(1998, 6, 1))]).select("o_orderkey")


@query_for("""WITH l AS (SELECT user_id, arg_max(CASE event_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END, event_id) AS k FROM events WHERE event_id > 100 GROUP BY 1)
    SELECT user_id, CASE WHEN k = 'D' THEN 'delete' ELSE 'upsert' END AS change, CASE WHEN k <> 'D' THEN c_name END AS c_name FROM l LEFT JOIN customer ON c_custkey = user_id WHERE k = 'D' OR c_custkey IS NOT NULL""")
def changelog_latest(spark, d):
    m = F.col("event_id") % 5
    log = table(spark, d, "events").select("user_id", "event_id", F.when(m == 0, "D").when(m == 1, "I").otherwise("U").alias("kind"))
    return relational.change_log(log, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "event_id", "kind", 100)


@query_for("""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 5 <> 0""")
def cdc_merge(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 5 == 0, "D").otherwise("U"))
    before = stream.merge_batch(e.limit(0), e.filter("event_id % 2 = 0"), "user_id", "event_id", "kind")
    return stream.merge_batch(before, e, "user_id", "event_id", "kind").select("event_id", "event_type")


@query_for("""SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 200)""")
def retention_keep(spark, d):
    return files.retained(table(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id", datetime(2024, 1, 15), 200).select("event_id", "event_type")


@query_for(f"""WITH {CHANGED} SELECT c_custkey, c_mktsegment FROM b UNION ALL SELECT c_custkey, c_mktsegment FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""")
def upsert(spark, d):
    a, b = snapshots(spark, d)
    return files.upsert(a, b, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query_for(f"""WITH {CHANGED} SELECT c_custkey, c_name, c_mktsegment FROM b UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) AND c_custkey % 20 <> 13""")
def full_state_export(spark, d):
    a, b = snapshots(spark, d)
    gone = a.filter("c_custkey % 20 = 13").withColumn("change", F.lit("delete"))
    changes = b.withColumn("change", F.lit("update")).unionByName(gone)
    return files.merged_state(a.select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query_for("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment, array_to_string(list_sort(list_distinct(['t' || c_custkey % 3, 't' || c_custkey % 5])), ',') AS tags FROM customer""")
def cleared_state_export(spark, d):
    """A file of full state brought to the merged rows by their delta: new objects, values cleared, lists changed."""
    k = F.col("c_custkey")
    want = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 7 > 0, F.col("c_mktsegment")).alias("segment"), F.array_distinct(F.array(F.concat(F.lit("t"), k % 3), F.concat(F.lit("t"), k % 5))).alias("tags"))
    have = target_rows(spark, d).select("c_custkey", "name", "segment", F.array(F.concat(F.lit("t"), k % 2)).alias("tags"))
    attributes = [Attribute("name"), Attribute("segment"), Attribute("tags", many=True)]
    delta = outbound.outbound_delta(want, have, "c_custkey", [outbound.ExportMapping(a.name, a, a.many) for a in attributes])
    after = files.merged_state(have, files.as_state_changes(delta, have, "c_custkey", attributes), "c_custkey")
    return after.select("c_custkey", "name", "segment", F.array_join(F.array_sort("tags"), ",").alias("tags"))


# --- statistics -------------------------------------------------------------------------------------------------


@query_for("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS large,
    greatest(count(*) - count(*) FILTER (WHERE value > 50), 0) AS rest FROM events GROUP BY 1""")
def activity_stats(spark, d):
    t = F.col("event_type")
    rows = summarise.conditional_counts(table(spark, d, "events"), ["user_id"], {"clicks": t == "click", "purchases": t == "purchase", "large": F.col("value") > 50, "n": F.lit(True)})
    return rows.select("user_id", "clicks", "purchases", "large", summarise.remainder(F.col("n"), F.col("large")).alias("rest"))


@query_for("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def count_by_dimension(spark, d):
    rows = summarise.count_map(table(spark, d, "events"), ["user_id"], "event_type")
    return rows.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


PAIRS = """p AS (SELECT o_orderstatus AS s, o_orderpriority AS old, l_returnflag AS new FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@query_for(f"""WITH {PAIRS}, f AS (SELECT s, old, new, count(*) AS n FROM p GROUP BY ALL) SELECT s, sum(n)::BIGINT AS n, count(*) AS pairs, count(*) > 14 AS collapsed FROM f GROUP BY s""")
def preview_summary(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("new"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("old")).join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return summarise.preview_summary(rows, ["s"], ("old", "new"), 14)[0]


@query_for("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""")
def capped_samples(spark, d):
    return summarise.capped_samples(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


@query_for("""SELECT c_nationkey, CASE WHEN c_nationkey % 4 = 0 THEN 'casing' WHEN c_nationkey % 4 = 1 THEN 'prefixx-' WHEN c_nationkey % 4 = 2 THEN 'a.org to b.org' END AS pattern FROM customer GROUP BY 1, 2""".replace("prefixx-", "prefix+x-"))
def change_patterns(spark, d):
    m, n = F.col("c_nationkey") % 4, F.col("c_name")
    old = F.when(m == 2, F.concat(n, F.lit("@a.org"))).otherwise(n)
    new = F.when(m == 0, F.upper(n)).when(m == 1, F.concat(F.lit("x-"), n)).when(m == 2, F.concat(n, F.lit("@b.org"))).otherwise(F.lit("?"))
    return summarise.group_pattern(table(spark, d, "customer").select("c_nationkey", old.alias("old"), new.alias("new")), ["c_nationkey"])


@query_for("""SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS latest""")
def latest_of_two(spark, d):
    return summarise.latest_of(table(spark, d, "orders").select(F.col("o_orderdate").alias("at")), table(spark, d, "lineitem").select(F.col("l_shipdate").alias("at")), "at")


# --- without SQL ------------------------------------------------------------------------------------------------


@query_for(None)
def synthetic_people(spark, d):
    g = synthetic.Generator
    make = {
        "department": g("words", values={"Sales": 3, "IT": 1, "HR": 1}),
        "number": g("sequence", low=1000),
        "account": g("pattern", pattern="{department}.{number}[unique]"),
        "salary": g("decimal", low=20_000, high=90_000, filled=0.9),
        "hired": g("date", low="2010-01-01", high="2024-01-01"),
        "active": g("boolean", share=0.9),
        "manager": g("manager", share=0.95),
        "groups": g("references", low=0, high=4, targets=50),
    }
    return synthetic.generate(spark, 10_000, make, seed=3).withColumn("groups", F.array_join(F.transform("groups", lambda x: x.cast("string")), ","))


@query_for("""WITH m AS (SELECT s_suppkey, count(*) AS n, min(c_custkey) AS c FROM supplier JOIN customer ON s_nationkey * 1000 + floor(s_acctbal / 500) = c_nationkey * 1000 + floor(c_acctbal / 500) GROUP BY 1),
    j AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s_suppkey) AS k FROM m WHERE n = 1)
    SELECT s.s_suppkey AS external_id, CASE WHEN m.n IS NULL THEN 'none' WHEN m.n > 1 THEN 'ambiguous' WHEN k > 1 THEN 'already_joined' ELSE 'joined' END AS outcome
    FROM supplier s LEFT JOIN m USING (s_suppkey) LEFT JOIN j USING (s_suppkey)""")
def reconciliation_run(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    s = s.withColumn("bucket", F.col("s_nationkey") * 1000 + F.floor(F.col("s_acctbal") / 500))
    c = c.select(F.col("c_custkey").alias("entity"), (F.col("c_nationkey") * 1000 + F.floor(F.col("c_acctbal") / 500)).alias("bucket"))
    supplier = ObjectType("supplier", (Attribute("s_suppkey", Kind.LONG), Attribute("s_name"), Attribute("s_nationkey", Kind.NUMBER)), "s_suppkey")
    person = ObjectType("party", (Attribute("name"), Attribute("nation", Kind.NUMBER)), "name")
    flows = (pipeline.Flow(1, "name", "s_name"), pipeline.Flow(2, "nation", expression='cs["s_nationkey"] + 1'))
    rule = pipeline.ImportRule(1, supplier, flows, (match.MatchRule(1, "bucket", "bucket", Kind.LONG),))
    run = pipeline.full_run({1: s}, {1: s}, c, [rule], person, NOW)
    return run.outcomes.select(F.col("external_id").cast("long").alias("external_id"), "outcome")


RUN = """j AS (SELECT s_suppkey, s_suppkey * 2 AS entity FROM supplier WHERE s_suppkey % 3 = 0), inc AS (SELECT * FROM supplier WHERE s_suppkey % 10 <> 1), sc AS (SELECT * FROM inc WHERE s_nationkey < 20),
    gone AS (SELECT j.*, CASE WHEN j.s_suppkey NOT IN (SELECT s_suppkey FROM inc) THEN 'deleted' ELSE 'out_of_scope' END AS reason FROM j WHERE j.s_suppkey NOT IN (SELECT s_suppkey FROM sc)),
    held AS (SELECT * FROM j WHERE s_suppkey NOT IN (SELECT s_suppkey FROM gone)), new AS (SELECT * FROM sc WHERE s_suppkey NOT IN (SELECT s_suppkey FROM held)),
    m AS (SELECT s_suppkey, count(*) AS n, min(c_custkey) AS c FROM new JOIN customer ON s_nationkey * 1000 + floor(s_acctbal / 500) = c_nationkey * 1000 + floor(c_acctbal / 500) GROUP BY 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s_suppkey) AS k FROM m WHERE n = 1),
    o AS (SELECT s_suppkey, 'kept' AS outcome, entity FROM held UNION ALL SELECT new.s_suppkey, CASE WHEN m.n IS NULL THEN 'none' WHEN m.n > 1 THEN 'ambiguous' WHEN k > 1 OR k.c IN (SELECT entity FROM held) THEN 'already_joined' ELSE 'joined' END,
        CASE WHEN k = 1 AND k.c NOT IN (SELECT entity FROM held) THEN k.c END FROM new LEFT JOIN m USING (s_suppkey) LEFT JOIN k USING (s_suppkey))"""


def whole_run(spark, d) -> pipeline.Run:
    """Suppliers joined before by key, of which some left, some fell out of scope, and the others are matched."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    s = s.withColumn("bucket", F.col("s_nationkey") * 1000 + F.floor(F.col("s_acctbal") / 500)).withColumn("mate", (F.col("s_suppkey") + 3).cast("string"))
    canonical = c.select(F.col("c_custkey").alias("entity"), (F.col("c_nationkey") * 1000 + F.floor(F.col("c_acctbal") / 500)).alias("bucket"))
    supplier = ObjectType("supplier", (Attribute("s_suppkey", Kind.LONG), Attribute("s_name"), Attribute("s_nationkey", Kind.NUMBER), Attribute("mate", Kind.REFERENCE)), "s_suppkey")
    scope = (Group((Criterion("s_nationkey", "lt", 20),)),)
    rule = pipeline.ImportRule(1, supplier, (pipeline.Flow(1, "name", "s_name"),), (match.MatchRule(1, "bucket", "bucket", Kind.LONG),), scope, project=False)
    joins = s.filter("s_suppkey % 3 = 0").select(F.lit(1).alias("rule"), F.col("s_suppkey").cast("string").alias("external_id"), (F.col("s_suppkey") * 2).alias("entity"))
    k = F.col("c_custkey")
    lives = c.select(k.alias("entity"), F.when(k % 4 == 0, "internal").otherwise("projected").alias("origin"), F.lit("last_connector").alias("rule"), (k % 5).cast("int").alias("grace_days"))
    return pipeline.full_run({1: s}, {1: s.filter("s_suppkey % 10 <> 1")}, canonical, [rule], ObjectType("party", (Attribute("name"),), "name"), NOW, joins, lives)


@query_for(f"""WITH {RUN} SELECT s_suppkey AS external_id, outcome, entity FROM o""")
def run_outcomes(spark, d):
    return whole_run(spark, d).outcomes.select(F.col("external_id").cast("long").alias("external_id"), "outcome", "entity")


@query_for(f"""WITH {RUN} SELECT g.s_suppkey AS external_id, g.entity, reason, count(o.s_suppkey) AS remaining, CASE WHEN g.entity % 4 = 0 OR count(o.s_suppkey) > 0 THEN 'keep' ELSE 'delete' END AS decision,
    CASE WHEN g.entity % 4 = 0 OR count(o.s_suppkey) > 0 THEN 'none' WHEN g.entity % 5 = 0 THEN 'immediate' ELSE 'scheduled' END AS timing FROM gone g LEFT JOIN o ON o.entity = g.entity GROUP BY 1, 2, 3""")
def run_disconnections(spark, d):
    run = whole_run(spark, d)
    return run.disconnected.join(run.deletions, "entity").select(F.col("external_id").cast("long").alias("external_id"), "entity", "reason", "remaining", "decision", "timing")


@query_for(f"""WITH {RUN} SELECT i.s_suppkey AS external_id, CASE WHEN o.entity IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, o.entity FROM inc i LEFT JOIN o ON o.s_suppkey = i.s_suppkey + 3 AND o.entity IS NOT NULL""")
def run_references(spark, d):
    return whole_run(spark, d).references.select(F.col("external_id").cast("long").alias("external_id"), "state", "entity")


# --- more joins, sinks and counts -------------------------------------------------------------------------------


@query_for("""SELECT o_orderkey, s_suppkey AS staged_id FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def import_match(spark, d):
    staged = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_suppkey").alias("id"))
    return match.import_match(table(spark, d, "orders"), staged, ["o_custkey"]).select("o_orderkey", "staged_id")


@query_for("""WITH m AS (SELECT s_suppkey, s_nationkey AS cid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
    SELECT s_suppkey, CASE WHEN n > 1 OR cid < 5 THEN 'already_joined' ELSE 'joined' END AS outcome FROM m""")
def claim_once(spark, d):
    m = table(spark, d, "supplier").select("s_suppkey", F.lit("joined").alias("outcome"), F.lit(1).alias("rule"), F.col("s_nationkey").alias("cid"))
    held = table(spark, d, "nation").filter("n_nationkey < 8").select((F.col("n_nationkey") + 1_000_000).alias("s_suppkey"), F.col("n_nationkey").alias("cid"))
    return match.claim_once(m, held, held.filter("cid >= 5").select("s_suppkey"), "s_suppkey", "cid").select("s_suppkey", "outcome")


@query_for("""SELECT DISTINCT o_orderkey AS owner, o_custkey AS ref, o_orderkey % 2 = 0 AS held FROM orders WHERE o_custkey % 10 = 1""")
def reference_recall(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), F.lit("customer").alias("attr"), F.col("o_custkey").alias("ref"))
    gone = table(spark, d, "customer").filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("id"))
    return match.referencing(gone, refs, refs.filter("owner % 2 = 0")).select("owner", "ref", "held").distinct()


@query_for("""SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def purged_references(spark, d):
    changes = table(spark, d, "events").select("event_id", F.concat(F.lit("CN="), "user_id").alias("reference"))
    gone = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("cn="), "c_custkey").alias("external_id"))
    return outbound.purge_references(changes, gone).select("event_id")


@query_for("""SELECT o_orderkey AS staged_id, CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'delete' ELSE 'disconnect' END AS action,
    CASE WHEN o_orderpriority[1:1] NOT IN ('1', '2') THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'reuse' WHEN o_orderkey % 3 = 1 THEN 'replace' ELSE 'new' END AS export
    FROM orders WHERE o_custkey % 5 = 0""")
def deletion_exports(spark, d):
    o = table(spark, d, "orders")
    connectors = o.select(F.col("o_orderkey").alias("staged_id"), F.col("o_custkey").alias("target_id"), F.left("o_orderpriority", F.lit(1)).alias("system"), F.lit("user").alias("type"))
    gone = table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("target_id"))
    rules = spark.createDataFrame([("1", "user", "delete"), ("1", "user", "disconnect"), ("2", "user", "delete"), ("3", "user", "disconnect")], "system string, type string, on_delete string")
    pending = o.filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("staged_id"), F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("update").alias("change"))
    return lifecycle.deletion_exports(gone, connectors, rules, pending).select("staged_id", "action", "export")


@query_for("""SELECT event_type, (count(*) + count(*) FILTER (WHERE event_id % 2 = 0))::BIGINT AS n FROM events GROUP BY 1""")
def added_counters(spark, d):
    e = table(spark, d, "events")
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    return summarise.add_counters(count(e), count(e.filter("event_id % 2 = 0")), ["event_type"], ["n"])


@query_for("""SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL""")
def distinct_options(spark, d):
    return summarise.options(table(spark, d, "events"), "event_type")


@query_for("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 4 <> 2
    UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation""")
def applied_statements(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_name")
    m = F.col("s_suppkey") % 4
    changes = t.filter(m.isin(1, 2)).select("s_suppkey", F.when(m == 1, "update").otherwise("delete").alias("op"), F.upper("s_name").alias("s_name"))
    new = table(spark, d, "nation").select(F.lit(None).cast("long").alias("s_suppkey"), F.lit("insert").alias("op"), F.col("n_name").alias("s_name"))
    return files.apply_dml(t, changes.union(new), "s_suppkey", generated="s_name")[0]


@query_for("""SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'type_conflict' WHEN o_custkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'recall_skipped' WHEN o_custkey % 7 = 0 THEN 'reuse_pending'
    WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'provision' ELSE 'declined' END WHEN o_orderstatus = 'P' THEN 'irrelevant' ELSE 'update' END AS decision FROM orders""")
def staging_decisions(spark, d):
    k, s = F.col("o_custkey"), F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_orderkey", (k % 6 == 0).alias("type_conflict"), (k % 5 == 0).alias("recall"), (k % 2 != 0).alias("has_target"), (k % 7 == 0).alias("pending_create"), (s == "F").alias("provisions"), (s != "P").alias("relevant")
    )
    return rows.select("o_orderkey", outbound.staging_decision().alias("decision"))


@query_for("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 3 END AS rule, CASE WHEN c_mktsegment = 'BUILDING' THEN 'remain' ELSE 'disconnect' END AS action FROM customer""")
def projection_rules(spark, d):
    rules = [
        {"id": 1, "type": "BUILDING", "active": True, "projects": True, "out_of_scope": "remain"},
        {"id": 2, "type": "MACHINERY", "active": False, "projects": True, "out_of_scope": "remain"},
        {"id": 3, "type": "MACHINERY", "active": True, "projects": True},
        {"id": 4, "type": "FURNITURE", "active": True, "projects": False},
    ]
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("type"))
    return rows.select("c_custkey", lifecycle.projecting_rule(rules).alias("rule"), lifecycle.out_of_scope_action(rules).alias("action"))


@query_for("""SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1""")
def due_queue(spark, d):
    return lifecycle.due(table(spark, d, "events"), "ts", datetime(2024, 1, 20), "event_type")


@query_for("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    rows = stream.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


@query_for("""SELECT p_partkey, p_name, p_size, p_retailprice::DECIMAL(38,10)::DOUBLE AS price FROM part""")
def csv_columns_typed(spark, d):
    text = table(spark, d, "part").select(*(F.col(c).cast("string").alias(c.upper()) for c in ("p_partkey", "p_name", "p_size", "p_retailprice")))
    t = ObjectType("part", tuple(PART.attribute(n) for n in ("p_partkey", "p_name", "p_size", "p_retailprice")), "p_partkey")
    return files.import_file(text, t)[0].select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("double").alias("price"))


@query_for("""SELECT c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(38,10)::DOUBLE AS balance, c_mktsegment || '|' || c_nationkey::VARCHAR AS tags FROM customer""")
def csv_file_import(spark, d):
    """Writes customers as a CSV file in the shared folder, and imports that: typed columns, a many-valued one, routed by object type."""
    at = f"{scratch(spark)}/customers.csv"
    text = table(spark, d, "customer").select(
        F.lit("Customer").alias("TYPE"), F.col("c_custkey").cast("string").alias("C_CUSTKEY"), F.col("c_name").alias("C_Name"), F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("tags"),
    )
    text.write.mode("overwrite").csv(at, header=True)
    t = ObjectType("customer", (*(CUSTOMER.attribute(n) for n in ("c_custkey", "c_name", "c_nationkey", "c_acctbal")), Attribute("tags", many=True)), "c_custkey")
    rows = files.route_types(files.read_text(spark, at), [t], {"customer"}, "TYPE")[0]["customer"]
    found = files.import_file(rows, t)[0]
    return found.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("balance"), F.array_join("tags", "|").alias("tags"))


# --- decisions by columns ---------------------------------------------------------------------------------------


@query_for("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_custkey % 3 <= c_custkey % 4 END AS takes_over FROM customer""")
def incumbent_gate(spark, d):
    k = F.col("c_custkey")
    owner = F.when(k % 5 != 0, k % 4)
    return table(spark, d, "customer").select("c_custkey", merge.takes_over(k % 3, F.lit(1), owner, F.lit(1)).alias("takes_over"))


@query_for("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'skip' WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'skip' ELSE 'merge' END ELSE 'new' END AS policy FROM orders""")
def recall_policies(spark, d):
    s = F.col("o_orderstatus")
    existing = F.when(s == "F", "delete").when(s == "O", F.when(F.col("o_custkey") % 2 == 0, "create").otherwise("update"))
    return table(spark, d, "orders").select("o_orderkey", outbound.recall_policy(existing).alias("policy"))


@query_for("""SELECT o_orderkey AS owner, 'manager' AS attr, CASE WHEN o_custkey % 2 = 0 THEN 'remove' ELSE 'update' END AS op, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS value
    FROM orders WHERE o_custkey % 2 = 1 OR o_orderstatus = 'O'""")
def recall_shapes(spark, d):
    refs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("owner"), F.lit("manager").alias("attr"), F.col("o_custkey").alias("ref"), (F.col("o_custkey") % 2 == 0).alias("many"), (F.col("o_orderstatus") == "O").alias("held")
    )
    return outbound.recall_changes(refs)


@query_for("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 2 = 0 ELSE true END WHEN 1 THEN true ELSE false END AS cancels,
    CASE c_custkey % 3 WHEN 0 THEN 'disconnect' WHEN 1 THEN 'delete' ELSE 'nothing' END AS export, c_nationkey % 4 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 1 AS marks FROM customer""")
def connector_decisions(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rule = F.when(k % 3 == 0, "authoritative").when(k % 3 == 1, "last_connector").otherwise("manual")
    cancels = lifecycle.cancels_deletion(rule, F.when(k % 2 == 0, "all"), n % 2 == 0)
    action = F.when(k % 3 == 0, "disconnect").when(k % 3 == 1, "delete").otherwise("keep")
    marks = lifecycle.last_connector_marker(n % 4, F.when(k % 5 == 0, "internal").otherwise("projected"), rule)
    return table(spark, d, "customer").select("c_custkey", cancels.alias("cancels"), lifecycle.out_of_scope_export(action).alias("export"), marks.alias("marks"))


@query_for("""SELECT o_orderkey, o_orderstatus IN ('F', 'P') AND (o_custkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1997-01-01') AND o_custkey % 7 <> 0 AS runs,
    coalesce(o_orderdate <= o_orderdate + INTERVAL (o_custkey % 3 - 1) DAY AND (o_custkey % 2 = 0 OR TIMESTAMP '1996-06-01' <= o_orderdate + INTERVAL (o_custkey % 3 - 1) DAY), false) AS skips FROM orders""")
def run_filters(spark, d):
    k, at = F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "P", "not_confirmed").otherwise("exported").alias("status"),
        F.when(k % 3 != 0, at).alias("next_retry_at"), F.when(k % 7 == 0, True).alias("all_deferred"),
    )
    applied = at + F.make_dt_interval((k % 3 - 1).cast("int"))
    config = F.when(k % 2 != 0, F.lit(datetime(1996, 6, 1)).cast("timestamp"))
    return rows.select("o_orderkey", lifecycle.executable(F.lit(datetime(1997, 1, 1)).cast("timestamp")).alias("runs"), lifecycle.may_skip_unchanged(at, applied, config).alias("skips"))


@query_for("""SELECT user_id, count(*) / (max(value) - 50) AS rate, CASE WHEN count(*) / (max(value) - 50) > 0 THEN 1000 / (count(*) / (max(value) - 50)) END AS to_go FROM events GROUP BY 1 HAVING max(value) > 50
    UNION ALL SELECT user_id, NULL, NULL FROM events GROUP BY 1 HAVING max(value) <= 50""")
def throughput_estimates(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("value") - 50).alias("s"))
    rate, to_go = summarise.throughput(F.col("n"), F.col("s"), F.lit(1000))
    return rows.select("user_id", rate.alias("rate"), to_go.alias("to_go"))


@query_for("""SELECT o_orderstatus AS type, o_orderpriority AS attr, count(DISTINCT o_custkey % 13) AS contributors FROM orders GROUP BY 1, 2""")
def contributors_by_attribute(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("attr"), (F.col("o_custkey") % 13).alias("mapping_id"))
    return merge.contributor_counts(rows)


@query_for("""SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_custkey) AS place FROM customer QUALIFY place <= 40""")
def whitelisted_sort(spark, d):
    keys = {"segment": F.col("c_mktsegment").desc(), "name": F.col("c_name").asc()}
    rows = query.sort_by_key(table(spark, d, "customer"), "SEGMENT", keys, "name", "c_custkey").limit(40)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("c_mktsegment").desc_nulls_last(), "c_custkey"))).select("c_custkey", F.col("place").cast("long").alias("place"))


@query_for("""SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_nationkey < 12) AS total FROM customer WHERE c_nationkey < 12 ORDER BY c_custkey LIMIT 30""")
def page_with_total(spark, d):
    rows, total = query.page_range(table(spark, d, "customer").filter("c_nationkey < 12").orderBy("c_custkey"), -5, 30, total=True)
    return rows.select("c_custkey", F.lit(total).cast("long").alias("total"))


@query_for("""SELECT c_custkey, c_nationkey::VARCHAR AS n, rtrim(rtrim((c_acctbal::DECIMAL(12,2))::VARCHAR, '0'), '.') AS cents, coalesce(try_cast(right(c_name, c_custkey % 12) AS INT), 0) AS back,
    coalesce(try_cast(c_custkey::VARCHAR || '000000' AS INT), 0) AS wide, coalesce(try_cast(replace(c_name, 'Customer#', '') AS DECIMAL(38,10)), 0)::DOUBLE AS number FROM customer""")
def fn_conversions(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", S.to_string(F.col("c_nationkey"), "int").alias("n"), S.to_string(F.col("c_acctbal").cast("decimal(12,2)"), "decimal(12,2)").alias("cents"),
        S.to_int(F.right("c_name", (k % 12).cast("int"))).alias("back"), S.to_int(F.concat(k.cast("string"), F.lit("000000"))).alias("wide"),
        S.to_decimal(F.replace("c_name", F.lit("Customer#"), F.lit(""))).cast("double").alias("number"),
    )


@query_for("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN printf('%d', p_retailprice::BIGINT) ELSE rtrim(rtrim((p_retailprice::DECIMAL(18,4))::VARCHAR, '0'), '.') END AS price FROM part""")
def fn_decimal_text(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_string(F.col("p_retailprice").cast("decimal(18,4)"), "decimal(18,4)").alias("price"))


@query_for("""SELECT c_custkey FROM customer WHERE (c_custkey % 2 = 0) = true AND md5(c_name) <> md5('Customer#000000002') AND md5(c_mktsegment) = md5('BUILDING')""")
def crit_bool_guid(spark, d):
    guid = lambda c: F.regexp_replace(F.md5(c.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    t = ObjectType("keyed", (Attribute("c_custkey", Kind.LONG), Attribute("even", Kind.BOOLEAN), Attribute("own", Kind.GUID), Attribute("of", Kind.GUID)), "c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("even"), guid(F.col("c_name")).alias("own"), guid(F.col("c_mktsegment")).alias("of"))
    named = lambda text: str(uuid.UUID(hashlib.md5(text.encode()).hexdigest()))
    scope = (Group((Criterion("even", "eq", True), Criterion("own", "ne", named("Customer#000000002")), Criterion("of", "eq", named("BUILDING")))),)
    return rows.filter(criteria.in_scope(scope, t, NOW)).select("c_custkey")


@query_for("""SELECT o_orderkey, c_custkey AS object_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 900000 END AS target_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 1""")
def deferred_references(spark, d):
    refs = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 1).cast("string").alias("ref"))
    objects = table(spark, d, "customer").select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_custkey").alias("id"))
    joins = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 900000).alias("target_id"))
    found = match.to_canonical(match.resolve_references(refs, objects, "o_orderkey", "ref", "customer"), joins)
    return found.select("o_orderkey", "object_id", "target_id")


@query_for("""SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN ts ELSE ts - INTERVAL 1 HOUR END < TIMESTAMP '2024-01-20' - INTERVAL 90 SECOND""")
def stale_tasks(spark, d):
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, ts).alias("beat"), (ts - F.expr("interval 1 hour")).alias("started_at"))
    return lifecycle.stale(rows, "beat", datetime(2024, 1, 20), 90).select("event_id")


@query_for("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'not_confirmed' END AS status, CASE WHEN o_orderstatus <> 'O' AND n < t AND o_custkey % 2 = 0 THEN 'update' WHEN o_custkey % 2 = 0 THEN 'create' ELSE 'update' END AS change,
    CASE WHEN o_orderstatus <> 'O' AND n >= t THEN 1 ELSE 0 END AS errors FROM (SELECT *, o_custkey % 4 AS n, 3 AS t FROM orders) WHERE o_orderstatus = 'O' OR n > 0""")
def sync_confirmed(spark, d):
    k = F.col("o_custkey")
    sets = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("not_confirmed").alias("status"), F.when(k % 2 == 0, "create").otherwise("update").alias("change"),
        (k % 4).cast("int").alias("open"), F.lit(3).alias("total"), F.lit(0).alias("errors"),
    )
    return confirm.sync_confirmation(sets).select("o_orderkey", "status", "change", "errors")


@query_for("""WITH c AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1), s AS (SELECT event_type AS category, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
    SELECT c.category, n, event_id FROM c LEFT JOIN s ON s.category = c.category AND k <= 5""")
def category_samples(spark, d):
    counts, samples = summarise.category_counts(table(spark, d, "events").select(F.col("event_type").alias("category"), "event_id"), "category", "event_id", 5)
    return counts.join(samples, "category", "left").select("category", "n", "event_id")


@query_for("""SELECT o_custkey, min(o_orderkey % 9) AS step, count(*) FILTER (WHERE o_orderkey % 9 = m) AS side_by_side FROM (SELECT *, min(o_orderkey % 9) OVER (PARTITION BY o_custkey) AS m FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def next_steps(spark, d):
    tasks = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 9).alias("step"), (F.col("o_orderstatus") == "F").alias("done"))
    found = lifecycle.next_steps(tasks, "o_custkey", "step", "done")
    return found.groupBy("o_custkey").agg(F.min("step").alias("step"), F.count("*").alias("side_by_side"))
