"""Confirmation of exported changes against what the target then says, and optimistic application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 5


def confirmed_changes(changes: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """changes (key, attr, op, value) with `confirmed`. actual: key, attr, value, a row per value held.

    Add and update: the target holds the value (no value: none at all). Remove: it doesn't. Remove_all: it holds none.
    """
    held = actual.select(key, "attr", "value").distinct().withColumn("_held", F.lit(True))
    some = actual.select(key, "attr").distinct().withColumn("_some", F.lit(True))
    rows = changes.join(held, [key, "attr", "value"], "left").join(some, [key, "attr"], "left")
    has, any_ = F.coalesce("_held", F.lit(False)), F.coalesce("_some", F.lit(False))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    ok = (
        F.when(F.col("op").isin("add", "update"), F.when(empty, ~any_).otherwise(has))
        .when(F.col("op") == "remove", ~has)
        .when(F.col("op") == "remove_all", ~any_)
        .otherwise(F.lit(False))
    )
    return rows.select(*changes.columns, ok.alias("confirmed"))


def change_status(confirmed: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    return F.when(confirmed, "confirmed").when(attempts >= most, "failed").otherwise("not_confirmed")


def confirm_state(changes: DataFrame, by: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """by, status, change, open: the change sets that remain after confirmation, with their number of open changes.

    changes: by, change, attr, second_key (bool), confirmed, attempts. A set whose changes are all confirmed goes. Else
    it is failed if all open ones are, not_confirmed if some may be retried; a create whose second key is confirmed
    goes on as an update.
    """
    rows = changes.withColumn("_s", change_status(F.col("confirmed"), F.col("attempts"), most))
    sets = rows.groupBy(by).agg(
        F.first("change").alias("change"),
        F.count_if(F.col("_s") != "confirmed").alias("open"),
        F.count_if(F.col("_s") == "failed").alias("_failed"),
        F.max(F.col("second_key") & F.col("confirmed")).alias("_known"),
    )
    status = F.when(F.col("_failed") == F.col("open"), "failed").otherwise("not_confirmed")
    change = F.when((F.col("change") == "create") & F.col("_known"), "update").otherwise(F.col("change"))
    return sets.filter("open > 0").select(by, status.alias("status"), change.alias("change"), "open")


def sync_confirmation(sets: DataFrame) -> DataFrame:
    """Change sets (status, change, open, total, errors) after a synchronisation's own look.

    Those waiting or just sent are left alone. All confirmed: gone. Some: the rest goes on, a create as an update. None:
    one more error.
    """
    alone = F.col("status").isin("pending", "exported")
    some = F.col("open") < F.col("total")
    change = F.when(~alone & some & (F.col("change") == "create"), "update").otherwise(F.col("change"))
    errors = F.when(~alone & ~some, F.col("errors") + 1).otherwise(F.col("errors"))
    status = F.when(alone, F.col("status")).otherwise("not_confirmed")
    kept = sets.filter(alone | (F.col("open") > 0))
    cols = {"change": change, "errors": errors, "status": status}
    return kept.select(*(cols[c].alias(c) if c in cols else c for c in sets.columns))


def apply_changes(values: Column, changes: Column) -> Column:
    """A list of values (text) after its changes in order of seq: add if absent, update replaces all, remove, remove_all.

    changes: array of struct(seq, op, value).
    """
    none = F.array().cast("array<string>")
    given = F.coalesce(changes, F.array().cast("array<struct<seq:bigint,op:string,value:string>>"))

    def step(acc: Column, c: Column) -> Column:
        one = F.when(c["value"].isNull(), none).otherwise(F.array(c["value"]))
        return (
            F.when(c["op"] == "add", F.array_union(acc, one))
            .when(c["op"] == "update", one)
            .when(c["op"] == "remove", F.array_except(acc, one))
            .when(c["op"] == "remove_all", none)
            .otherwise(acc)
        )

    return F.aggregate(F.array_sort(given), F.coalesce(values, none), step)


def optimistic_values(actual: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """key, attr, value: what touched attributes hold after exported changes, as if the target had confirmed them.

    changes: key, change, attr, op, value, seq. Delete sets are left out. Works value by value: of the changes of one
    value the last decides, if it comes after the last change of the whole attribute (update, remove_all). So a list
    of very many values, with very many changes, is spread over tasks and costs what its rows cost.
    """
    at = F.struct(F.col("seq").cast("bigint").alias("seq"), "op", F.coalesce("value", F.lit("")).alias("v"))
    sent = changes.filter("change <> 'delete'").select(key, "attr", "value", "op", at.alias("at"))
    whole = sent.filter(F.col("op").isin("update", "remove_all")).groupBy(key, "attr").agg(F.max("at").alias("_w"))
    touched = sent.select(key, "attr").distinct()
    first = F.struct(F.lit(-(1 << 63)).cast("bigint").alias("seq"), F.lit("").alias("op"), F.lit("").alias("v"))
    held = actual.filter("value is not null").join(touched, [key, "attr"], "left_semi").select(key, "attr", "value", F.lit(True).alias("_in"), first.alias("at"))
    moves = sent.filter(F.col("value").isNotNull() & F.col("op").isin("add", "remove", "update"))
    rows = held.unionByName(moves.select(key, "attr", "value", (F.col("op") != "remove").alias("_in"), "at"))
    last = rows.groupBy(key, "attr", "value").agg(F.max_by("_in", "at").alias("_in"), F.max("at").alias("at"))
    return last.join(whole, [key, "attr"], "left").filter("_in and (_w is null or at >= _w)").select(key, "attr", "value")


def optimistic(actual: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """key, attr, values of touched attributes as in optimistic_values, as sorted lists; empty where none is left."""
    touched = changes.filter("change <> 'delete'").select(key, "attr").distinct()
    lists = optimistic_values(actual, changes, key).groupBy(key, "attr").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return touched.join(lists, [key, "attr"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
