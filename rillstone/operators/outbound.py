"""Outbound change sets: what targets must be told so that they hold the merged values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators.diff import as_set
from rillstone.operators.skew import numbered
from rillstone.schema import Attribute, Write, as_text


@dataclass(frozen=True)
class ExportMapping:
    """source (a column of merged rows) flows to a target attribute; source_many: the column is a list."""

    source: str
    target: Attribute
    source_many: bool = False
    enabled: bool = True
    initial_only: bool = False


def outbound_delta(merged: DataFrame, target: DataFrame, key: str, mappings: list[ExportMapping]) -> DataFrame:
    """key, change (create, update), attr, op (update, add, remove, error), value: rows only for real changes.

    An object without a target row is created with all its mapped values. Mappings that are off, and on updates those
    for attributes writable on creation alone or initial ones, are left out. A list that flows into one value and has
    more than one is an error and changes nothing. No value clears one value (update to null), and removes of a list.
    """
    on = [m for m in mappings if m.enabled and m.target.write is not Write.NEVER]
    sides = merged.select(key, F.struct(*dict.fromkeys(m.source for m in on)).alias("m")).join(
        target.select(key, F.struct(*dict.fromkeys(m.target.name for m in on)).alias("t")), key, "left"
    )
    create = F.col("t").isNull()
    none = F.array().cast("array<struct<attr:string,op:string,value:string>>")

    def changes(name: str, op: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("attr"), F.lit(op).alias("op"), v.alias("value")))

    parts = []
    for m in on:
        name, new, old = m.target.name, F.col(f"m.{m.source}"), F.col(f"t.{m.target.name}")
        if m.target.many:
            have = as_set(old, m.target)
            want = as_set(new if m.source_many else F.array(new), m.target)
            rows = F.concat(changes(name, "add", F.array_except(want, have)), changes(name, "remove", F.array_except(have, want)))
        else:
            have = as_text(old, m.target.kind)
            if m.source_many:
                values = as_set(new, m.target)
                want, conflict = F.when(F.size(values) == 1, values[0]), F.size(values) > 1
            else:
                want, conflict = as_text(new, m.target.kind), F.lit(False)
            rows = (
                F.when(conflict, changes(name, "error", F.array(F.lit("several values"))))
                .when(~want.eqNullSafe(have) & ~(create & want.isNull()), changes(name, "update", F.array(want)))
                .otherwise(none)
            )
        if m.initial_only or m.target.write is Write.ON_CREATE:
            rows = F.when(create, rows).otherwise(none)
        parts.append(rows)
    out = sides.select(key, F.when(create, "create").otherwise("update").alias("change"), F.concat(*parts).alias("c"))
    return out.select(key, "change", F.inline("c"))


def without_no_ops(changes: DataFrame, target_values: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(changes that change something, number of the others by attribute). target_values: key, attr, value."""
    held = target_values.select(key, "attr", "value").distinct().withColumn("_held", F.lit(True))
    marked = changes.join(held, [key, "attr", "value"], "left")
    some = target_values.select(key, "attr").distinct().withColumn("_some", F.lit(True))
    marked = marked.join(some, [key, "attr"], "left")
    has, any_ = F.coalesce("_held", F.lit(False)), F.coalesce("_some", F.lit(False))
    idle = (
        F.when(F.col("op").isin("update", "add"), F.when(F.col("value").isNull(), ~any_).otherwise(has))
        .when(F.col("op") == "remove", ~has)
        .when(F.col("op") == "remove_all", ~any_)
        .otherwise(F.lit(False))
    )
    marked = marked.withColumn("_idle", idle)
    skipped = marked.filter("_idle").groupBy("attr").agg(F.count("*").alias("skipped"))
    return marked.filter("not _idle").select(*changes.columns), skipped


def staging_decision() -> Column:
    """What staging an object for a target does, from joined flags: type_conflict, recall, has_target, pending_create,
    provisions, relevant."""
    return (
        F.when(F.col("type_conflict"), "type_conflict")
        .when(F.col("recall") & ~F.col("has_target"), "recall_skipped")
        .when(F.col("pending_create"), "reuse_pending")
        .when(~F.col("has_target"), F.when(F.col("provisions"), "provision").otherwise("declined"))
        .when(~F.col("relevant"), "irrelevant")
        .otherwise("update")
    )


def relevant(changed: Column, mappings: list[ExportMapping], expressions: bool = False) -> Column:
    """Whether a list of changed attributes matters: one is mapped, or some enabled mapping is an expression."""
    names = [m.source for m in mappings if m.enabled]
    return F.lit(True) if expressions else F.arrays_overlap(changed, F.array(*map(F.lit, names))) if names else F.lit(False)


def merge_key(many: Column) -> Column:
    """One value: the attribute. A list: the attribute and the value, so that other values' changes stand beside it."""
    value = F.coalesce("reference", "value", F.lit(""))
    return F.when(many, F.concat_ws(":", "attr", value)).otherwise(F.col("attr"))


def merge_changes(changes: DataFrame, target: str) -> DataFrame:
    """One change a target and merge key, the newest (greatest seq). changes: target, attr, many, op, value, reference,
    seq, drift.

    A change of a whole attribute (replace, remove_all) supersedes what came before it for that attribute. Current
    evaluation goes before drift correction whatever its age, so a whole change by drift supersedes drift's alone, and a
    current one all of drift's.
    """
    keyed = changes.withColumn("_k", merge_key(F.col("many")))
    row = F.struct(*[c for c in changes.columns if c != target])
    best = keyed.groupBy(target, "_k").agg(F.max_by(row, F.struct(~F.col("drift"), "seq")).alias("r")).select(target, "_k", "r.*")
    last = lambda of: F.max(F.when(of, F.col("seq")))
    whole = changes.filter(F.col("op").isin("replace", "remove_all")).groupBy(target, "attr").agg(last(~F.col("drift")).alias("_current"), last(F.col("drift")).alias("_drift"))
    best = best.join(whole, [target, "attr"], "left")
    behind = lambda c: F.coalesce(F.col("seq") < F.col(c), F.lit(False))
    gone = F.when(F.col("drift"), F.col("_current").isNotNull() | behind("_drift")).otherwise(behind("_current"))
    return best.filter(~gone).select(*changes.columns)


def cancelled_pairs(pending: DataFrame, by: str) -> DataFrame:
    """pending change sets (by, change, status) without those that cancel out: a waiting create and a delete both go, a
    delete takes a waiting update's place. What has been sent already stays."""
    waiting = F.col("status") == "pending"
    flags = pending.groupBy(by).agg(
        F.max(waiting & (F.col("change") == "create")).alias("_c"), F.max(waiting & (F.col("change") == "delete")).alias("_d")
    )
    rows = pending.join(flags, by)
    gone = waiting & F.col("_d") & (((F.col("change") == "create") | ((F.col("change") == "delete") & F.col("_c"))) | (F.col("change") == "update"))
    return rows.filter(~gone).select(*pending.columns)


def drift(expected: DataFrame, actual: DataFrame, contributors: DataFrame, key: str) -> DataFrame:
    """Corrections (key, attr, value) where a target's value isn't the enforced one.

    expected, actual: key, system, attr, value. Attributes that the system itself contributes aren't corrected.
    """
    rows = expected.join(contributors.select("system", "attr").distinct(), ["system", "attr"], "left_anti")
    held = actual.select(key, "system", "attr", F.col("value").alias("_held"))
    return rows.join(held, [key, "system", "attr"], "left").filter(~F.col("value").eqNullSafe(F.col("_held"))).drop("_held")


def chunked(changes: DataFrame, by: list[str], value: str, most: int = 1000) -> DataFrame:
    """by, chunk, values: the distinct values of a modification in chunks of at most `most`.

    A modification of very many values is numbered in several tasks; only a chunk is one row."""
    rows = numbered(changes.select(*by, value).distinct(), by, [value])
    rows = rows.withColumn("chunk", F.floor((F.col("_n") - 1) / most).cast("int"))
    return rows.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(value)).alias("values"))


def size_batches(operations: DataFrame, order: str, size: str, most_bytes: int, most_operations: int, by: list[str]) -> DataFrame:
    """operations with `batch`, packed in order within each group of `by`: a batch is closed before an operation that
    would take it beyond most_bytes, or when it has most_operations. An operation larger than most_bytes by itself is in
    no batch: its batch is null.

    Where one lies depends on all before it, so a group is read in order by one task, batch after batch: each one's end is
    looked up in running sums. Give a very large connection's parts (ranges of `order`, say) as another column of `by`: no
    batch reaches over two of them.
    """
    names = operations.columns
    i, keys = names.index(size), [names.index(c) for c in by]
    spread = operations.repartition(*by).sortWithinPartitions(*by, order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, n, held = None, 0, 0, 0
        for b in batches:
            nbytes = b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out, lost = np.zeros(b.num_rows, np.int64), nbytes > most_bytes
            for first, end in groups_of([b.column(k) for k in keys], b.num_rows):
                key = tuple(b.column(k)[first].as_py() for k in keys)
                if key != last:
                    last, batch, n, held = key, 0, 0, 0
                rows = np.flatnonzero(~lost[first:end]) + first
                sums, at = np.cumsum(nbytes[rows]), 0
                while at < len(rows):
                    before = int(sums[at - 1]) if at else 0
                    fit = min(int(np.searchsorted(sums, before + most_bytes - held, "right")) - at, most_operations - n)
                    if fit <= 0:  # what is open is closed; an empty batch takes any row that is in one at all
                        batch, n, held = batch + 1, 0, 0
                        continue
                    out[rows[at : at + fit]] = batch
                    held, n, at = held + int(sums[at + fit - 1]) - before, n + fit, at + fit
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32(), mask=lost)], names=[*names, "batch"])

    return spread.mapInArrow(pack, T.StructType([*operations.schema.fields, T.StructField("batch", T.IntegerType())]))


def groups_of(columns: list[pa.Array], n: int) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of equal values in all columns."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    edges = [*np.flatnonzero(new).tolist(), n]
    yield from zip(edges[:-1], edges[1:], strict=True)


def purge_references(changes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Changes whose unresolved reference isn't a deleted object's, without regard to case."""
    gone = deleted.select(F.lower("external_id").alias("_r")).distinct()
    return changes.withColumn("_r", F.lower("reference")).join(gone, "_r", "left_anti").drop("_r")


def recall_policy(existing: Column) -> Column:
    """What a recall does beside an existing change set: a delete makes it needless, a create is protected, an update takes it in."""
    return F.when(existing == "delete", "skip").when(existing == "create", "skip").when(existing == "update", "merge").otherwise("new")


def recall_changes(references: DataFrame) -> DataFrame:
    """references (owner, attr, ref, many, held) as changes: a list's value is removed if held; one value is cleared."""
    rows = references.filter(~F.col("many") | F.col("held"))
    return rows.select("owner", "attr", F.when(F.col("many"), "remove").otherwise("update").alias("op"), F.when(F.col("many"), F.col("ref")).alias("value"))
