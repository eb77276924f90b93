"""Delimited files: typed scans, routing to object types, many-valued columns, and schema inference."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.scalars import trim
from rillstone.operators.skew import numbered
from rillstone.schema import Attribute, Kind, ObjectType, each_value, parsed


class Unsupported(ValueError):
    """An operation that a source or target has no capability for."""


@dataclass(frozen=True)
class Capabilities:
    """What a source or target can do; operators that need more aren't planned for it: `check` stops them."""

    full_import: bool = True
    delta_import: bool = False
    export: bool = False
    partitions: bool = False
    partition_containers: bool = False
    second_key: bool = False
    user_types: bool = True
    paging: bool = False
    parallel_export: bool = False
    auto_confirm: bool = False
    generated_keys: bool = False
    key_rename: bool = False
    watermark: bool = False
    change_log: bool = False
    passwords: bool = False

    def check(self, *operations: str) -> None:
        """An Unsupported error that names the first operation for which a capability lacks."""
        for operation in operations:
            if operation not in NEEDS:
                raise ValueError(f"no operation {operation}")
            if lacking := [n for n in NEEDS[operation] if not getattr(self, n)]:
                raise Unsupported(f"{operation} needs {', '.join(lacking)}")


#: What operations need.
NEEDS = {
    "full import": ("full_import",),
    "delta import by watermark": ("delta_import", "watermark"),
    "delta import by change log": ("delta_import", "change_log"),
    "paged import": ("full_import", "paging"),
    "import by partition": ("full_import", "partitions"),
    "import by container": ("full_import", "partitions", "partition_containers"),
    "export": ("export",),
    "parallel export": ("export", "parallel_export"),
    "export with generated keys": ("export", "generated_keys"),
    "rename": ("export", "key_rename"),
    "password export": ("export", "passwords"),
}

FILE = Capabilities(export=True, auto_confirm=True)


def read_text(spark: SparkSession, path: str, separator: str = ",", columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Files with a header, all columns as text, read in pieces by several tasks. multi_line: quoted fields may hold line
    feeds; a file is then one task's."""
    df = spark.read.csv(path, header=True, sep=separator, multiLine=multi_line, escape='"', quote='"', enforceSchema=False)
    return df if columns is None else df.select(*columns)


def split_values(c: Column, delimiter: str) -> Column:
    """Parts between delimiters, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, F.lit("\\Q" + delimiter + "\\E")), trim), lambda x: x != "")


def typed(df: DataFrame, t: ObjectType, delimiter: str = "|") -> DataFrame:
    """t's selected attributes with their types, and `errors`: a text for each value that isn't of its type.

    Columns are found without case; one that is missing gives nulls. A blank is no value.
    """
    have = {c.lower(): c for c in df.columns}
    out, errors = [], []
    for a in t.attributes:
        if not (a.selected or a.name == t.key):
            continue
        name = have.get(a.name.lower())
        raw = F.nullif(F.col(f"`{name}`"), F.lit("")) if name else F.lit(None).cast("string")
        if a.many:
            parts = F.coalesce(split_values(raw, delimiter), F.array().cast("array<string>"))
            value = each_value(parts, parsed, a.kind)
            out.append(F.array_distinct(F.filter(value, lambda v: v.isNotNull())).alias(a.name))
            bad = F.exists(value, lambda v: v.isNull())
        else:
            value = parsed(raw, a.kind)
            out.append(value.alias(a.name))
            bad = raw.isNotNull() & value.isNull() & (trim(raw) != "")
        errors.append(F.when(bad, F.lit(f"{a.name}: not a {a.kind.name}")))
    return df.select(*out, F.array_compact(F.array(*errors)).alias("errors"))


def import_file(df: DataFrame, t: ObjectType, delimiter: str = "|", stop_on_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with errors). stop_on_first raises if there is an error at all."""
    rows = typed(df, t, delimiter)
    bad = rows.filter((F.size("errors") > 0) | F.col(t.key).isNull())
    if stop_on_first and (first := bad.head(1)):
        raise ValueError(f"import stopped: {first[0]['errors'] or 'no external id'}")
    return rows.filter((F.size("errors") == 0) & F.col(t.key).isNotNull()).drop("errors"), bad


def route_types(df: DataFrame, types: list[ObjectType], selected: set[str], column: str | None = None, fixed: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows by object type, rows of a type that isn't known). Types that aren't selected are skipped. Names without case."""
    if fixed is not None:
        return ({fixed: df} if fixed in selected else {}), df.limit(0)
    of = F.lower(F.col(column))
    known = [t.name for t in types]
    routed = {n: df.filter(of == n.lower()) for n in known if n in selected}
    return routed, df.filter(~F.coalesce(of.isin([n.lower() for n in known]), F.lit(False)))


#: Narrowest first; text is what is left.
INFERRED = (Kind.NUMBER, Kind.LONG, Kind.DECIMAL, Kind.BOOLEAN, Kind.GUID, Kind.DATETIME)


#: Rows of the first look. It settles nothing but which types are out, as one value is enough for that.
FIRST_LOOK = 1_000
#: What all texts of decimals are made of. Casts of other texts would find out by an error each.
_DECIMAL = r"^[\p{Nd}+\-.eE\x00-\x20]+$"


def infer(df: DataFrame) -> list[Attribute]:
    """Each text column's narrowest type that fits all its values, in one aggregation. Columns without a value are text.

    Types that a value of the first rows rules out aren't tried on the others.
    """
    first = _fitting(df.sparkSession.createDataFrame(df.head(FIRST_LOOK), df.schema), [INFERRED] * len(df.columns))
    found = _fitting(df, [kinds for _, kinds in first])
    return [Attribute(c, kinds[0] if n and kinds else Kind.TEXT) for c, (n, kinds) in zip(df.columns, found, strict=True)]


def _fitting(df: DataFrame, tried: list[tuple[Kind, ...]]) -> list[tuple[int, tuple[Kind, ...]]]:
    """For each column how many values it has, and those of the types tried that fit all of them."""
    checks = []
    for i, (c, kinds) in enumerate(zip(df.columns, tried, strict=True)):
        raw = F.nullif(trim(F.col(f"`{c}`")), F.lit(""))
        checks.append(F.count(raw).alias(f"n{i}"))
        fits, narrower = {}, F.lit(False)
        for k in kinds:
            fits[k] = parsed(raw, k).isNotNull()
            if k is Kind.DECIMAL:
                fits[k] = raw.rlike(_DECIMAL) & fits[k]
            if k in (Kind.NUMBER, Kind.LONG, Kind.DECIMAL):  # what fits one of them fits those after it
                fits[k] = narrower = narrower | fits[k]
        checks += [F.bool_and(F.when(raw.isNotNull(), ok)).alias(f"c{i}_{k.name}") for k, ok in fits.items()]
    r = df.agg(*checks).first()
    return [(r[f"n{i}"], tuple(k for k in kinds if r[f"c{i}_{k.name}"] is not False)) for i, kinds in enumerate(tried)]


def write_full_state(existing: DataFrame | None, changes: DataFrame, key: str, path: str, delimiter: str = "|", separator: str = ",") -> None:
    """Rewrite a file of full state: `merged_state` of what it holds and the changes, lists joined, header columns of both."""
    FILE.check("export")
    merged = changes.filter("change <> 'delete'").drop("change", "changed") if existing is None else merged_state(existing, changes, key)
    flat = [F.array_join(c, delimiter).alias(c) if k.startswith("array") else F.col(c).cast("string") for c, k in merged.dtypes]
    merged.select(*flat).write.mode("overwrite").csv(path, header=True, sep=separator)


def merged_state(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing after changes (key, change, columns): creates and updates by key, and deletes. Columns of both.

    With a column `changed`, a list of columns, an update sets these, to null too, and no others. Without it an update's
    null keeps what was there.
    """
    a = existing.select(F.col(key), F.struct(*existing.columns).alias("a"))
    b = changes.select(F.col(key), F.struct(*changes.columns).alias("b"))
    marked = "changed" in changes.columns
    names = [*existing.columns, *(c for c in changes.columns if c not in existing.columns and c not in ("change", "changed"))]
    both = a.join(b, key, "full").filter("b is null or b.change <> 'delete'")
    cols = []
    for n in names:
        own = [F.col(f"{s}.{n}") for s, f in (("b", changes), ("a", existing)) if n in f.columns]
        if n == key:
            value = F.col(key)
        elif marked and len(own) == 2:
            value = F.when(F.col("a").isNull() | F.array_contains("b.changed", n), own[0]).otherwise(own[1])
        else:
            value = functools.reduce(lambda x, y: F.coalesce(x, y), own)
        cols.append(value.alias(n))
    return both.select(*cols)


def as_state_changes(delta: DataFrame, existing: DataFrame, key: str, attributes: list[Attribute]) -> DataFrame:
    """An outbound delta (key, change, attr, op, value) as `merged_state` takes it: a row an object, with `changed`.

    A value is set, or cleared by null; a list gets what is added and loses what is removed. Errors and deletes of single
    values change nothing; an object whose change is a delete goes.
    """
    cols = []
    for a in attributes:
        own = F.col("attr") == a.name
        if a.many:
            picked = lambda op, own=own: F.collect_set(F.when(own & (F.col("op") == op), F.col("value")))
            all_gone = F.bool_or(own & (F.col("op") == "remove_all"))
            cols += [picked("add").alias(f"+{a.name}"), picked("remove").alias(f"-{a.name}"), F.coalesce(all_gone, F.lit(False)).alias(f"0{a.name}")]
        else:
            cols.append(F.max(F.when(own & (F.col("op") == "update"), F.struct(F.lit(1), F.col("value").alias("v")))).alias(f"={a.name}"))
    change = F.max_by("change", F.when(F.col("change") == "delete", 2).when(F.col("change") == "create", 1).otherwise(0)).alias("change")
    rows = delta.filter("op is null or op <> 'error'").groupBy(key).agg(change, *cols)
    held = existing.select(key, *(F.col(a.name).alias(f"@{a.name}") for a in attributes if a.many and a.name in existing.columns))
    rows = rows.join(held, key, "left")
    out, marks = [], []
    for a in attributes:
        if a.many:
            none = F.array().cast("array<string>")
            had = F.coalesce(F.col(f"`@{a.name}`"), none) if a.name in existing.columns else none
            after = F.array_except(F.when(F.col(f"`0{a.name}`"), none).otherwise(had), F.col(f"`-{a.name}`"))
            out.append(F.array_sort(F.array_union(after, F.col(f"`+{a.name}`"))).alias(a.name))
            moved = F.col(f"`0{a.name}`") | (F.size(F.col(f"`+{a.name}`")) > 0) | (F.size(F.col(f"`-{a.name}`")) > 0)
        else:
            out.append(F.col(f"`={a.name}`")["v"].alias(a.name))
            moved = F.col(f"`={a.name}`").isNotNull()
        marks.append(F.when(moved, F.lit(a.name)))
    return rows.select(key, "change", F.array_compact(F.array(*marks)).alias("changed"), *out)


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with new's rows in the place of those with equal keys."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def retained(df: DataFrame, at: str, tie_break: str, cutoff: object, most: int) -> DataFrame:
    """df without its oldest rows from before the cutoff, at most `most` of them in one run."""
    old = df.filter(F.col(at) < F.lit(cutoff).cast("timestamp")).orderBy(at, tie_break).limit(most).select(tie_break)
    return df.join(old, tie_break, "left_anti")


def apply_dml(table: DataFrame, changes: DataFrame, key: str, generated: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after inserts, updates and deletes, keys of the inserts). changes: key, op, columns.

    With `generated`, inserts get keys above the greatest in the table, in the order of that column (equal ones by a hash of
    the row), numbered range by range, so no task sorts all inserts.
    """
    inserts = changes.filter("op = 'insert'")
    if generated is not None:
        top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
        inserts = numbered(inserts, [], [generated]).join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_n")).drop("_top", "_n")
    touched = changes.filter("op <> 'insert'").select(key)
    names = table.columns
    updated = merged_state(table.join(touched, key, "left_semi"), changes.filter("op = 'update'").withColumnRenamed("op", "change"), key)
    updated = updated.join(changes.filter("op = 'delete'").select(key), key, "left_anti")
    after = table.join(touched, key, "left_anti").select(*names).unionByName(updated.select(*names)).unionByName(inserts.select(*names))
    return after, inserts.select(*dict.fromkeys([key, *([generated] if generated else [])]))
