"""Scope criteria: trees of typed comparisons, compiled to Boolean columns that are never null."""

from __future__ import annotations

import calendar
import functools
import operator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.schema import Attribute, Kind, ObjectType, canonical

EQUALITY = ("eq", "ne")
ORDER = ("lt", "le", "gt", "ge")
AFFIX = ("starts", "not_starts", "ends", "not_ends", "contains", "not_contains")
#: Which comparisons each type allows; other types allow none.
ALLOWED = {
    Kind.TEXT: EQUALITY + AFFIX,
    Kind.NUMBER: EQUALITY + ORDER,
    Kind.LONG: EQUALITY + ORDER,
    Kind.DECIMAL: EQUALITY + ORDER,
    Kind.DATETIME: EQUALITY + ORDER,
    Kind.BOOLEAN: EQUALITY,
    Kind.GUID: EQUALITY,
}


@dataclass(frozen=True)
class Relative:
    """A date so many units ago (negative) or from now. Units but hours count from midnight UTC; months clamp to their last day."""

    count: int
    unit: str  # hours, days, weeks, months, years

    def at(self, now: datetime) -> datetime:
        now = now.astimezone(timezone.utc) if now.tzinfo else now.replace(tzinfo=timezone.utc)
        if self.unit == "hours":
            return now + timedelta(hours=self.count)
        if self.unit in ("days", "weeks"):
            then = now + timedelta(days=self.count * (7 if self.unit == "weeks" else 1))
        elif self.unit in ("months", "years"):
            months = now.year * 12 + now.month - 1 + self.count * (12 if self.unit == "years" else 1)
            year, month = divmod(months, 12)
            then = now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))
        else:
            raise ValueError(f"no unit {self.unit}")
        return then.replace(hour=0, minute=0, second=0, microsecond=0)


@dataclass(frozen=True)
class Criterion:
    attribute: str
    op: str
    value: object = None
    ignore_case: bool = False


@dataclass(frozen=True)
class Group:
    """all: every member holds (an empty group does). Otherwise any does; an empty one holds as well."""

    members: tuple[Criterion | Group, ...]
    all: bool = True


def literal(value: object, kind: Kind, now: datetime) -> Column:
    if value is None:
        return F.lit(None).cast(kind.spark)
    if isinstance(value, Relative):
        if kind is not Kind.DATETIME:
            raise ValueError("only dates compare with relative dates")
        value = value.at(now)
    if isinstance(value, datetime):
        utc = value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return F.timestamp_micros(F.lit((utc - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))
    if isinstance(value, float) and kind is Kind.DECIMAL:
        value = Decimal(repr(value))
    return canonical(F.lit(value), kind)


def compare(c: Column, op: str, value: object, kind: Kind, ignore_case: bool = False, now: datetime | None = None) -> Column:
    """The comparison where the attribute has a row, though its value may be null: two-valued throughout."""
    if op not in ALLOWED.get(kind, ()):
        raise ValueError(f"{kind.name} doesn't allow {op}")
    c, x = canonical(c, kind), literal(value, kind, now or datetime.now(timezone.utc))
    if kind is Kind.TEXT and ignore_case:
        c, x = F.lower(c), F.lower(x)
    if op == "eq":
        return c.eqNullSafe(x)
    if op == "ne" and kind in (Kind.TEXT, Kind.BOOLEAN, Kind.GUID):
        return ~c.eqNullSafe(x)
    if op in AFFIX:
        found = {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op.removeprefix("not_")](c, x)
        found = F.coalesce(found, F.lit(False))
        return ~found if op.startswith("not_") else found
    return F.coalesce({"ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}[op](c, x), F.lit(False))


def criterion(c: Criterion, t: ObjectType, now: datetime) -> Column:
    """A missing attribute meets only equality with nothing; a many-valued one is judged by its least value."""
    a: Attribute = t.attribute(c.attribute)
    value = F.array_min(F.col(a.name)) if a.many else F.col(a.name)
    held = compare(value, c.op, c.value, a.kind, c.ignore_case, now)
    return F.when(value.isNotNull(), held).otherwise(F.lit(c.op == "eq" and c.value is None))


def group(g: Group | Criterion, t: ObjectType, now: datetime) -> Column:
    if isinstance(g, Criterion):
        return criterion(g, t, now)
    parts = [group(m, t, now) for m in g.members]
    return functools.reduce(operator.and_ if g.all else operator.or_, parts) if parts else F.lit(True)


def in_scope(groups: tuple[Group, ...], t: ObjectType, now: datetime | None = None) -> Column:
    """Top-level groups are alternatives; without any, everything is in scope. `now` is fixed for the whole plan."""
    now = now or datetime.now(timezone.utc)
    return functools.reduce(operator.or_, [group(g, t, now) for g in groups]) if groups else F.lit(True)


def relative_bounds(groups: tuple[Group, ...]) -> list[Criterion]:
    """All comparisons with relative dates in a scope."""
    found: list[Criterion] = []
    todo: list[Group | Criterion] = [*groups]
    while todo:
        x = todo.pop()
        if isinstance(x, Group):
            todo += x.members
        elif isinstance(x.value, Relative):
            found.append(x)
    return found


def crossed(groups: tuple[Group, ...], t: ObjectType, after: datetime | None, now: datetime) -> Column:
    """Rows for which time alone may have changed the scope's answer since `after` (ever, if it is None): a value of
    theirs lies in (bound at `after`, bound at `now`] of some relative comparison."""
    found = []
    for c in relative_bounds(groups):
        x = F.col(t.attribute(c.attribute).name)
        upto = x <= literal(c.value, Kind.DATETIME, now)
        found.append(upto if after is None else (x > literal(c.value, Kind.DATETIME, after)) & upto)
    return F.coalesce(functools.reduce(operator.or_, found), F.lit(False)) if found else F.lit(False)


def scope_drift(groups: tuple[Group, ...], t: ObjectType, connected: Column, after: datetime | None, now: datetime) -> Column:
    """Candidates of `crossed` whose scope no longer agrees with whether they are connected."""
    return crossed(groups, t, after, now) & (in_scope(groups, t, now) != F.coalesce(connected, F.lit(False)))
