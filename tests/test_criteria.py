"""All comparisons of all types in all group shapes, against a plain evaluator."""

import itertools
from datetime import datetime
from decimal import Decimal

import pytest

from rillstone.operators.criteria import ALLOWED, Criterion, Group, Relative, compare, crossed, in_scope
from rillstone.schema import Attribute, Kind, ObjectType, spark_schema

NOW = datetime(2024, 3, 31, 15, 45)
KINDS = {"t": Kind.TEXT, "n": Kind.NUMBER, "l": Kind.LONG, "d": Kind.DECIMAL, "w": Kind.DATETIME, "b": Kind.BOOLEAN, "g": Kind.GUID}
TYPE = ObjectType("x", (Attribute("id", Kind.LONG), *(Attribute(k, v) for k, v in KINDS.items()), Attribute("m", Kind.TEXT, many=True)), "id")
GUID = "0f8fad5b-d9cb-469f-a165-70867728950e"
ROWS = [
    (1, "Alpha", 5, 5_000_000_000, Decimal("5.00"), datetime(2024, 2, 29), True, GUID, ["b", "a"]),
    (2, "alpha", -5, -1, Decimal("5.001"), datetime(2024, 2, 28, 23, 59), False, "1" + GUID[1:], ["z"]),
    (3, "Alphabet", 0, 0, Decimal("-5"), datetime(1970, 1, 1), None, GUID, []),
    (4, "the Alpha", 7, 7, Decimal("7"), datetime(2024, 3, 31), True, None, None),
    (5, "", None, None, None, None, None, None, None),
    (6, None, None, None, None, None, None, None, None),
]
VALUES = {"t": "Alpha", "n": 5, "l": 5_000_000_000, "d": Decimal("5.0"), "w": datetime(2024, 2, 29), "b": True, "g": GUID.upper()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, spark_schema(TYPE)).cache()


def expected(row, c):
    value = row[1 + list(KINDS).index(c.attribute)]
    x = c.value
    if value is None:
        return c.op == "eq" and x is None
    if x is None:
        return c.op in ("ne", "not_starts", "not_ends", "not_contains") and KINDS[c.attribute] in (Kind.TEXT, Kind.BOOLEAN, Kind.GUID)
    if isinstance(x, Relative):
        x = x.at(NOW).replace(tzinfo=None)
    if c.attribute == "g":
        x = x.lower()
    if c.ignore_case:
        value, x = value.lower(), x.lower()
    op = c.op.removeprefix("not_")
    found = {
        "eq": lambda: value == x, "ne": lambda: value != x, "lt": lambda: value < x, "le": lambda: value <= x, "gt": lambda: value > x,
        "ge": lambda: value >= x, "starts": lambda: value.startswith(x), "ends": lambda: value.endswith(x), "contains": lambda: x in value,
    }[op]()
    return found != c.op.startswith("not_")


CELLS = [Criterion(a, op, v, i) for a, k in KINDS.items() for op in ALLOWED[k] for v in (VALUES[a], None) for i in ((False, True) if k is Kind.TEXT and v else (False,))]


def test_matrix(rows):
    shapes = [(f"s{i}", lambda r, c=c: expected(r, c), (Group((c,)),)) for i, c in enumerate(CELLS)]
    for i, (a, b) in enumerate(itertools.islice(zip(CELLS, CELLS[7:] + CELLS[:7], strict=True), 0, None, 3)):
        shapes.append((f"a{i}", lambda r, a=a, b=b: expected(r, a) and expected(r, b), (Group((a, b)),)))
        shapes.append((f"o{i}", lambda r, a=a, b=b: expected(r, a) or expected(r, b), (Group((a, b), all=False),)))
        shapes.append((f"n{i}", lambda r, a=a, b=b: expected(r, a) and (expected(r, b) or expected(r, a)), (Group((a, Group((b, a), all=False))),)))
        shapes.append((f"t{i}", lambda r, a=a, b=b: expected(r, a) or expected(r, b), (Group((a,)), Group((b,)))))
    got = rows.select("id", *(in_scope(g, TYPE, NOW).alias(n) for n, _, g in shapes)).collect()
    for r in got:
        row = ROWS[r["id"] - 1]
        for n, want, g in shapes:
            assert r[n] == want(row), (row, g)


def test_empty_groups_and_lists(rows):
    ids = lambda *g: [r["id"] for r in rows.filter(in_scope(g, TYPE, NOW)).orderBy("id").collect()]
    assert ids() == ids(Group(())) == ids(Group((), all=False)) == [1, 2, 3, 4, 5, 6]
    assert ids(Group((Criterion("M", "eq", "a"),))) == [1]  # the least value decides
    assert ids(Group((Criterion("m", "eq", None),))) == [3, 4, 5, 6]


@pytest.mark.parametrize(
    ("relative", "want"),
    [
        (Relative(-1, "months"), datetime(2024, 2, 29)),
        (Relative(-13, "months"), datetime(2023, 2, 28)),
        (Relative(1, "years"), datetime(2025, 3, 31)),
        (Relative(-2, "weeks"), datetime(2024, 3, 17)),
        (Relative(3, "days"), datetime(2024, 4, 3)),
        (Relative(-5, "hours"), datetime(2024, 3, 31, 10, 45)),
    ],
)
def test_relative_dates(relative, want):
    assert relative.at(NOW).replace(tzinfo=None) == want


def test_crossed_window(rows):
    scope = (Group((Criterion("w", "le", Relative(-1, "months")),)),)
    ids = lambda after: [r["id"] for r in rows.filter(crossed(scope, TYPE, after, NOW)).orderBy("id").collect()]
    assert ids(datetime(2024, 3, 29)) == []  # both bounds are 29 February
    assert ids(datetime(2024, 3, 28)) == [1, 2]
    assert ids(None) == [1, 2, 3]


@pytest.mark.parametrize(("kind", "op"), [(Kind.BOOLEAN, "lt"), (Kind.NUMBER, "contains"), (Kind.BINARY, "eq"), (Kind.REFERENCE, "eq"), (Kind.TEXT, "gt")])
def test_not_allowed(kind, op):
    with pytest.raises(ValueError, match="doesn't allow"):
        compare(None, op, 1, kind)
