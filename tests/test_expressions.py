import re

import pytest
from pyspark.sql import functions as F

from rillstone.functions import scalars as S
from rillstone.functions.expressions import FUNCTIONS, ExpressionError, attributes_of, check_expression, coerced, compile_expression
from rillstone.schema import Kind

KINDS = {"Name": Kind.TEXT, "N": Kind.NUMBER, "Big": Kind.LONG, "D": Kind.DECIMAL, "When": Kind.DATETIME, "On": Kind.BOOLEAN, "Tags": Kind.TEXT, "Nothing": Kind.TEXT}


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(
        """SELECT ' o''brien-smith  jane' AS Name, 7 AS N, 5000000000L AS Big, CAST(2.50 AS DECIMAL(38,10)) AS D,
        TIMESTAMP '2024-02-29 13:05:06' AS When, true AS On, array('a', '', 'b') AS Tags, CAST(NULL AS STRING) AS Nothing"""
    )


CASES = [
    ('Trim(cs["Name"])', "o'brien-smith  jane"),
    ('Capitalise(Trim(cs["name"]))', "O'Brien-Smith  Jane"),
    ('Left("abc", 2) + Right("abc", 9) + Left("abc", -1)', "ababc"),
    ('Substring("abcdef", 2, 3) + Substring("abc", -4, 1) + Substring("abc", 9, 1)', "cdea"),
    ('Replace("aXbX", "X", "-")', "a-b-"),
    ('Replace("abc", "", "-")', "abc"),
    ('StartsWith(cs["Nothing"], "a") || EndsWith("ba", "a")', True),
    ('Length(cs["Nothing"]) + Length("abc")', 3),
    ('IsNullOrEmpty("") && IsNullOrWhitespace("\\t ") && !IsNullOrEmpty(" ")', True),
    ('CollectionContains(cs["Tags"], "b")', True),
    ('Join(cs["Tags"], "-")', "a-b"),
    ('Join(Split("a; ;b ;", ";"))', "a,b"),
    ('Join(Split("", ";"))', None),
    ('Coalesce(cs["Nothing"], "x")', "x"),
    ('IIF(cs["N"] > 5, "big", "small")', "big"),
    ('cs["N"] / 2', 3),
    ('-cs["N"] / 2', -3),
    ('cs["N"] / 0', None),
    ('Eq(cs["N"], "7") && Eq(cs["D"], 2.5) && !Eq(cs["Nothing"], "") && Eq(cs["Nothing"], null)', True),
    ('"a" + cs["Nothing"] + 1 + true', "a1True"),
    ('FormatDate(cs["When"], "dddd dd/MM/yyyy hh:mm tt \'at\' HH")', "Thursday 29/02/2024 01:05 PM at 13"),
    ('ToFileTime(cs["When"]) > 0 && Eq(FromFileTime(132223104000000000), "2020-01-01 00:00:00")', True),
    ("FromFileTime(0)", None),
    ('ToFileTime(FromFileTime(132223104000000019)) - 132223104000000000', 10),
    ('ToFileTime(FromFileTime(1)) + 1', 1),
    ('ToFileTime("no date")', None),
    ('ToFileTime("1600-01-01")', None),
    ('ToInt("x") + ToInt(" 12 ")', 12),
    ('ToString(ToDecimal("1.5E3"))', "1500"),
    ('"x" + ToDecimal("2")', "x2"),
    ('Eq(ToDecimal("2"), "2")', True),
    ('ToString(ToDecimal("0"))', "0"),
    ('ToString(ToDecimal("-0.0000012300"))', "-0.00000123"),
    ("EnableUser(514)", 512),
    ("DisableUser(512)", 514),
    ("SetBit(1, 6)", 7),
    ("ClearBit(7, 2)", 5),
    ("HasBit(6, 5)", False),
    ('EscapeDN(" #a,b+c\\"d;e ")', '\\ #a\\,b\\+c\\"d\\;e\\ '),
    ('cs["N"] == 7 ? "y" : "n"', "y"),
    ('1 + 2 * 3 - 4 % 3', 6),
    ('cs["Big"] + 1', 5000000001),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_value(row, text, want):
    known = attributes_of(KINDS, frozenset({"Tags"}))
    got = row.select(compile_expression(text, cs=known).column.alias("x")).first()[0]
    assert got == want


def test_all_functions_are_there():
    assert len(FUNCTIONS) == 36


@pytest.mark.parametrize(
    ("text", "at"), [("1 +", 3), ('cs["No"]', 3), ("Left(1)", 0), ("#", 0), ('IIF(true, 1, "a")', 0), ("NoSuch(1)", 0), ('"a" * 2', 4), ("1 2", 2), ("x" * 10_001, 10_000)]
)
def test_mistakes_name_their_place(text, at):
    ok, message, position = check_expression(text, cs=attributes_of(KINDS))
    assert not ok and position == at and message


def test_inputs_are_found():
    x = compile_expression('cs["Name"] + mv["N"] + cs["Name"]', attributes_of(KINDS), attributes_of(KINDS))
    assert x.inputs == [("cs", "Name"), ("mv", "N")]


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [("5", Kind.DECIMAL, 5), ('"2.5"', Kind.DECIMAL, 2.5), ("5000000000", Kind.NUMBER, None), ('"x"', Kind.NUMBER, None), ('"true"', Kind.BOOLEAN, True), ("5", Kind.TEXT, "5"), ("true", Kind.NUMBER, None)],
)
def test_coercion(spark, text, kind, want):
    value, error = coerced(compile_expression(text), kind)
    got = spark.range(1).select(value.alias("v"), error.alias("e")).first()
    assert (got["v"] is None if want is None else got["v"] == want) and (got["e"] is not None) == (want is None)


def test_random_words(spark):
    rows = spark.range(200).select(S.random_password(12).alias("p"), S.random_passphrase(2).alias("w")).collect()
    assert len({r["p"] for r in rows}) == 200
    assert all(len(r["p"]) == 12 and all(re.search(x, r["p"]) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")) for r in rows)
    assert all(len(r["w"].split("-")) == 3 for r in rows)
    assert len(S.password(1)) == 8 and len(S.password(1000)) == 128


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({"trim_ends": True, "collapse": True, "case": "title"}, "Alice Smith"),
        ({"trim_ends": True}, "aLICE \t SMITH"),
        ({"collapse": True}, " aLICE SMITH "),
        ({"case": "upper"}, "  ALICE \t SMITH "),
    ],
)
def test_text_processing(spark, how, want):
    got = spark.createDataFrame([("  aLICE \t SMITH ",)], "t string").select(S.process_text(F.col("t"), **how)).first()[0]
    assert got == want


def test_bad_date_letters():
    with pytest.raises(ValueError, match="unknown date letters"):
        S.date_pattern("yyyy-qq")
    assert issubclass(ExpressionError, ValueError)
