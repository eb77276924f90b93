"""The built-in functions of the expression language, as column builders. All are JVM expressions but the two random ones."""

from __future__ import annotations

import secrets
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1970-01-01 in units of 100 ns since 1601-01-01.
FILETIME_EPOCH = 116444736000000000
#: The last whole microsecond of 9999-12-31 in those units.
FILETIME_END = 2650467743999999990


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def capitalise(c: Column) -> Column:
    """Letters after the start, white space, - or ' in upper case, the rest in lower case."""
    parts = F.regexp_extract_all(c, F.lit(r"((?U)[\s'\-]|[^\s'\-]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def left(c: Column, n: Column) -> Column:
    return F.left(c, F.greatest(n, F.lit(0)))


def right(c: Column, n: Column) -> Column:
    return F.right(c, F.greatest(n, F.lit(0)))


def substring(c: Column, start: Column, n: Column) -> Column:
    """From a 0-based place, which counts as 0 if negative; empty beyond the end or for no length."""
    return F.substr(c, F.least(F.greatest(start, F.lit(0)), F.lit((1 << 31) - 2)) + 1, F.greatest(n, F.lit(0)))


def replace(c: Column, old: Column, new: Column) -> Column:
    """All occurrences; an empty `old` changes nothing."""
    return F.when(old == "", c).otherwise(F.replace(c, old, F.coalesce(new, F.lit(""))))


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def starts_with(c: Column, x: Column) -> Column:
    return _or_false(F.startswith(c, x))


def ends_with(c: Column, x: Column) -> Column:
    return _or_false(F.endswith(c, x))


def contains(c: Column, x: Column) -> Column:
    return _or_false(F.contains(c, x))


def length(c: Column) -> Column:
    """Code points; null has none."""
    return F.coalesce(F.length(c), F.lit(0))


def is_null_or_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_null_or_whitespace(c: Column) -> Column:
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def collection_contains(c: Column, x: Column, many: bool = True) -> Column:
    """Whether a list holds x; a single value is compared with it."""
    return _or_false(F.array_contains(c, x) if many else c == x)


def split(c: Column, delimiter: Column) -> Column:
    """Parts between literal delimiters, trimmed, without empty ones; null and '' have none, no delimiter splits nothing."""
    quoted = F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.when(F.coalesce(delimiter, F.lit("")) == "", F.array(c)).otherwise(F.split(c, quoted))
    return F.coalesce(F.filter(F.transform(parts, trim), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def join(c: Column, delimiter: Column | None = None) -> Column:
    """A list's values but null and empty ones; null if none is left."""
    kept = F.filter(c, lambda x: x.isNotNull() & (x != ""))
    sep = F.lit(",") if delimiter is None else delimiter
    joined = F.aggregate(kept, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, sep, x)))
    return F.nullif(joined, F.lit(""))


def coalesce(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def iif(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


NUMERIC = ("int", "bigint", "decimal", "double")


def eq(a: Column, b: Column, kind_a: str = "string", kind_b: str = "string") -> Column:
    """Both null, or equal: numbers as decimals, text with anything as text."""
    if kind_a in NUMERIC and kind_b in NUMERIC:
        return a.cast("decimal(38,10)").eqNullSafe(b.cast("decimal(38,10)"))
    if kind_a != kind_b:
        return to_string(a, kind_a).eqNullSafe(to_string(b, kind_b))
    return a.eqNullSafe(b)


def today(now: Column) -> Column:
    return F.date_trunc("DAY", now)


_DATE_LETTERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "E", "dd": "dd", "d": "d"}
_TIME_LETTERS = {"HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a"}


def date_pattern(pattern: str) -> str:
    """A date pattern of the language in Spark's letters. Text stands in quotes or after a backslash."""
    known, out, i = _DATE_LETTERS | _TIME_LETTERS, "", 0
    quote = lambda t: "'" + t.replace("'", "''") + "'" if t else ""
    while i < len(pattern):
        c = pattern[i]
        n = len(pattern) - i - len(pattern[i:].lstrip(c))
        run = pattern[i : i + n]
        if c in "'\"":
            end = pattern.find(c, i + 1)
            end = len(pattern) if end < 0 else end
            out += quote(pattern[i + 1 : end])
            i = end + 1
            continue
        if c == "\\":
            out += quote(pattern[i + 1 : i + 2])
            i += 2
            continue
        if run in known:
            out += known[run]
        elif c in "fF":
            out += "S" * n
        elif c == "z" and n == 3:
            out += "xxx"
        elif c.isalpha():
            raise ValueError(f"unknown date letters {run}")
        else:
            out += run
        i += n
    return out


def format_date(c: Column, pattern: str) -> Column:
    return F.date_format(c, date_pattern(pattern))


def to_file_time(c: Column, kind: str = "timestamp") -> Column:
    """100 ns since 1601; null for null, blank or bad text, dates before 1601 and the last date there is."""
    if kind not in ("timestamp", "string"):
        raise ValueError(f"a {kind} is no date")
    ts = c if kind == "timestamp" else trim(c).try_cast("timestamp")
    ft = F.unix_micros(ts) * 10 + F.lit(FILETIME_EPOCH)
    return F.when((ft >= 0) & (ft < FILETIME_END), ft)


def from_file_time(c: Column) -> Column:
    """The inverse; null for 0, negative, unreadable and out-of-range numbers."""
    n = c.try_cast("bigint")
    ticks = n - F.lit(FILETIME_EPOCH)
    micros = F.call_function("div", ticks - F.pmod(ticks, F.lit(10)), F.lit(10))
    return F.when((n > 0) & (n <= FILETIME_END), F.timestamp_micros(micros))


def to_string(c: Column, kind: str = "string") -> Column:
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind.startswith("decimal"):
        # no exponent, no zeros at the end of a fraction, no bare point
        return F.call_function("format_number", c.cast("decimal(38,10)"), F.lit("0.##########"))
    return c.cast("string")


def to_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def to_decimal(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def escape_dn(c: Column) -> Column:
    """A value as it stands in a distinguished name."""
    c = F.regexp_replace(c, r'([,+"\\<>;=])', r"\\$1")
    c = F.regexp_replace(F.regexp_replace(c, "\n", r"\\0A"), "\r", r"\\0D")
    c = F.regexp_replace(c, r"^([ #])", r"\\$1")
    return F.regexp_replace(c, r"(?<!^)(?<!^\\) $", r"\\ ")


def enable_user(c: Column) -> Column:
    return clear_bit(c, F.lit(2))


def disable_user(c: Column) -> Column:
    return set_bit(c, F.lit(2))


def set_bit(c: Column, bit: Column) -> Column:
    return to_int(c).bitwiseOR(to_int(bit))


def clear_bit(c: Column, bit: Column) -> Column:
    return to_int(c).bitwiseAND(F.bitwise_not(to_int(bit)))


def has_bit(c: Column, bit: Column) -> Column:
    return to_int(c).bitwiseAND(to_int(bit)) == to_int(bit)


SPECIALS = "!@#$%&*-_=+?"


def password(length: int = 16, special: bool = True) -> str:
    """8 to 128 characters with a lower- and an upper-case letter, a digit and, if asked for, a special character."""
    sets = [string.ascii_lowercase, string.ascii_uppercase, string.digits] + [SPECIALS] * special
    n = min(128, max(8, length))
    chars = [secrets.choice(s) for s in sets] + [secrets.choice("".join(sets)) for _ in range(n - len(sets))]
    secrets.SystemRandom().shuffle(chars)
    return "".join(chars)


_STARTS, _MIDDLES, _ENDS = "b br c d dr f g h k l m n p r s st t tr v w".split(), "a e i o u ai ea oo".split(), "n r l s t m nd rk".split()


def passphrase(words: int = 4, separator: str = "-") -> str:
    """3 to 10 made-up syllable words, of over 20 bits each."""
    word = lambda: "".join(secrets.choice(x) for x in (_STARTS, _MIDDLES, _ENDS, _MIDDLES, _ENDS))
    return separator.join(word() for _ in range(min(10, max(3, words))))


def random_password(length: int = 16, special: bool = True) -> Column:
    import pandas as pd

    make = F.pandas_udf(lambda s: pd.Series([password(length, special) for _ in range(len(s))]), "string")
    return make.asNondeterministic()(F.monotonically_increasing_id())


def random_passphrase(words: int = 4, separator: str = "-") -> Column:
    import pandas as pd

    make = F.pandas_udf(lambda s: pd.Series([passphrase(words, separator) for _ in range(len(s))]), "string")
    return make.asNondeterministic()(F.monotonically_increasing_id())


def process_text(c: Column, trim_ends: bool = False, collapse: bool = False, case: str | None = None, blank_is_null: bool = False) -> Column:
    """Inbound text processing in its fixed order: trim, collapse runs of white space, case, blank as no value."""
    if trim_ends:
        c = trim(c)
    if collapse:
        c = F.regexp_replace(c, r"(?U)\s+", " ")
    if case:
        c = {"upper": F.upper, "lower": F.lower, "title": title}[case](c)
    return F.when(~is_null_or_whitespace(c), c) if blank_is_null else c


def title(c: Column) -> Column:
    """Words in lower case with their first letter in upper case; words end at anything but letters and apostrophes."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"((?U)[\p{L}'\p{N}]+|[^\p{L}'\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")
