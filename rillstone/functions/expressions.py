"""The expression language: C-like text over attributes, compiled once to a Column.

    mv["Attribute"] and cs["Attribute"], text, numbers, true, false, null, ( ), ! -, * / %, + -, < <= > >=,
    == !=, &&, ||, a ? b : c, and calls of the built-in functions.

`+` with a text operand joins texts, and null is the empty text there. `/` of whole numbers drops the rest.
Types come from the schema, when the text is compiled; branches of one result must agree.

What can't be computed for a row (a number out of range, a division by zero) is an error of that row: its result is null,
and a second column says why. && || and ? : look only at what they need; the arguments of calls are all computed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.functions import scalars as S
from rillstone.schema import Kind

LONGEST = 10_000
DECIMAL = "decimal(38,10)"
_KINDS = {Kind.NUMBER: "int", Kind.LONG: "bigint", Kind.DECIMAL: DECIMAL, Kind.BOOLEAN: "boolean", Kind.DATETIME: "timestamp", Kind.BINARY: "binary"}
_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<name>[A-Za-z_]\w*)
    |(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:()\[\],]))""",
    re.X,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


class ExpressionError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass
class Typed:
    column: Column
    kind: str  # string, int, bigint, decimal(38,10), boolean, timestamp, binary, array or null
    constant: object = None  # the value of a literal
    error: Column | None = None  # null where it could be computed


@dataclass
class Compiled:
    column: Column
    kind: str
    inputs: list[tuple[str, str]]  # (mv or cs, attribute), as written, without repeats
    error: Column | None = None

    @property
    def errors(self) -> Column:
        return F.lit(None).cast("string") if self.error is None else self.error


NUMBERS = {"int": 0, "bigint": 1, DECIMAL: 2}


def _first(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


def _where(test: Column, error: Column | None) -> Column | None:
    return None if error is None else F.when(test, error)


def _lost(made: Column, *of: Column) -> Column:
    """An error where all operands have values and the result has none."""
    return F.when(functools.reduce(lambda p, q: p & q, [c.isNotNull() for c in of]) & made.isNull(), F.lit("out of range"))


def _text(x: Typed) -> Column:
    return F.coalesce(S.to_string(x.column, x.kind), F.lit(""))


class Parser:
    def __init__(self, text: str, kinds: dict[str, dict[str, tuple[str, Column]]], now: Column):
        if len(text) > LONGEST:
            raise ExpressionError("the expression is too long", LONGEST)
        self.kinds, self.now, self.inputs, self.tokens, at = kinds, now, [], [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:].lstrip()[0]!r}", at + len(text[at:]) - len(text[at:].lstrip()))
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup) - (m.lastgroup == "str")))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i = 0

    def peek(self, *ops: str) -> bool:
        kind, value, _ = self.tokens[self.i]
        return kind == "op" and value in ops

    def take(self, op: str | None = None) -> tuple[str, str, int]:
        t = self.tokens[self.i]
        if op is not None and not self.peek(op):
            raise ExpressionError(f"expected {op!r}", t[2])
        self.i += 1
        return t

    def whole(self) -> Typed:
        x = self.choice()
        if self.tokens[self.i][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.i][1]!r}", self.tokens[self.i][2])
        return x

    def choice(self) -> Typed:
        x = self.binary(0)
        if self.peek("?"):
            at = self.take()[2]
            a = self.choice()
            self.take(":")
            return self.pick(x, a, self.choice(), at)
        return x

    def pick(self, test: Typed, a: Typed, b: Typed, at: int) -> Typed:
        a, b, kind = self.unified(a, b, at)
        yes = self.boolean(test, at)
        return Typed(F.when(yes, a.column).otherwise(b.column), kind, error=_first(test.error, _where(yes, a.error), _where(~yes, b.error)))

    def unified(self, a: Typed, b: Typed, at: int) -> tuple[Typed, Typed, str]:
        if a.kind == "null" or b.kind == "null":
            kind = b.kind if a.kind == "null" else a.kind
        elif a.kind in NUMBERS and b.kind in NUMBERS:
            kind = max(a.kind, b.kind, key=NUMBERS.get)
        elif a.kind == b.kind:
            kind = a.kind
        else:
            raise ExpressionError(f"{a.kind} and {b.kind} don't agree", at)
        if kind in ("null", "array"):
            return a, b, kind
        return Typed(a.column.cast(kind), kind, error=a.error), Typed(b.column.cast(kind), kind, error=b.error), kind

    def boolean(self, x: Typed, at: int) -> Column:
        if x.kind not in ("boolean", "null"):
            raise ExpressionError(f"a {x.kind} is no condition", at)
        return F.coalesce(x.column.cast("boolean"), F.lit(False))

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))

    def binary(self, level: int) -> Typed:
        if level == len(self.LEVELS):
            return self.unary()
        x = self.binary(level + 1)
        while self.peek(*self.LEVELS[level]):
            _, op, at = self.take()
            x = self.apply(op, x, self.binary(level + 1), at)
        return x

    def apply(self, op: str, a: Typed, b: Typed, at: int) -> Typed:
        if op in ("||", "&&"):
            p, q = self.boolean(a, at), self.boolean(b, at)
            return Typed(p | q if op == "||" else p & q, "boolean", error=_first(a.error, _where(~p if op == "||" else p, b.error)))
        errors = _first(a.error, b.error)
        if op in ("==", "!="):
            same = S.eq(a.column, b.column, a.kind, b.kind) if "null" not in (a.kind, b.kind) else a.column.isNull() & b.column.isNull()
            return Typed(same if op == "==" else ~same, "boolean", error=errors)
        if op == "+" and "string" in (a.kind, b.kind):
            return Typed(F.concat(_text(a), _text(b)), "string", error=errors)
        a, b, kind = self.unified(a, b, at)
        if op in ("<", "<=", ">", ">="):
            x, y = a.column, b.column
            found = x < y if op == "<" else x <= y if op == "<=" else x > y if op == ">" else x >= y
            return Typed(F.coalesce(found, F.lit(False)), "boolean", error=errors)
        if kind not in NUMBERS:
            raise ExpressionError(f"{op} isn't for {kind}", at)
        return self.arithmetic(op, a.column, b.column, kind, errors)

    def arithmetic(self, op: str, x: Column, y: Column, kind: str, errors: Column | None) -> Typed:
        if op in ("/", "%"):
            zero, safe = y == 0, F.nullif(y, F.lit(0).cast(kind))
            if op == "%":
                made = x % safe
            elif kind == DECIMAL:
                made = F.try_divide(x, safe)
            else:  # whole numbers: what is left after the rest divides evenly, which decimals give exactly
                made = F.try_divide((x - x % safe).cast("decimal(20,0)"), safe.cast("decimal(20,0)"))
            made = made.try_cast(kind)
            return Typed(made, kind, error=_first(errors, F.when(x.isNotNull() & zero, F.lit("division by zero")), _lost(made, x, safe)))
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y).try_cast(kind)
        return Typed(made, kind, error=_first(errors, _lost(made, x, y)))

    def unary(self) -> Typed:
        if self.peek("!"):
            at = self.take()[2]
            x = self.unary()
            return Typed(~self.boolean(x, at), "boolean", error=x.error)
        if self.peek("-"):
            at = self.take()[2]
            x = self.unary()
            if x.kind not in NUMBERS:
                raise ExpressionError(f"- isn't for {x.kind}", at)
            if x.constant is not None:
                return Typed(-x.column, x.kind, -x.constant)
            return self.arithmetic("-", F.lit(0).cast(x.kind), x.column, x.kind, x.error)
        return self.primary()

    def primary(self) -> Typed:
        kind, value, at = self.take()
        if kind == "num":
            if re.fullmatch(r"\d+", value):
                n = int(value)
                return Typed(F.lit(n).cast("int" if n < 1 << 31 else "bigint"), "int" if n < 1 << 31 else "bigint", n)
            return Typed(F.lit(value).cast(DECIMAL), DECIMAL, float(value))
        if kind == "str":
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value)
            return Typed(F.lit(text), "string", text)
        if kind == "op" and value == "(":
            x = self.choice()
            self.take(")")
            return x
        if kind != "name":
            raise ExpressionError("expected a value" if kind == "end" else f"unexpected {value!r}", at)
        if value in ("true", "false"):
            return Typed(F.lit(value == "true"), "boolean", value == "true")
        if value == "null":
            return Typed(F.lit(None), "null")
        if value in ("mv", "cs") and self.peek("["):
            self.take("[")
            k, name, where = self.take()
            if k != "str":
                raise ExpressionError("expected an attribute's name in quotes", where)
            self.take("]")
            known = self.kinds.get(value, {})
            if name.lower() not in known:
                raise ExpressionError(f"no attribute {name}", where)
            if (value, name) not in self.inputs:
                self.inputs.append((value, name))
            return Typed(known[name.lower()][1], known[name.lower()][0])
        self.take("(")
        args: list[Typed] = []
        while not self.peek(")"):
            if args:
                self.take(",")
            args.append(self.choice())
        self.take(")")
        return self.call(value, args, at)

    def call(self, name: str, args: list[Typed], at: int) -> Typed:
        if name not in FUNCTIONS:
            raise ExpressionError(f"no function {name}", at)
        least, most, make = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments", at)
        try:
            made = make(self, args, at)
            return replace(made, error=_first(*(a.error for a in args)) if name not in ("IIF", "Eq") else _first(made.error, *(a.error for a in args)))
        except ExpressionError:
            raise
        except ValueError as e:
            raise ExpressionError(str(e), at) from None


def _simple(fn: Callable[..., Column], out: str, *kinds: str) -> Callable:
    """A function of typed columns; text arguments take any single value as text, `int` ones whole numbers."""

    def make(_: Parser, args: list[Typed], at: int) -> Typed:
        cols = []
        for a, k in zip(args, kinds, strict=False):
            if k == "string":
                if a.kind == "array":
                    raise ExpressionError("a list is no text", at)
                cols.append(S.to_string(a.column, a.kind) if a.kind != "string" else a.column)
            else:
                cols.append(S.to_int(a.column) if k == "int" else a.column)
        return Typed(fn(*cols), out)

    return make


def _constant(x: Typed, at: int) -> object:
    if x.constant is None:
        raise ExpressionError("expected a constant", at)
    return x.constant


def _iif(p: Parser, a: list[Typed], at: int) -> Typed:
    return p.pick(a[0], a[1], a[2], at)


def _coalesce(p: Parser, a: list[Typed], at: int) -> Typed:
    x, y, kind = p.unified(a[0], a[1], at)
    return Typed(F.coalesce(x.column, y.column), kind)


def _join(_: Parser, a: list[Typed], at: int) -> Typed:
    if a[0].kind != "array":
        return Typed(S.to_string(a[0].column, a[0].kind), "string")
    return Typed(S.join(a[0].column, a[1].column if len(a) > 1 else None), "string")


FUNCTIONS: dict[str, tuple[int, int, Callable[[Parser, list[Typed], int], Typed]]] = {
    "Trim": (1, 1, _simple(S.trim, "string", "string")),
    "Upper": (1, 1, _simple(F.upper, "string", "string")),
    "Lower": (1, 1, _simple(F.lower, "string", "string")),
    "Capitalise": (1, 1, _simple(S.capitalise, "string", "string")),
    "Left": (2, 2, _simple(S.left, "string", "string", "int")),
    "Right": (2, 2, _simple(S.right, "string", "string", "int")),
    "Substring": (3, 3, _simple(S.substring, "string", "string", "int", "int")),
    "Replace": (3, 3, _simple(S.replace, "string", "string", "string", "string")),
    "StartsWith": (2, 2, _simple(S.starts_with, "boolean", "string", "string")),
    "EndsWith": (2, 2, _simple(S.ends_with, "boolean", "string", "string")),
    "Contains": (2, 2, _simple(S.contains, "boolean", "string", "string")),
    "Length": (1, 1, _simple(S.length, "int", "string")),
    "IsNullOrEmpty": (1, 1, _simple(S.is_null_or_empty, "boolean", "string")),
    "IsNullOrWhitespace": (1, 1, _simple(S.is_null_or_whitespace, "boolean", "string")),
    "CollectionContains": (2, 2, lambda p, a, at: Typed(S.collection_contains(a[0].column, a[1].column, a[0].kind == "array"), "boolean")),
    "Split": (2, 2, _simple(S.split, "array", "string", "string")),
    "Join": (1, 2, _join),
    "Coalesce": (2, 2, _coalesce),
    "IIF": (3, 3, _iif),
    "Eq": (2, 2, lambda p, a, at: p.apply("==", a[0], a[1], at)),
    "Now": (0, 0, lambda p, a, at: Typed(p.now, "timestamp")),
    "Today": (0, 0, lambda p, a, at: Typed(S.today(p.now), "timestamp")),
    "FormatDate": (2, 2, lambda p, a, at: Typed(S.format_date(a[0].column.cast("timestamp"), str(_constant(a[1], at))), "string")),
    "ToFileTime": (1, 1, lambda p, a, at: Typed(S.to_file_time(a[0].column, a[0].kind), "bigint")),
    "FromFileTime": (1, 1, lambda p, a, at: Typed(S.from_file_time(a[0].column), "timestamp")),
    "ToString": (1, 1, _simple(lambda c: c, "string", "string")),
    "ToInt": (1, 1, _simple(lambda c: c, "int", "int")),
    "ToDecimal": (1, 1, lambda p, a, at: Typed(S.to_decimal(a[0].column), DECIMAL)),
    "EscapeDN": (1, 1, _simple(S.escape_dn, "string", "string")),
    "RandomPassword": (0, 2, lambda p, a, at: Typed(S.random_password(*(_constant(x, at) for x in a)), "string")),
    "RandomPassphrase": (0, 2, lambda p, a, at: Typed(S.random_passphrase(*(_constant(x, at) for x in a)), "string")),
    "EnableUser": (1, 1, _simple(S.enable_user, "int", "int")),
    "DisableUser": (1, 1, _simple(S.disable_user, "int", "int")),
    "SetBit": (2, 2, _simple(S.set_bit, "int", "int", "int")),
    "ClearBit": (2, 2, _simple(S.clear_bit, "int", "int", "int")),
    "HasBit": (2, 2, _simple(S.has_bit, "boolean", "int", "int")),
}


def attributes_of(kinds: dict[str, Kind], many: frozenset[str] = frozenset(), prefix: str = "") -> dict[str, tuple[str, Column]]:
    """A lookup for compile_expression: lower-case names to (type, column)."""
    return {n.lower(): ("array" if n in many else _KINDS.get(k, "string"), F.col(prefix + n)) for n, k in kinds.items()}


def compile_expression(text: str, mv: dict | None = None, cs: dict | None = None, now: Column | None = None) -> Compiled:
    """The text as a Column; an ExpressionError names the place of a mistake. mv and cs come from attributes_of."""
    p = Parser(text, {"mv": mv or {}, "cs": cs or {}}, F.current_timestamp() if now is None else now)
    x = p.whole()
    return Compiled(x.column if x.error is None else F.when(x.error.isNull(), x.column), x.kind, p.inputs, x.error)


def check_expression(text: str, mv: dict | None = None, cs: dict | None = None) -> tuple[bool, str | None, int | None]:
    """(valid, message, position)."""
    try:
        compile_expression(text, mv, cs)
    except ExpressionError as e:
        return False, str(e), e.position
    return True, None, None


def coerced(x: Compiled, target: Kind) -> tuple[Column, Column]:
    """(value, error) of a result for an attribute: whole numbers widen, text is read, a long that is no int is an error,
    as is what could not be computed."""
    value, error = _coerced(x, target)
    return value, error if x.error is None else F.coalesce(x.error, error)


def _coerced(x: Compiled, target: Kind) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    c, to = x.column, target.spark
    if x.kind == "null":
        return F.lit(None).cast(to), none
    if x.kind == "string" and target not in (Kind.TEXT, Kind.REFERENCE):
        from rillstone.schema import parsed

        value = parsed(c, target)
        return value, F.when(c.isNotNull() & (c != "") & value.isNull(), F.lit(f"not a {target.name}"))
    if target in (Kind.TEXT, Kind.REFERENCE, Kind.GUID):
        return S.to_string(c, x.kind), none
    if x.kind in NUMBERS and target in (Kind.NUMBER, Kind.LONG, Kind.DECIMAL):
        value = c.try_cast(to)
        if x.kind == DECIMAL and target is not Kind.DECIMAL:
            value = F.when(c == F.floor(c), value)
        return value, F.when(c.isNotNull() & value.isNull(), F.lit(f"out of range for {target.name}"))
    if x.kind == to:
        return c, none
    return F.lit(None).cast(to), F.when(c.isNotNull(), F.lit(f"a {x.kind} is no {target.name}"))


def with_missing_inputs(x: Compiled, mv: dict, cs: dict, direction: str, behaviour: str) -> tuple[Column, Column]:
    """(value, error) when an input attribute of the direction's accessor is null or empty.

    behaviour: evaluate (anyway), no_value, fail_mapping or fail_object (the error says so). What isn't evaluated has no
    errors of its own: x.error is masked.
    """
    none = F.lit(None).cast("string")
    known = mv if direction == "mv" else cs
    missing = F.lit(False)
    for accessor, name in x.inputs:
        if accessor == direction:
            kind, c = known[name.lower()]
            missing = missing | (F.coalesce(F.size(c), F.lit(0)) <= 0 if kind == "array" else S.is_null_or_empty(c) if kind == "string" else c.isNull())
    if behaviour == "evaluate":
        return x.column, none
    error = {"no_value": none, "fail_mapping": F.when(missing, F.lit("mapping: missing input")), "fail_object": F.when(missing, F.lit("object: missing input"))}
    if behaviour not in error:
        raise ValueError(f"no behaviour {behaviour}")
    x.error = _where(~missing, x.error)
    return F.when(~missing, x.column), error[behaviour]
