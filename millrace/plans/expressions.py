"""Expression trees to Columns. One pass on the driver; no Python runs on rows.

Kinds: num (double), str, bool, date (timestamp), arr, obj, null. In strict mode nulls follow SQL and
a division by zero is null; in compat mode nulls count as 0 or "null" and division gives infinities,
as in the loosely typed original language."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.parsing import ExpressionError, Node, parse

CONSTANTS = {"NaN": math.nan, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": math.log2(math.e), "LOG10E": math.log10(math.e), "PI": math.pi, "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2)}


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str
    type: T.DataType | None = None
    literal: object = None


@dataclass
class Context:
    """What names mean: datum's schema, further structs, the mode and the clock."""

    schema: T.StructType
    compat: bool = False
    now: datetime.datetime | None = None
    roots: Mapping[str, Value] = field(default_factory=dict)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "arr"
    if isinstance(t, (T.StructType, T.MapType)):
        return "obj"
    if isinstance(t, T.NullType):
        return "null"
    return "str"


def value_of(column: Column, t: T.DataType) -> Value:
    kind = kind_of(t)
    return Value(column.cast("double") if kind == "num" else column, kind, t)


class Compiler:
    def __init__(self, context: Context) -> None:
        self.c = context

    # -- coercions

    def truthy(self, v: Value) -> Column:
        """null, 0 and '' are false; NaN, arrays and objects are true."""
        x = v.column
        test = {"bool": lambda: x, "num": lambda: x != 0, "str": lambda: x != "", "null": lambda: F.lit(False)}.get(v.kind, lambda: x.isNotNull())()
        return F.coalesce(test, F.lit(False))

    def number(self, v: Value) -> Column:
        x = v.column
        if v.kind == "num":
            out = x
        elif v.kind == "bool":
            out = x.cast("int").cast("double")
        elif v.kind == "date":
            out = F.unix_millis(x.cast("timestamp")).cast("double")
        elif v.kind == "str":
            out = F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double")).when(x.isNotNull(), F.lit(math.nan))
        elif v.kind == "null":
            out = F.lit(None).cast("double")
        elif v.kind == "arr":
            out = F.when(F.size(x) == 0, F.lit(0.0)).when(F.size(x) == 1, F.element_at(x, 1).cast("string").try_cast("double")).when(x.isNotNull(), F.lit(math.nan))
        else:
            out = F.when(x.isNotNull(), F.lit(math.nan))
        return F.coalesce(out, F.lit(0.0)) if self.c.compat else out

    def string(self, v: Value) -> Column:
        x = v.column
        if v.kind == "num":
            out = number_text(x)
        elif v.kind == "arr":
            out = F.array_join(F.transform(x, lambda e: F.coalesce(e.cast("string"), F.lit(""))), ",")
        elif v.kind == "obj":
            out = F.when(x.isNotNull(), F.lit("[object Object]"))
        elif v.kind == "null":
            out = F.lit(None).cast("string")
        elif v.kind == "date":
            out = F.date_format(x, "EEE MMM dd yyyy HH:mm:ss 'GMT+0000'")
        else:
            out = x.cast("string")
        return F.coalesce(out, F.lit("null")) if self.c.compat else out

    def time(self, v: Value) -> Column:
        return v.column.cast("timestamp") if v.kind == "date" else F.timestamp_millis(F.nullif(self.number(v), F.lit(math.nan)).cast("long"))

    # -- the tree

    def compile(self, node: Node) -> Value:
        return getattr(self, "_" + node[0])(*node[1:])

    def _num(self, x: float) -> Value:
        return Value(F.lit(x), "num", T.DoubleType(), x)

    def _str(self, x: str) -> Value:
        return Value(F.lit(x), "str", T.StringType(), x)

    def _bool(self, x: bool) -> Value:
        return Value(F.lit(x), "bool", T.BooleanType(), x)

    def _null(self) -> Value:
        return Value(F.lit(None), "null", T.NullType())

    def _re(self, pattern: str, flags: str) -> Value:
        if set(flags) - set("gimsu"):
            raise ExpressionError(f"flags {flags!r} are not supported")
        inline = "".join(sorted(set(flags) & set("ims")))
        return Value(F.lit(f"(?{inline}){pattern}" if inline else pattern), "re", None, (f"(?{inline}){pattern}" if inline else pattern, flags))

    def _arr(self, items: list[Node]) -> Value:
        values = [self.compile(i) for i in items]
        kinds = {v.kind for v in values} - {"null"}
        if kinds == {"num"}:
            return Value(F.array(*[v.column.cast("double") for v in values]), "arr", T.ArrayType(T.DoubleType()))
        return Value(F.array(*[self.string(v) for v in values]) if values else F.expr("cast(array() as array<string>)"), "arr", T.ArrayType(T.StringType()))

    def _obj(self, items: list[tuple[str, Node]]) -> Value:
        values = [(k, self.compile(v)) for k, v in items]
        return Value(F.struct(*[v.column.alias(k) for k, v in values]), "obj", T.StructType([T.StructField(k, v.type or T.StringType()) for k, v in values]))

    def _id(self, name: str) -> Value:
        if name in CONSTANTS:
            return self._num(CONSTANTS[name])
        if name in self.c.roots:
            return self.c.roots[name]
        if name == "datum":
            return Value(F.struct(*[F.col(f"`{f.name}`") for f in self.c.schema]), "obj", self.c.schema)
        return self._null()

    def _member(self, node: Node, name: str) -> Value:
        if node == ("id", "datum") and "datum" not in self.c.roots:
            return value_of(F.col(f"`{name}`"), self.c.schema[name].dataType) if name in self.c.schema.names else self._null()
        v = self.compile(node)
        if name == "length" and v.kind in ("str", "arr"):
            return self.call("length", [v])
        if isinstance(v.type, T.StructType):
            return value_of(v.column.getField(name), v.type[name].dataType) if name in v.type.names else self._null()
        if isinstance(v.type, T.MapType):
            return value_of(F.try_element_at(v.column, F.lit(name)), v.type.valueType)
        return self._null()

    def _index(self, node: Node, index: Node) -> Value:
        if index[0] == "str":
            return self._member(node, index[1])
        v, i = self.compile(node), self.compile(index)
        if isinstance(v.type, T.ArrayType):
            return value_of(F.get(v.column, self.number(i).cast("int")), v.type.elementType)
        if v.kind == "str":
            at = self.number(i).cast("int")
            return Value(F.when((at >= 0) & (at < F.length(v.column)), F.substring(v.column, at + 1, F.lit(1))), "str", T.StringType())
        return self._null()

    def _cond(self, test: Node, yes: Node, no: Node) -> Value:
        return self.choose(self.truthy(self.compile(test)), self.compile(yes), self.compile(no))

    def choose(self, test: Column, a: Value, b: Value) -> Value:
        if a.kind == b.kind or b.kind == "null":
            return Value(F.when(test, a.column).otherwise(b.column), a.kind, a.type)
        if a.kind == "null":
            return Value(F.when(test, a.column).otherwise(b.column), b.kind, b.type)
        if {a.kind, b.kind} <= {"num", "bool"}:
            return Value(F.when(test, self.number(a)).otherwise(self.number(b)), "num", T.DoubleType())
        return Value(F.when(test, self.string(a)).otherwise(self.string(b)), "str", T.StringType())

    def _un(self, op: str, node: Node) -> Value:
        v = self.compile(node)
        if op == "!":
            return Value(~self.truthy(v), "bool", T.BooleanType())
        if op == "~":
            return Value(F.bitwise_not(self._int(v)).cast("double"), "num", T.DoubleType())
        x = self.number(v)
        return Value(-x if op == "-" else x, "num", T.DoubleType(), None if v.literal is None or v.kind != "num" else (-v.literal if op == "-" else v.literal))

    def _int(self, v: Value) -> Column:
        """Truncated to 32 bits, wrapping; NaN and infinities are 0."""
        x = self.number(v)
        whole = F.when(F.isnan(x) | (F.abs(x) == math.inf), F.lit(0)).otherwise(F.signum(x) * F.floor(F.abs(x)))
        wrapped = F.pmod(whole + F.lit(2147483648.0), F.lit(4294967296.0)) - F.lit(2147483648.0)
        return wrapped.cast("int")

    def _bin(self, op: str, left: Node, right: Node) -> Value:
        a, b = self.compile(left), self.compile(right)
        if op in ("&&", "||"):
            test = self.truthy(a)
            if a.kind == b.kind == "bool":
                both = (test & self.truthy(b)) if op == "&&" else (test | self.truthy(b))
                return Value(both, "bool", T.BooleanType())
            return self.choose(test, b, a) if op == "&&" else self.choose(test, a, b)
        if op in ("==", "!=", "===", "!=="):
            same = self.equal(a, b, strict=len(op) == 3)
            return Value(~same if op[0] == "!" else same, "bool", T.BooleanType())
        if op in ("<", "<=", ">", ">="):
            return Value(F.coalesce(self.ordered(op, a, b), F.lit(False)), "bool", T.BooleanType())
        if op == "+" and "str" in (a.kind, b.kind):
            return Value(F.concat(self.string(a), self.string(b)), "str", T.StringType())
        if op in ("&", "|", "^", "<<", ">>", ">>>"):
            x, y = self._int(a), self._int(b)
            n = self.number(b).cast("int").bitwiseAND(31)
            out = {"&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "^": lambda: x.bitwiseXOR(y), "<<": lambda: F.call_function("shiftleft", x, n), ">>": lambda: F.call_function("shiftright", x, n), ">>>": lambda: F.call_function("shiftrightunsigned", x.cast("long").bitwiseAND(F.lit(4294967295)), n)}[op]()
            return Value(out.cast("double"), "num", T.DoubleType())
        x, y = self.number(a), self.number(b)
        if op == "/":
            out = F.try_divide(x, y) if not self.c.compat else F.when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), F.lit(math.nan)).otherwise(F.signum(x) * F.lit(math.inf))
        elif op == "%":
            out = F.when(y != 0, F.try_mod(x, y)).otherwise(F.lit(math.nan) if self.c.compat else F.lit(None).cast("double"))
        else:
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
        return Value(out, "num", T.DoubleType())

    def ordered(self, op: str, a: Value, b: Value) -> Column:
        """A comparison, null where an operand is; NaN is neither less nor more than anything.

        Spark sorts NaN last, so only the side that would win by it is tested; literals aren't."""
        text = "str" in (a.kind, b.kind) and (self.c.compat or a.kind == b.kind)
        x, y = (self.string(a), self.string(b)) if text else (self.number(a), self.number(b))
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        larger, v = (y, b) if op[0] == "<" else (x, a)
        if text or v.literal is not None or isinstance(v.type, (T.IntegralType, T.DecimalType)) or v.kind in ("bool", "date"):
            return test
        return test & ~F.isnan(larger)

    def test(self, node: Node) -> Column:
        """A tree as a filter: null counts as false, so comparisons stay bare and reach the scan."""
        if node[0] == "bin" and node[1] in ("&&", "||"):
            x, y = self.test(node[2]), self.test(node[3])
            return (x & y) if node[1] == "&&" else (x | y)
        if node[0] == "bin" and node[1] in ("<", "<=", ">", ">="):
            return self.ordered(node[1], self.compile(node[2]), self.compile(node[3]))
        if node[0] == "bin" and node[1] in ("==", "===") and not self.c.compat:
            a, b = self.compile(node[2]), self.compile(node[3])
            if a.kind == b.kind and a.kind in ("num", "str", "bool", "date"):
                # A bare equality can be a join's key; NaN equals nothing, though Spark says it equals itself.
                fractional = isinstance(a.type, T.FractionalType) and isinstance(b.type, T.FractionalType) and a.literal is None and b.literal is None
                return (a.column == b.column) & ~F.isnan(a.column) if fractional else a.column == b.column
        v = self.compile(node)
        return v.column if v.kind == "bool" else self.truthy(v)

    def equal(self, a: Value, b: Value, strict: bool = False) -> Column:
        if "null" in (a.kind, b.kind):
            other = b if a.kind == "null" else a
            return other.column.isNull() if other.kind != "null" else F.lit(True)
        if a.kind in ("arr", "obj") or b.kind in ("arr", "obj"):
            return F.lit(False)  # compared by identity, which a row has none of
        if a.kind == b.kind:
            x, y = (self.number(a), self.number(b)) if a.kind in ("num", "date") else (a.column, b.column)
            same = (x == y) & ~F.isnan(x) if a.kind == "num" else x == y
        elif strict:
            same = F.lit(False)
        elif {"num", "date", "bool"} & {a.kind, b.kind}:
            x, y = self.number(a), self.number(b)
            same = (x == y) & ~F.isnan(x)
        else:
            same = self.string(a) == self.string(b)
        return F.coalesce(same, a.column.isNull() & b.column.isNull())

    # -- functions

    def _call(self, target: Node, args: list[Node]) -> Value:
        if target[0] != "id":
            return self._null()
        return self.call(target[1], [self.compile(a) for a in args])

    def call(self, name: str, args: list[Value]) -> Value:
        if name == "if":
            return self.choose(self.truthy(args[0]), args[1], args[2] if len(args) > 2 else self._null())
        make = _FUNCTIONS.get(name)
        if make is None:
            return self._null()
        kind, build = make
        t = {"num": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "date": T.TimestampType()}.get(kind)
        out = build(self, args)
        return out if isinstance(out, Value) else Value(out.cast("double") if kind == "num" else out, kind, t)


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, small and large ones without an exponent below 1e21."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    text = F.regexp_replace(x.cast("string"), r"\.0(E|$)", "$1")
    return F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == math.inf, F.when(x > 0, "Infinity").otherwise("-Infinity")).when(whole, x.cast("long").cast("string")).when((F.abs(x) >= 1e-6) & (F.abs(x) < 1e21), F.regexp_replace(F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(text)


def _one(f: Callable[[Column], Column]):
    return lambda c, a: f(c.number(a[0])) if a else F.lit(math.nan)


def _two(f: Callable[[Column, Column], Column]):
    return lambda c, a: f(c.number(a[0]), c.number(a[1]))


def _extreme(f, empty: float):
    def build(c: Compiler, a: list[Value]) -> Column:
        some = [F.nanvl(c.number(v), F.lit(None).cast("double")) for v in a]
        return F.coalesce(f(*some, F.lit(None).cast("double")) if some else F.lit(empty), F.lit(empty))

    return build


def _part(f: Callable[[Column], Column]):
    return lambda c, a: f(c.time(a[0] if a else Value(_now(c), "date", T.TimestampType())))


def _now(c: Compiler) -> Column:
    return F.lit(c.c.now) if c.c.now else F.current_timestamp()


def _datetime(c: Compiler, a: list[Value]) -> Column:
    if not a:
        return _now(c)
    if len(a) == 1:
        if a[0].kind in ("num", "date"):
            return c.time(a[0])
        return F.try_to_timestamp(c.string(a[0]))
    parts = [c.number(v) for v in a] + [F.lit(x) for x in (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)[len(a) :]]
    year, month, day, hour, minute, second, ms = parts
    start = F.make_timestamp(F.floor(year + F.floor(month / 12)).cast("int"), (F.pmod(month, F.lit(12.0)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_millis(F.unix_millis(start) + ((day - 1) * 86400000 + hour * 3600000 + minute * 60000 + second * 1000 + ms).cast("long"))


def _length(c: Compiler, a: list[Value]) -> Column:
    if a[0].kind == "arr":
        return F.size(a[0].column)
    if a[0].kind != "str":
        return F.lit(None).cast("double")
    # UTF-16 units: characters outside the first plane count twice
    x = a[0].column
    return F.length(x) + F.length(F.regexp_replace(x, "[^\U00010000-\U0010ffff]", ""))


def _indexof(c: Compiler, a: list[Value]) -> Column:
    if isinstance(a[0].type, T.ArrayType):
        return F.array_position(a[0].column, a[1].column.cast(a[0].type.elementType)) - 1
    return F.call_function("position", c.string(a[1]), c.string(a[0])) - 1


def _lastindexof(c: Compiler, a: list[Value]) -> Column:
    if isinstance(a[0].type, T.ArrayType):
        n, at = F.size(a[0].column), F.array_position(F.reverse(a[0].column), a[1].column.cast(a[0].type.elementType))
        return F.when(at == 0, F.lit(-1)).otherwise(n - at)
    text, want = c.string(a[0]), c.string(a[1])
    at = F.call_function("position", F.reverse(want), F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - F.length(want) - at + 1)


def _replace(c: Compiler, a: list[Value]) -> Column:
    text, by = c.string(a[0]), c.string(a[2])
    if a[1].kind != "re":
        return F.replace(text, c.string(a[1]), by)
    pattern, flags = a[1].literal
    if "g" in flags:
        return F.regexp_replace(text, F.lit(pattern), by)
    found = F.regexp_instr(text, F.lit(pattern))
    head = F.substring(text, F.lit(1), found - 1)
    tail = F.substring(text, found, F.length(text))
    hit = F.regexp_substr(text, F.lit(pattern))
    return F.when(found > 0, F.concat(head, F.regexp_replace(hit, F.lit(pattern), by), F.substring(tail, F.length(hit) + 1, F.length(text)))).otherwise(text)


def _test(c: Compiler, a: list[Value]) -> Column:
    pattern = a[0].literal[0] if a[0].kind == "re" else a[0].literal
    return F.coalesce(c.string(a[1]).rlike(pattern), F.lit(False))


def _regexp(c: Compiler, a: list[Value]) -> Value:
    return c._re(str(a[0].literal), str(a[1].literal) if len(a) > 1 else "")


def _slice(c: Compiler, a: list[Value]) -> Column:
    n = F.length(c.string(a[0])).cast("double")
    fix = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0.0))).otherwise(F.least(x, n))
    begin = fix(c.number(a[1]))
    end = fix(c.number(a[2])) if len(a) > 2 else n
    return F.substring(c.string(a[0]), (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0.0)).cast("int"))


def _substring(c: Compiler, a: list[Value]) -> Column:
    n = F.length(c.string(a[0])).cast("double")
    fix = lambda x: F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), n)
    x, y = fix(c.number(a[1])), fix(c.number(a[2])) if len(a) > 2 else n
    return F.substring(c.string(a[0]), (F.least(x, y) + 1).cast("int"), F.abs(y - x).cast("int"))


def _parse_int(c: Compiler, a: list[Value]) -> Column:
    text = F.trim(c.string(a[0]))
    base = int(a[1].literal) if len(a) > 1 and a[1].literal is not None else 10
    if base == 10:
        return F.coalesce(F.nullif(F.regexp_extract(text, r"^[+-]?\d+", 0), F.lit("")).try_cast("double"), F.lit(math.nan))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    body = F.regexp_extract(F.lower(text), rf"^[+-]?(?:0x)?([{digits}]+)", 1)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(body == "", F.lit(math.nan)).otherwise(sign * F.conv(body, base, 10).cast("double"))


def _inrange(c: Compiler, a: list[Value]) -> Column:
    x, lo, hi = c.number(a[0]), F.least(c.number(a[1]), c.number(a[2])), F.greatest(c.number(a[1]), c.number(a[2]))
    inside = (x >= lo) & (x <= hi)
    return F.when(c.truthy(a[3]), (x > lo) & (x < hi)).otherwise(inside) if len(a) > 3 else inside


def _format(c: Compiler, a: list[Value]) -> Column:
    from millrace.functions.numbers import d3_format

    return d3_format(c.number(a[0]), str(a[1].literal))


def _time_format(c: Compiler, a: list[Value]) -> Column:
    from millrace.functions.dates import strftime

    return strftime(c.time(a[0]), str(a[1].literal))


_DATE = {"date": F.dayofmonth, "day": lambda t: F.dayofweek(t) - 1, "year": F.year, "month": lambda t: F.month(t) - 1, "hours": F.hour, "minutes": F.minute, "seconds": lambda t: F.floor(F.second(t)), "milliseconds": lambda t: F.pmod(F.unix_millis(t), F.lit(1000))}

_FUNCTIONS: dict[str, tuple[str, Callable]] = {
    "isNaN": ("bool", lambda c, a: F.isnan(c.number(a[0]))),
    "isFinite": ("bool", lambda c, a: ~F.isnan(c.number(a[0])) & (F.abs(c.number(a[0])) < math.inf)),
    **{n: ("num", _one(f)) for n, f in {"abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": F.ceil, "cos": F.cos, "exp": F.exp, "floor": F.floor, "log": lambda x: F.when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)), "round": lambda x: F.round(x), "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan}.items()},
    "atan2": ("num", _two(F.atan2)),
    "pow": ("num", _two(F.pow)),
    "max": ("num", _extreme(F.greatest, -math.inf)),
    "min": ("num", _extreme(F.least, math.inf)),
    "random": ("num", lambda c, a: F.rand(0)),
    "clamp": ("num", lambda c, a: F.least(F.greatest(c.number(a[0]), c.number(a[1])), c.number(a[2]))),
    "inrange": ("bool", _inrange),
    "now": ("num", lambda c, a: F.unix_millis(_now(c))),
    "datetime": ("date", _datetime),
    "utc": ("date", _datetime),
    **{p + n: ("num", _part(f)) for p in ("", "utc") for n, f in _DATE.items()},
    "time": ("num", lambda c, a: F.unix_millis(c.time(a[0]))),
    "timezoneoffset": ("num", lambda c, a: F.lit(0.0)),
    "length": ("num", _length),
    "indexof": ("num", _indexof),
    "lastindexof": ("num", _lastindexof),
    "parseFloat": ("num", lambda c, a: F.coalesce(F.nullif(F.regexp_extract(F.trim(c.string(a[0])), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double"), F.lit(math.nan))),
    "parseInt": ("num", _parse_int),
    "upper": ("str", lambda c, a: F.upper(c.string(a[0]))),
    "lower": ("str", lambda c, a: F.lower(c.string(a[0]))),
    "replace": ("str", _replace),
    "slice": ("str", _slice),
    "substring": ("str", _substring),
    "format": ("str", _format),
    "timeFormat": ("str", _time_format),
    "utcFormat": ("str", _time_format),
    "regexp": ("re", _regexp),
    "test": ("bool", _test),
    "open": ("null", lambda c, a: F.lit(None)),
}


def column(text: str, context: Context) -> Value:
    """The Column of an expression's text."""
    return Compiler(context).compile(parse(text))


def condition(text: str, context: Context) -> Column:
    """An expression as a filter condition."""
    return Compiler(context).test(parse(text))
