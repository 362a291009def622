"""Number formats as Columns: the D3 mini-language, SI prefixes, grouped digits."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(r"^(?:(.)?([<>=^]))?([+\- (])?([$#])?(0)?(\d+)?(,)?(?:\.(-?\d+))?([a-zA-Z%])?$")
#: SI prefixes from 1e-24 to 1e24.
SI = ["y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y"]


@dataclass(frozen=True)
class Format:
    fill: str = " "
    align: str = ">"
    sign: str = "-"
    symbol: str = ""
    zero: bool = False
    width: int = 0
    comma: bool = False
    precision: int | None = None
    type: str = ""


def parse_format(text: str) -> Format:
    m = _SPEC.match(text)
    if not m:
        raise ValueError(f"bad number format {text!r}")
    fill, align, sign, symbol, zero, width, comma, precision, kind = m.groups()
    kind = kind or ""
    zero = bool(zero) or (fill == "0" and align == "=")
    if kind == "n":
        comma, kind = ",", "g"
    return Format(fill or ("0" if zero else " "), align or ("=" if zero else ">"), sign or "-", symbol or "", zero, int(width or 0), bool(comma), None if precision is None else int(precision), kind)


def grouped(digits: Column) -> Column:
    """Commas between thousands of the digits before a point."""
    whole = F.regexp_extract(digits, r"^\d*", 0)
    return F.concat(F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,"), F.substring(digits, F.length(whole) + 1, F.lit(1 << 20)))


def fixed(x: Column, precision: int | Column) -> Column:
    """A fixed number of decimals, ties away from zero."""
    if isinstance(precision, int):
        return F.format_string(f"%.{max(0, precision)}f", x)
    return F.call_function("format_string", F.concat(F.lit("%."), F.greatest(precision, F.lit(0)).cast("string"), F.lit("f")), x)


def exponent(x: Column) -> Column:
    """The decimal exponent after rounding errors are out of the way; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.regexp_extract(F.format_string("%.15e", F.abs(x)), r"e([+-]\d+)$", 1).cast("int"))


def _mantissa(x: Column, digits: int) -> tuple[Column, Column]:
    """x rounded to significant digits, and its exponent."""
    text = F.format_string(f"%.{max(0, digits - 1)}e", x)
    return text.cast("double"), F.when(x == 0, F.lit(0)).otherwise(F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int"))


def _science(x: Column, decimals: int) -> Column:
    return F.regexp_replace(F.format_string(f"%.{max(0, decimals)}e", x), r"e([+-])0(\d)$", "e$1$2")


def _significant(x: Column, digits: int) -> Column:
    rounded, e = _mantissa(x, digits)
    return fixed(rounded, F.lit(digits - 1) - e)


def _body(x: Column, f: Format) -> Column:
    """The digits of |x|, without sign, symbol and padding."""
    from millrace.plans.expressions import number_text

    p = f.precision
    kind = f.type
    if kind == "d":
        return F.when(x == F.floor(x), fixed(x, 0)).otherwise(F.lit(""))
    if kind == "f":
        return fixed(x, 6 if p is None else p)
    if kind == "%":
        return F.concat(fixed(x * 100, 0 if p is None else p), F.lit("%"))
    if kind == "p":
        return F.concat(_significant(x * 100, max(1, p or 1)), F.lit("%"))
    if kind == "e":
        return _science(x, 6 if p is None else p)
    if kind == "r":
        return _significant(x, max(1, 6 if p is None else p))
    if kind == "g":
        if p is None:
            return number_text(x)
        digits = max(1, p)
        _, e = _mantissa(x, digits)
        return F.when((e < -6) | (e >= digits), _science(x, digits - 1)).otherwise(_significant(x, digits))
    if kind == "s":
        digits = p if p is not None else None
        rounded, e = _mantissa(x, digits) if digits else (x, exponent(x))
        step = F.least(F.greatest(F.floor(e / 3), F.lit(-8)), F.lit(8)).cast("int")
        scaled = rounded / F.pow(F.lit(10.0), step * 3)
        text = number_text(F.round(scaled, 12)) if digits is None else fixed(scaled, F.greatest(F.lit(0), F.lit(digits - 1) - (e - step * 3)))
        return F.concat(text, F.element_at(F.array(*map(F.lit, SI)), step + 9))
    if kind in ("x", "X", "o", "b"):
        n = F.round(x).cast("long")
        text = {"x": F.lower(F.hex(n)), "X": F.hex(n), "o": F.conv(n.cast("string"), 10, 8), "b": F.bin(n)}[kind]
        return F.concat(F.lit({"x": "0x", "X": "0x", "o": "0o", "b": "0b"}[kind] if f.symbol == "#" else ""), text)
    if kind == "c":
        return F.char(x.cast("int"))
    if kind == "":
        return number_text(x) if p is None else _plain(x, max(1, p))
    raise ValueError(f"unknown number type {kind!r}")


def _plain(x: Column, digits: int) -> Column:
    """Like g, without trailing zeros."""
    text = _body(x, Format(type="g", precision=digits))
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+($|e)", "$1")).otherwise(text)


def d3_format(x: Column, spec: str) -> Column:
    """A number in the format of the D3 mini-language."""
    f = parse_format(spec)
    if f.type == "c":
        return _body(x, f)
    body = _body(F.abs(x), f)
    if f.comma:
        body = grouped(body)
    # What rounds to zero is not negative.
    negative = (x < 0) & body.rlike("[1-9a-zA-Z]")
    money = F.lit("$" if f.symbol == "$" else "")
    minus = {"(": "(", "-": "-", "+": "-", " ": "-"}[f.sign]
    plus = {"+": "+", " ": " "}.get(f.sign, "")
    head = F.concat(F.when(negative, F.lit(minus)).otherwise(F.lit(plus)), money)
    tail = F.when(negative, F.lit(")")).otherwise(F.lit("")) if f.sign == "(" else F.lit("")
    if f.width:
        if f.zero and f.comma:
            # Zeros are grouped too: pad, group, cut to the width.
            room = F.greatest(F.lit(f.width) - F.length(head) - F.length(tail), F.length(body))
            body = F.right(grouped(F.lpad(F.replace(body, F.lit(","), F.lit("")), f.width, "0")), room)
            body = F.regexp_replace(body, "^,", "0")
        gap = F.repeat(F.lit(f.fill), F.greatest(F.lit(f.width) - F.length(head) - F.length(body) - F.length(tail), F.lit(0)))
        half = F.greatest(F.lit(f.width) - F.length(head) - F.length(body) - F.length(tail), F.lit(0))
        if f.align == "<":
            out = F.concat(head, body, tail, gap)
        elif f.align == "=":
            out = F.concat(head, gap, body, tail)
        elif f.align == "^":
            left = F.floor(half / 2).cast("int")
            out = F.concat(F.repeat(F.lit(f.fill), left), head, body, tail, F.repeat(F.lit(f.fill), half - left))
        else:
            out = F.concat(gap, head, body, tail)
    else:
        out = F.concat(head, body, tail)
    return F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == math.inf, F.concat(head, F.lit("Infinity"), tail)).otherwise(out)


def auto_format(lo: float, hi: float, count: int = 10) -> str:
    """The format that tells apart ticks of an extent."""
    from millrace.operators.ticks import tick_step

    step = abs(tick_step(lo, hi, count)) if hi > lo else 1.0
    return f",.{max(0, -math.floor(math.log10(step) + 1e-9))}f"


def floatval(text: Column) -> Column:
    """The number that a text starts with; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^[ \t\n\r\x0B\f]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def intval(text: Column) -> Column:
    """floatval, truncated."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^[ \t\n\r\x0B\f]*([+-]?\d+)", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def loosely_equal(a: Column, b: Column) -> Column:
    """Texts that are both numbers compare as such, others as text."""
    number = r"^[ \t]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t]*$"
    both = a.rlike(number) & b.rlike(number)
    return F.when(both, F.trim(a).try_cast("double") == F.trim(b).try_cast("double")).otherwise(a == b)


def php_number(x: Column) -> Column:
    """A number as text with up to 14 significant digits and no needless zeros."""
    return F.when(F.isnan(x), F.lit("NAN")).when(F.abs(x) == math.inf, F.when(x > 0, "INF").otherwise("-INF")).otherwise(F.concat(F.when((x < 0), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(F.regexp_replace(_plain(F.abs(x), 14), r"^(\d)e", "$1.0e"), r"e([+-])", "E$1")))


def formatnum(text: Column, mode: str = "") -> Column:
    """Groups thousands; R takes the groups out again, NOSEP leaves them out, LOSSLESS keeps all digits."""
    if mode.upper() == "R":
        return F.replace(text, F.lit(","), F.lit(""))
    if mode.upper() == "NOSEP":
        return text
    sign = F.regexp_extract(text, "^[+-]?", 0)
    body = F.substring(text, F.length(sign) + 1, F.lit(1 << 20))
    return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(sign, grouped(body))).otherwise(text)


def plural(n: Column, one: Column, many: Column) -> Column:
    return F.when(F.abs(n) == 1, one).otherwise(many)
