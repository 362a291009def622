"""Text templates ``{{datum.field|filter:argument}}`` as one concatenation of Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dates import strftime
from millrace.functions.numbers import d3_format
from millrace.functions.text import truncate
from millrace.plans.expressions import Compiler, Context, Value
from millrace.plans.parsing import parse


def _filters(text: str) -> list[tuple[str, list]]:
    out = []
    for part in re.findall(r"\|\s*((?:'[^']*'|\"[^\"]*\"|[^|])*)", text):
        name, _, rest = part.strip().partition(":")
        args = [next(x for x in m.groups() if x is not None) for m in re.finditer(r"'([^']*)'|\"([^\"]*)\"|([^,'\"\s]+)", rest)]
        out.append((name.strip(), args))
    return out


def _filter(c: Compiler, v: Value, name: str, args: list) -> Value:
    s = lambda: c.string(v)
    n = [int(a) for a in args if re.fullmatch(r"-?\d+", a or "")]
    out: Column
    if name in ("upper", "lower", "trim"):
        out = {"upper": F.upper, "lower": F.lower, "trim": F.trim}[name](s())
    elif name == "length":
        return Value(F.length(s()).cast("double"), "num")
    elif name == "left":
        out = F.left(s(), F.lit(n[0]))
    elif name == "right":
        out = F.right(s(), F.lit(n[0]))
    elif name == "mid":
        out = F.substring(s(), n[0] + 1, n[1])
    elif name == "slice":
        size = F.length(s())
        end = F.lit(n[1]) if len(n) > 1 else size
        fix = lambda x: F.when(x < 0, F.greatest(size + x, F.lit(0))).otherwise(F.least(x, size))
        out = F.substring(s(), fix(F.lit(n[0])) + 1, F.greatest(fix(end) - fix(F.lit(n[0])), F.lit(0)))
    elif name == "pad":
        where = args[1] if len(args) > 1 else "right"
        gap = F.greatest(F.lit(n[0]) - F.length(s()), F.lit(0))
        half = F.floor(gap / 2).cast("int")
        out = {"left": F.concat(F.repeat(F.lit(" "), gap), s()), "right": F.concat(s(), F.repeat(F.lit(" "), gap)), "center": F.concat(F.repeat(F.lit(" "), half), s(), F.repeat(F.lit(" "), gap - half))}[{"middle": "center"}.get(where, where)]
    elif name == "truncate":
        where = args[1] if len(args) > 1 else "right"
        if where == "left":
            out = F.when(F.length(s()) <= n[0], s()).otherwise(F.concat(F.lit("…"), F.right(s(), F.lit(n[0] - 1))))
        elif where in ("center", "middle"):
            a = (n[0]) // 2
            out = F.when(F.length(s()) <= n[0], s()).otherwise(F.concat(F.left(s(), F.lit(a)), F.lit("…"), F.right(s(), F.lit(n[0] - 1 - a))))
        else:
            out = F.when(F.length(s()) <= n[0], s()).otherwise(truncate(s(), n[0] - 1))
    elif name == "number":
        out = d3_format(c.number(v), args[0])
    elif name in ("time", "time-utc"):
        out = strftime(c.time(v), args[0])
    elif name in ("quarter", "quarter-utc"):
        return Value(F.quarter(c.time(v)).cast("double"), "num")
    elif name.startswith(("month", "day")):
        abbreviated = "abbrev" in name
        code = ("MMM" if abbreviated else "MMMM") if name.startswith("month") else ("EEE" if abbreviated else "EEEE")
        if v.kind == "num" and name.startswith("month"):
            out = F.date_format(F.make_date(F.lit(2000), (v.column + 1).cast("int"), F.lit(1)), code)
        elif v.kind == "num":
            out = F.date_format(F.make_date(F.lit(2000), F.lit(10), (v.column + 1).cast("int")), code)
        else:
            out = F.date_format(c.time(v), code)
    else:
        raise ValueError(f"unknown filter {name!r}")
    return Value(out, "str")


def template(text: str, context: Context) -> Column:
    """The text with each tag replaced by its value; what is null is empty."""
    c = Compiler(context)
    parts, at = [], 0
    for m in re.finditer(r"\{\{((?:'[^']*'|\"[^\"]*\"|(?!\}\}).)*)\}\}", text):
        parts.append(F.lit(text[at : m.start()]))
        head, bar, rest = m[1].partition("|")
        v = c.compile(parse(head.strip()))
        for name, args in _filters(bar + rest) if bar else []:
            v = _filter(c, v, name, args)
        parts.append(F.coalesce(c.string(v), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
