"""Infix expressions: a literal text becomes a Column; a column of texts is evaluated in Arrow batches."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STACK = 100
#: Precedence of operators; unary ones and constants apart.
PRECEDENCE = {"e": 10, "^": 8, "*": 7, "/": 7, "div": 7, "mod": 7, "fmod": 7, "+": 6, "-": 6, "round": 5, "=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<>": 4, "!=": 4, "and": 3, "or": 2}
UNARY = {"neg": 10, "pos": 10, "not": 9, "sin": 9, "cos": 9, "tan": 9, "asin": 9, "acos": 9, "atan": 9, "exp": 9, "ln": 9, "abs": 9, "floor": 9, "trunc": 9, "ceil": 9, "sqrt": 9}
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*|\.\d+)|(?P<op><=|>=|<>|!=|[-+*/^=<>()−])|(?P<word>[A-Za-z]+))")


class InfixError(ValueError):
    pass


def to_postfix(text: str) -> list:
    """Numbers, constants and operators in postfix order; unary operators are (name,)."""
    text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&minus;", "-").replace("−", "-")
    out: list = []
    ops: list = []
    want_value, i = True, 0
    text = text.strip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m or m.end() == i:
            raise InfixError(f"unrecognised character {text[i]!r}")
        i = m.end()
        if m["num"]:
            if not want_value:
                raise InfixError("unexpected number")
            out.append(float(m["num"]))
            want_value = False
        elif m["op"] == "(":
            if not want_value:
                raise InfixError("unexpected (")
            ops.append("(")
        elif m["op"] == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise InfixError("unexpected )")
            ops.pop()
            want_value = False
        else:
            word = (m["op"] or m["word"]).lower()
            if want_value:
                if word in ("+", "-"):
                    ops.append(("neg" if word == "-" else "pos",))
                elif word in ("pi", "e"):
                    out.append(math.pi if word == "pi" else math.e)
                    want_value = False
                elif word in UNARY:
                    ops.append((word,))
                else:
                    raise InfixError(f"unexpected operator {word}")
            else:
                if word in UNARY or word == "pi":
                    raise InfixError(f"unexpected {word}")
                if word not in PRECEDENCE:
                    raise InfixError(f"unrecognised word {word}")
                p = PRECEDENCE[word]
                while ops and ops[-1] != "(" and (UNARY[ops[-1][0]] if isinstance(ops[-1], tuple) else PRECEDENCE[ops[-1]]) >= p:
                    out.append(ops.pop())
                ops.append(word)
                want_value = True
        if len(out) + len(ops) > STACK:
            raise InfixError("stack exhausted")
    while ops:
        x = ops.pop()
        if x == "(":
            raise InfixError("unclosed bracket")
        out.append(x)
    return out


def _round(x: float, digits: float) -> float:
    d = max(0, int(digits))
    scale = 10.0**d
    return math.copysign(math.floor(abs(x) * scale + 0.5), x) / scale if math.isfinite(x * scale) else x


def _apply(op: str, a: float, b: float) -> float:
    if op == "/" or op == "div":
        if b == 0:
            raise InfixError("division by zero")
        return a / b
    if op == "mod":
        x, y = int(a), int(b)
        if y == 0:
            raise InfixError("division by zero")
        return float(math.copysign(abs(x) % abs(y), x)) if x else 0.0
    if op == "fmod":
        if b == 0:
            raise InfixError("division by zero")
        return a - abs(b) * math.floor(a / abs(b))
    if op == "^":
        out = a**b
        if isinstance(out, complex):
            raise InfixError("not a number")
        return out
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "e": lambda: a * 10.0**b, "round": lambda: _round(a, b), "=": lambda: float(a == b), "<>": lambda: float(a != b), "!=": lambda: float(a != b), "<": lambda: float(a < b), ">": lambda: float(a > b), "<=": lambda: float(a <= b), ">=": lambda: float(a >= b), "and": lambda: float(bool(a) and bool(b)), "or": lambda: float(bool(a) or bool(b))}[op]()


def _unary(op: str, a: float) -> float:
    if op in ("asin", "acos") and not -1 <= a <= 1 or op == "ln" and a <= 0 or op == "sqrt" and a < 0:
        raise InfixError(f"invalid argument for {op}")
    return {"neg": lambda: -a, "pos": lambda: a, "not": lambda: float(not a), "sin": lambda: math.sin(a), "cos": lambda: math.cos(a), "tan": lambda: math.tan(a), "asin": lambda: math.asin(a), "acos": lambda: math.acos(a), "atan": lambda: math.atan(a), "exp": lambda: math.exp(a), "ln": lambda: math.log(a), "abs": lambda: abs(a), "floor": lambda: float(math.floor(a)), "ceil": lambda: float(math.ceil(a)), "trunc": lambda: float(math.trunc(a)), "sqrt": lambda: math.sqrt(a)}[op]()


def evaluate(text: str) -> float | None:
    """The value of a text, None if it is empty."""
    postfix = to_postfix(text)
    if not postfix:
        return None
    stack: list[float] = []
    for x in postfix:
        try:
            if isinstance(x, float):
                stack.append(x)
            elif isinstance(x, tuple):
                stack.append(_unary(x[0], stack.pop()))
            else:
                b, a = stack.pop(), stack.pop()
                stack.append(_apply(x, a, b))
        except IndexError:
            raise InfixError("missing operand") from None
        except (OverflowError, ZeroDivisionError):
            raise InfixError("not a number") from None
    if len(stack) != 1:
        raise InfixError("missing operator")
    return stack[0]


def compiled(text: str, **columns: Column) -> Column:
    """A literal expression as a Column; names of ``columns`` may stand where numbers may.

    What the interpreter calls an error is null."""
    names: dict[float, Column] = {}
    for i, (name, c) in enumerate(columns.items()):
        # A number that no text would hold marks the place of a column.
        mark = float(f"9{i:03}71828182845.25")
        text = re.sub(rf"\b{re.escape(name)}\b", repr(mark), text)
        names[mark] = c.cast("double")
    stack: list[Column] = []
    number = lambda b: b.cast("double")
    for x in to_postfix(text):
        if isinstance(x, float):
            stack.append(names.get(x, F.lit(x)))
        elif isinstance(x, tuple):
            a = stack.pop()
            stack.append({"neg": lambda: -a, "pos": lambda: a, "not": lambda: number(a == 0), "sin": lambda: F.sin(a), "cos": lambda: F.cos(a), "tan": lambda: F.tan(a), "asin": lambda: F.when(F.abs(a) <= 1, F.asin(a)), "acos": lambda: F.when(F.abs(a) <= 1, F.acos(a)), "atan": lambda: F.atan(a), "exp": lambda: F.exp(a), "ln": lambda: F.when(a > 0, F.log(a)), "abs": lambda: F.abs(a), "floor": lambda: number(F.floor(a)), "ceil": lambda: number(F.ceil(a)), "trunc": lambda: F.signum(a) * F.floor(F.abs(a)), "sqrt": lambda: F.when(a >= 0, F.sqrt(a))}[x[0]]())
        else:
            b, a = stack.pop(), stack.pop()
            whole = lambda c: F.signum(c) * F.floor(F.abs(c))
            stack.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "div": lambda: F.try_divide(a, b), "mod": lambda: F.when(whole(b) != 0, F.try_mod(whole(a), whole(b))), "fmod": lambda: F.when(b != 0, a - F.abs(b) * F.floor(a / F.abs(b))), "^": lambda: F.pow(a, b), "e": lambda: a * F.pow(F.lit(10.0), b), "round": lambda: F.signum(a) * F.floor(F.abs(a) * F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(b))) + 0.5) / F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(b))), "=": lambda: number(a == b), "<>": lambda: number(a != b), "!=": lambda: number(a != b), "<": lambda: number(a < b), ">": lambda: number(a > b), "<=": lambda: number(a <= b), ">=": lambda: number(a >= b), "and": lambda: number((a != 0) & (b != 0)), "or": lambda: number((a != 0) | (b != 0))}[x]())
    if len(stack) != 1:
        raise InfixError("missing operator")
    return stack[0]


def column(texts: Column) -> Column:
    """struct<value, error> of a column of expression texts."""
    @F.pandas_udf("value double, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        values, errors, known = [], [], {}
        for t in s:
            if t not in known:
                try:
                    known[t] = (None if t is None else evaluate(t), None)
                except InfixError as e:
                    known[t] = (None, str(e))
            values.append(known[t][0])
            errors.append(known[t][1])
        return pd.DataFrame({"value": pd.Series(values, dtype="float64"), "error": errors})

    return run(texts)
