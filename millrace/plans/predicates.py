"""The predicate language: named definitions over arguments, and rule chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.expressions import Compiler, Context, Value, value_of

_COMPARE = ("==", "!=", ">", ">=", "<", "<=")


class Predicates:
    """Definitions by name; ``datasets`` are what ``in`` may refer to."""

    def __init__(self, definitions: Sequence[Mapping], datasets: Mapping[str, DataFrame] | None = None, compat: bool = False) -> None:
        self.by_name = {d["name"]: d for d in definitions}
        self.datasets, self.compat = dict(datasets or {}), compat

    def _operand(self, df: DataFrame, x, arguments: Mapping, c: Compiler) -> Value:
        if isinstance(x, Mapping):
            if "predicate" in x:
                found = self._test(df, x["predicate"], {**arguments, **x.get("input", {})}, c)
                return Value(found, "bool")
            if "arg" in x:
                return self._operand(df, arguments.get(x["arg"]), {}, c) if not isinstance(arguments.get(x["arg"]), str) else value_of(F.col(arguments[x["arg"]]), df.select(arguments[x["arg"]]).schema[0].dataType)
            if "value" in x:
                return self._operand(df, x["value"], {}, c)
        if isinstance(x, bool):
            return c._bool(x)
        if x is None:
            return c._null()
        return c._num(float(x)) if isinstance(x, (int, float)) else c._str(str(x))

    def _test(self, df: DataFrame, name: str, arguments: Mapping, c: Compiler) -> Column:
        d = self.by_name[name]
        kind = d["type"]
        if kind in ("&&", "and", "||", "or"):
            tests = [c.truthy(self._operand(df, o, arguments, c)) for o in d["operands"]]
            out = tests[0]
            for x in tests[1:]:
                out = (out & x) if kind in ("&&", "and") else (out | x)
            return out
        if kind in _COMPARE:
            a, b = (self._operand(df, o, arguments, c) for o in d["operands"])
            if kind in ("==", "!="):
                same = c.equal(a, b)
                return ~same if kind == "!=" else same
            text = a.kind == b.kind == "str"
            x, y = (a.column, b.column) if text else (c.number(a), c.number(b))
            return F.coalesce({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[kind], F.lit(False))
        if kind == "in" and "range" in d:
            x = c.number(self._operand(df, d["item"], arguments, c))
            lo, hi = (c.number(self._operand(df, o, arguments, c)) for o in d["range"])
            return F.coalesce(x.between(F.least(lo, hi), F.greatest(lo, hi)), F.lit(False))
        if kind == "in":
            return F.col(self._flag(name))
        raise ValueError(f"unknown predicate type {kind!r}")

    @staticmethod
    def _flag(name: str) -> str:
        return f"__in_{name}"

    def _members(self, df: DataFrame, name: str, arguments: Mapping, seen: dict[str, Mapping]) -> None:
        d = self.by_name[name]
        if d["type"] == "in" and "data" in d:
            seen[name] = arguments
        for o in d.get("operands", []):
            if isinstance(o, Mapping) and "predicate" in o:
                self._members(df, o["predicate"], {**arguments, **o.get("input", {})}, seen)

    def flagged(self, df: DataFrame, name: str, arguments: Mapping | None = None) -> tuple[DataFrame, Column]:
        """``df`` with a flag for each dataset the predicate looks into, and the predicate as a Column."""
        arguments = arguments or {}
        seen: dict[str, Mapping] = {}
        self._members(df, name, arguments, seen)
        for n, args in seen.items():
            d = self.by_name[n]
            item = args[d["item"]["arg"]]
            keys = self.datasets[d["data"]].select(F.col(d["field"]).alias(f"__k_{n}")).filter(F.col(f"__k_{n}").isNotNull()).distinct()
            df = df.join(keys, F.col(item) == F.col(f"__k_{n}"), "left").withColumn(self._flag(n), F.col(f"__k_{n}").isNotNull()).drop(f"__k_{n}")
        return df, self._test(df, name, arguments, Compiler(Context(df.schema, self.compat)))

    def keep(self, df: DataFrame, name: str, arguments: Mapping | None = None) -> DataFrame:
        """The rows that satisfy a predicate; a sole ``in`` over a dataset is a left semi join."""
        d = self.by_name[name]
        if d["type"] == "in" and "data" in d:
            item = (arguments or {})[d["item"]["arg"]]
            keys = self.datasets[d["data"]].select(F.col(d["field"]).alias("__k"))
            return df.join(keys, F.col(item) == F.col("__k"), "left_semi")
        rows, test = self.flagged(df, name, arguments)
        return rows.filter(test).select(*[F.col(f"`{c}`") for c in df.columns])

    def rules(self, df: DataFrame, chain: Sequence[Mapping]) -> tuple[DataFrame, Column]:
        """The value of the first rule {predicate, input, value} that holds; one without predicate is the default."""
        out, default, tests = None, F.lit(None), []
        for r in chain:
            if "predicate" not in r:
                default = F.lit(r["value"])
                break
            df, test = self.flagged(df, r["predicate"], r.get("input"))
            tests.append((test, F.lit(r["value"])))
        for test, value in tests:
            out = F.when(test, value) if out is None else out.when(test, value)
        return df, default if out is None else out.otherwise(default)
