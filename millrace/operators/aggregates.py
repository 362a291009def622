"""Aggregate operators over groups, with the documented meaning of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = "__ord"

NAMES = ("count", "valid", "missing", "distinct", "sum", "mean", "average", "min", "max", "median", "q1", "q3", "variance", "variancep", "stdev", "stdevp", "modeskew", "argmin", "argmax", "values")


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != ORDER])


def _clean(df: DataFrame, field: str) -> Column:
    """The field as a number, NaN as null."""
    c = F.col(field)
    t = df.select(c).schema[0].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(t, T.NumericType):
        return c.cast("double")
    if isinstance(t, (T.TimestampType, T.DateType)):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return c.try_cast("double")


def _ordered(df: DataFrame, value: Column) -> Column:
    """All values of a group, in row order where there is one."""
    if ORDER in df.columns:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.collect_list(value)


def aggregate_column(df: DataFrame, op: str, field: str) -> Column:
    """One operator over one field ('*' for whole rows)."""
    if op not in NAMES:
        raise ValueError(f"unknown aggregate {op!r}")
    if op == "count":
        return F.count(F.lit(1))
    if op == "values":
        return _ordered(df, _row(df) if field == "*" else F.col(field))
    c = F.col(field) if field != "*" else F.lit(None).cast("double")
    x = _clean(df, field) if field != "*" else c
    tie = [F.col(ORDER)] if ORDER in df.columns else []
    spread = lambda f: F.coalesce(f(x), F.lit(0.0))  # noqa: E731  one value or none: 0
    return {
        "valid": lambda: F.count(x if _numeric(df, field) else c),
        "missing": lambda: F.count_if(c.isNull()),
        "distinct": lambda: F.count_distinct(c) + F.max(c.isNull().cast("int")),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "mean": lambda: F.avg(x),
        "average": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "median": lambda: F.coalesce(F.percentile(x, F.lit(0.5)), F.lit(0.0)),
        "q1": lambda: F.coalesce(F.percentile(x, F.lit(0.25)), F.lit(0.0)),
        "q3": lambda: F.coalesce(F.percentile(x, F.lit(0.75)), F.lit(0.0)),
        "variance": lambda: spread(F.var_samp),
        "variancep": lambda: spread(F.var_pop),
        "stdev": lambda: spread(F.stddev_samp),
        "stdevp": lambda: spread(F.stddev_pop),
        "modeskew": lambda: F.coalesce(F.try_divide(F.avg(x) - F.percentile(x, F.lit(0.5)), F.stddev_samp(x)), F.lit(0.0)),
        "argmin": lambda: F.min_by(_row(df), F.when(x.isNotNull(), F.struct(x.alias("x"), *tie))),
        "argmax": lambda: F.max_by(_row(df), F.when(x.isNotNull(), F.struct(x.alias("x"), *[-t for t in tie]))),
    }[op]()


def _numeric(df: DataFrame, field: str) -> bool:
    return isinstance(df.select(F.col(field)).schema[0].dataType, T.NumericType)


def summaries(spec: dict | list | None) -> list[tuple[str, str, str]]:
    """(op, field, name) of the short map or the long list form; the default is the values of whole rows."""
    out = []
    if not spec:
        return [("values", "*", "values")]
    for field, ops, names in [(f, o, None) for f, o in spec.items()] if isinstance(spec, dict) else [(s.get("field", "*"), s.get("ops", []), s.get("as")) for s in spec]:
        ops = [ops] if isinstance(ops, str) else list(ops)
        names = [names] if isinstance(names, str) else list(names or [])
        for i, op in enumerate(ops):
            out.append((op, field, names[i] if i < len(names) else op if field == "*" else f"{op}_{field.replace('.', '_')}"))
    return out


def aggregate(df: DataFrame, groupby: list[str] | None = None, summarize: dict | list | None = None) -> DataFrame:
    """Groups by fields (a missing key is the null group) and summarises; partial sums go before the shuffle."""
    keys = [F.col(g).alias(g.rsplit(".", 1)[-1]) for g in groupby or []]
    out = [aggregate_column(df, op, field).alias(name) for op, field, name in summaries(summarize)]
    if ORDER in df.columns:
        out.append(F.min(ORDER).alias(ORDER))  # groups keep the order in which they are first seen
    return df.groupBy(*keys).agg(*out)
