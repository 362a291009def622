"""The relational transforms of dataset pipelines."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.aggregates import ORDER, aggregate_column, summaries
from millrace.plans.expressions import Context, condition
from millrace.plans.expressions import column as expression
from millrace.scratch import written

#: Cross products and lookups broadcast a side of at most so many rows, counted first.
BROADCAST_ROWS = 200_000
#: Up to so many groups running sums are made in two levels, as each may be large.
FEW_GROUPS = 1000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if the counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_order(df: DataFrame, *by: str | Column, start: int = 0) -> DataFrame:
    """Adds the row order as a dense number from ``start``.

    Rows are range-partitioned by the keys; each range numbers its own rows and adds the sizes of the
    ranges before, so no task sees more than a range."""
    return _prefix(df, [F.col(b) if isinstance(b, str) else b for b in by], {ORDER: F.lit(1)}, start=start)


def _prefix(df: DataFrame, order: list[Column], sums: dict[str, Column], start: float = 0, by: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sums over an order, by few groups or over all rows, in two levels: within ranges, then across them.

    Ranges are cut by groups and order together, ties by a hash of the row, so that a group of any size spreads over many
    tasks. The ranged rows are written once with the number of their range: range bounds are sampled and partitions
    merged at run time, so planning them twice would number them differently. Sums by range and group, which are
    broadcast, have a row a range, and one more where a group begins within a range."""
    named = df.select("*", *[c.alias(f"__s_{n}") for n, c in sums.items()])
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    named = named.withColumns({f"__o_{i}": F.col(g) for i, g in enumerate(by)} | {"__tie": tie})
    keys = [*[F.col(g).asc_nulls_first() for g in by], *order, F.col("__tie").asc()]
    ranged = written(named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    own = [f"__o_{i}" for i in range(len(by))]
    within = W.partitionBy("__part", *own).orderBy(*order, F.col("__tie").asc()).rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumns({f"__w_{n}": F.coalesce(F.sum(f"__s_{n}").over(within), F.lit(0)) for n in sums})
    totals = ranged.groupBy("__part", *own).agg(*[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    before = (W.partitionBy(*own) if by else W).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("__part").alias("__p"), *[F.col(o).alias(f"__g{o}") for o in own], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    on = F.col("__part") == F.col("__p")
    for o in own:
        on = on & F.col(o).eqNullSafe(F.col(f"__g{o}"))
    rows = rows.join(F.broadcast(totals), on)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[(F.col(f"__w_{n}") + F.col(f"__b_{n}") + start).alias(n) for n in sums])


def ordering(df: DataFrame, by: str | Sequence[str] | None) -> list[Column]:
    """Sort keys ('-f' is descending, '+f' allowed), ties by row order."""
    out = []
    for k in [by] if isinstance(by, str) else by or []:
        out.append(F.col(k[1:]).desc_nulls_last() if k[0] == "-" else F.col(k.lstrip("+")).asc_nulls_first())
    return out + ([F.col(ORDER).asc()] if ORDER in df.columns else [])


def context(df: DataFrame, compat: bool = False) -> Context:
    return Context(df.schema, compat)


def filter_(df: DataFrame, test: str, compat: bool = False) -> DataFrame:
    """Rows whose expression is truthy."""
    return df.filter(condition(test, context(df, compat)))


def formula(df: DataFrame, field: str, expr: str, compat: bool = False) -> DataFrame:
    """Adds or overwrites a field."""
    return df.withColumn(field, expression(expr, context(df, compat)).column)


def formulas(df: DataFrame, exprs: dict[str, str], compat: bool = False) -> DataFrame:
    """Several formulas that don't read each other's fields, in one projection."""
    return df.withColumns({f: expression(e, context(df, compat)).column for f, e in exprs.items()})


def facet(df: DataFrame, groupby: list[str], summarize: dict | list | None = None, transform: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """A row a group: its keys, ``key`` (keys joined by '|'), ``values`` (its rows, in order) and summaries.

    ``transform`` gets the flat rows and the keys by which its windows must partition."""
    flat = transform(df, groupby) if transform else df
    own = [(op, f, n) for op, f, n in summaries(summarize) if n != "values"] if summarize else []
    row = F.struct(*[F.col(f"`{c}`") for c in flat.columns if c != ORDER])
    held = F.struct(F.col(ORDER).alias("o"), row.alias("v")) if ORDER in flat.columns else F.struct(row.alias("v"))
    values = F.transform(F.array_sort(F.collect_list(held)) if ORDER in flat.columns else F.collect_list(held), lambda x: x["v"])
    order = [F.min(ORDER).alias(ORDER)] if ORDER in flat.columns else []
    out = flat.groupBy(*groupby).agg(values.alias("values"), *[aggregate_column(flat, op, f).alias(n) for op, f, n in own], *order)
    return out.withColumn("key", F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("null")) for g in groupby]))


def bin_options(lo: float, hi: float, base: float = 10, div: Sequence[float] = (5, 2), maxbins: int = 20, minstep: float = 0, step: float | None = None, steps: Sequence[float] = ()) -> tuple[float, float]:
    """(start, step) of the bins over an extent."""
    base, maxbins = base or 10, maxbins or 15
    span = hi - lo
    if step:
        pass
    elif steps:
        want = span / maxbins
        step = next((s for s in steps if s >= want), steps[-1])
    elif span <= 0:
        step = minstep or 1.0
    else:
        logb = math.log(base)
        level = math.ceil(math.log(maxbins) / logb)
        step = max(minstep, base ** (round(math.log(span) / logb) - level))
        while math.ceil(span / step) > maxbins:
            step *= base
        for v in div:
            if step / v >= minstep and span / (step / v) <= maxbins:
                step /= v
    precision = 0 if step >= 1 else int(-math.log(step) / math.log(base)) + 1
    eps = base ** (-precision - 1)
    return min(lo, math.floor(lo / step + eps) * step), step


def bin_(df: DataFrame, field: str, min: float | None = None, max: float | None = None, output: dict[str, str] | None = None, **options) -> DataFrame:
    """Adds bin_start, bin_mid, bin_end; a missing value gets none. One pass finds the extent if it isn't given."""
    names = {k: (output or {}).get(k, k) for k in ("bin_start", "bin_mid", "bin_end")}
    x = F.col(field).cast("double")
    lo, hi = min, max
    if lo is None or hi is None:
        found = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo, hi = found.lo if lo is None else lo, found.hi if hi is None else hi
    if lo is None or hi is None:
        return df.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    start, step = bin_options(lo, hi, **options)
    at = F.lit(start) + F.lit(step) * F.floor((x - start) / step)
    return df.withColumns({names["bin_start"]: at, names["bin_mid"]: at + step / 2, names["bin_end"]: at + step})


def countpattern(df: DataFrame, field: str = "data", pattern: str = r"[\w']+", case: str = "lower", stopwords: str = "", output: dict[str, str] | None = None) -> DataFrame:
    """Counts of a pattern's matches over all rows; the pattern's classes are Unicode's."""
    text = {"lower": F.lower, "upper": F.upper}.get(case, lambda c: c)(F.col(field).cast("string"))
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))).alias("text"))
    words = words.filter(F.col("text") != "")
    if stopwords:
        words = words.filter(~F.col("text").rlike(f"(?iU)^(?:{stopwords})$"))
    names = {k: (output or {}).get(k, k) for k in ("text", "count")}
    return words.groupBy("text").agg(F.count(F.lit(1)).alias(names["count"])).withColumnRenamed("text", names["text"])


def cross(df: DataFrame, other: DataFrame | None = None, diagonal: bool = True, test: str | None = None, output: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """Pairs of rows {a, b}. An equality in the test becomes a hash join; pairs are made only if it has none."""
    names = {k: (output or {}).get(k, k) for k in ("left", "right")} if output else {"left": "a", "right": "b"}
    left, right = df, df if other is None else other
    pack = lambda d, n: d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias(n))
    pairs = pack(left, names["left"]).crossJoin(small(pack(right, names["right"])))
    if other is None and not diagonal:
        pairs = pairs.filter(F.col(f"{names['left']}.{ORDER}") != F.col(f"{names['right']}.{ORDER}"))
    if test:
        pairs = pairs.filter(condition(test, Context(pairs.schema, compat)))
    return pairs


def lookup(df: DataFrame, on: DataFrame, keys: list[str], as_: list[str], on_key: str | None = None, default: Column | None = None) -> DataFrame:
    """For each key the whole matching row of ``on`` as a struct: the last of equal keys; nulls never match.

    Without ``on_key`` a key is the 0-based row number of ``on``, which then needs its order column."""
    row = F.struct(*[F.col(f"`{c}`") for c in on.columns if c != ORDER])
    if on_key is None:
        right = on.select(F.col(ORDER).cast("long").alias("__k"), row.alias("__row"))
    else:
        own = on.filter(F.col(on_key).isNotNull())
        last = F.max_by(row, F.col(ORDER)) if ORDER in on.columns else F.last(row)
        right = own.groupBy(F.col(on_key).alias("__k")).agg(last.alias("__row"))
    right = small(right)
    for key, name in zip(keys, as_, strict=True):
        k = F.col(key) if on_key is not None else F.col(key).cast("double").cast("long")
        found = right.select(F.col("__k").alias(f"__k_{name}"), F.col("__row").alias(f"__r_{name}"))
        df = df.join(found, k == F.col(f"__k_{name}"), "left").drop(f"__k_{name}")
        value = F.col(f"__r_{name}")
        df = df.withColumn(name, F.coalesce(value, default) if default is not None else value).drop(f"__r_{name}")
    return df


def stack(df: DataFrame, field: str, groupby: list[str] | None = None, sortby: str | list[str] | None = None, offset: str = "zero", output: dict[str, str] | None = None) -> DataFrame:
    """Running sums within groups: layout_start, layout_mid, layout_end. ``offset``: zero, center or normalize."""
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("start", "mid", "end")}
    order = ordering(df, sortby) or [F.lit(0)]
    v = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
    groupby = groupby or []
    if not groupby or df.select(*groupby).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        # Few groups may be of any size, so no group may meet in one task.
        totals = df.groupBy(*groupby).agg(F.sum(v).alias("__total"))
        totals = totals.withColumn("__most", F.max("__total").over(W.partitionBy(F.lit(0))))  # a row a group, FEW_GROUPS at most
        for i, g in enumerate(groupby):
            totals = totals.withColumnRenamed(g, f"__h{i}")
        on = F.lit(True)
        for i, g in enumerate(groupby):
            on = on & F.col(g).eqNullSafe(F.col(f"__h{i}"))
        rows = _prefix(df.withColumn("__v", v), order, {"__start": v}, by=groupby).join(F.broadcast(totals), on)
        scale = F.coalesce(F.try_divide(F.lit(1.0), F.col("__total")), F.lit(0.0)) if offset == "normalize" else F.lit(1.0)
        shift = (F.col("__most") - F.col("__total")) / 2 if offset == "center" else F.lit(0.0)
        a, b = F.col("__start") * scale + shift, (F.col("__start") + F.col("__v")) * scale + shift
        return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in names.values()], a.alias(names["start"]), ((a + b) / 2).alias(names["mid"]), b.alias(names["end"]))
    part = W.partitionBy(*groupby)
    end = F.sum(v).over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    start = F.coalesce(F.sum(v).over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    if offset == "normalize":
        total = F.sum(v).over(part)
        start, end = (F.coalesce(F.try_divide(x, total), F.lit(0.0)) for x in (start, end))
    elif offset == "center":
        most = df.groupBy(*groupby).agg(F.sum(v).alias("s")).agg(F.max("s").alias("__most"))
        df = df.crossJoin(F.broadcast(most))  # one row
        shift = (F.col("__most") - F.sum(v).over(part)) / 2
        start, end = start + shift, end + shift
    out = df.withColumn("__start", start).withColumn("__end", end).drop("__most")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "__most" and c not in names.values()], F.col("__start").alias(names["start"]), ((F.col("__start") + F.col("__end")) / 2).alias(names["mid"]), F.col("__end").alias(names["end"]))


def pie(df: DataFrame, field: str | None = None, sort: bool = False, start: float = 0.0, end: float = 2 * math.pi, output: dict[str, str] | None = None) -> DataFrame:
    """Running angles over all rows in order; a two-level prefix sum, so no task sees all rows."""
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("start", "mid", "end")}
    v = F.coalesce(F.col(field).try_cast("double"), F.lit(0.0)) if field else F.lit(1.0)
    order = ([v.asc()] if sort else []) + ordering(df, None)
    rows = _prefix(df.withColumn("__v", v), order or [F.lit(0)], {"__before": v})
    total = df.agg(F.sum(v).alias("__total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    k = F.coalesce(F.try_divide(F.lit(end - start), F.col("__total")), F.lit(0.0))
    a = F.lit(start) + F.col("__before") * k
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], a.alias(names["start"]), (a + F.col("__v") * k / 2).alias(names["mid"]), (a + F.col("__v") * k).alias(names["end"]))


def sort(df: DataFrame, by: str | list[str]) -> DataFrame:
    """Rows in order; a range partitioning, not a single task."""
    return df.orderBy(*ordering(df, by))


def rank(df: DataFrame, by: str | list[str] | None = None, groupby: list[str] | None = None, normalize: bool = False, output: str = "rank") -> DataFrame:
    """0-based number of each row, by group if there are any. Without groups the two-level numbering is used."""
    order = ordering(df, by)
    if groupby:
        part = W.partitionBy(*groupby)
        n = F.row_number().over(part.orderBy(*order)) - 1
        value = F.coalesce(F.try_divide(n.cast("double"), F.count(F.lit(1)).over(part) - 1), F.lit(0.0)) if normalize else n.cast("long")
        return df.withColumn(output, value)
    rows = _prefix(df.drop(output), order, {output: F.lit(1)})
    if normalize:
        total = df.agg(F.count(F.lit(1)).alias("__n"))
        return rows.crossJoin(F.broadcast(total)).withColumn(output, F.coalesce(F.try_divide(F.col(output).cast("double"), F.col("__n") - 1), F.lit(0.0))).drop("__n")
    return rows.withColumn(output, F.col(output).cast("long"))


def fold(df: DataFrame, fields: list[str], output: dict[str, str] | None = None) -> DataFrame:
    """Columns to rows of key and value; the others are repeated."""
    names = {k: (output or {}).get(k, k) for k in ("key", "value")}
    ids = [c for c in df.columns if c not in fields]
    return df.unpivot(ids, fields, names["key"], names["value"])


def impute(df: DataFrame, field: str, keys: list[str], groupby: list[str] | None = None, method: str = "value", value: float | None = 0.0) -> DataFrame:
    """A row for each group and key value; what is missing gets ``value`` or the group's mean, median, min or max.

    A null group or key is one of its own. The combinations are the result itself; the distinct keys are broadcast only
    if counted few."""
    groups = groupby or []
    by = [*groups, *keys]
    x = F.col(field).cast("double")
    grid = df.select(*keys).distinct()
    if groups:
        held = df.groupBy(*groups)
        fills = held.agg(F.lit(value).cast("double").alias("__fill")) if method == "value" else held.agg(_FILLS[method](x).alias("__fill"))
        grid = fills.crossJoin(small(grid))
    else:
        fills = df.agg(F.lit(value).cast("double").alias("__fill") if method == "value" else _FILLS[method](x).alias("__fill"))
        grid = grid.crossJoin(F.broadcast(fills))  # one row
    there = df.select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(by)], F.col(field).alias("__value"), F.lit(True).alias("__there"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__h{i}"))
    return grid.join(there, same, "left").select(*by, F.coalesce(F.col("__value").cast("double"), "__fill").alias(field))


_FILLS = {"mean": F.avg, "median": lambda x: F.percentile(x, F.lit(0.5)), "min": F.min, "max": F.max}


def treeify(df: DataFrame, groupby: list[str], output: str = "values") -> DataFrame:
    """Nests rows by keys, the last key innermost."""
    held = [c for c in df.columns if c not in groupby]
    value = F.struct(*([F.col(ORDER)] if ORDER in held else []), *[F.col(c) for c in held if c != ORDER])
    out = df.groupBy(*groupby).agg(F.array_sort(F.collect_list(value)).alias(output))
    for i in range(len(groupby) - 1, 0, -1):
        out = out.groupBy(*groupby[:i]).agg(F.array_sort(F.collect_list(F.struct(groupby[i], output))).alias(output))
    return out


def hierarchy(df: DataFrame, id_: str, parent: str, value: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Partition layout of a tree given by parent ids: depth, x0, x1 (share of the parent) and y0, y1 of each node.

    Values of inner nodes are the sums of their leaves. One join a level, until no node is left; more levels
    than nodes are a cycle, which raises ValueError."""
    nodes = df.select(F.col(id_).alias("id"), F.col(parent).alias("parent"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("own"))
    leaves = nodes.join(nodes.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    # Walk each leaf up to the root; each step is a join on the parent.
    walk = leaves.select("id", "parent", F.col("own").alias("v"))
    sums = walk.select("id", "v")
    most = nodes.count()
    for step in itertools.count(1):
        up = walk.filter("parent is not null")
        up = up.select(F.col("parent").alias("id"), "v").groupBy("id").agg(F.sum("v").alias("v")).join(nodes.select("id", "parent"), "id")
        up = written(up.select("id", "parent", "v"), "walk")
        if up.isEmpty():
            break
        if step >= most:
            raise ValueError("the tree has a cycle")
        sums = sums.union(up.select("id", "v"))
        walk = up
    total = sums.groupBy("id").agg(F.sum("v").alias("value"))
    known = nodes.join(total, "id").select("id", "parent", "value")
    level = known.filter("parent is null").select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("x0"), F.lit(float(width)).alias("x1"), "value")
    out = level
    for depth in itertools.count(1):
        part = W.partitionBy("p").orderBy(F.col("c_value").desc(), "c_id")
        kids = known.select(F.col("id").alias("c_id"), F.col("parent").alias("p"), F.col("value").alias("c_value")).join(level.select(F.col("id").alias("p"), "x0", "x1", "value"), "p")
        before = F.coalesce(F.sum("c_value").over(part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        scale = F.try_divide(F.col("x1") - F.col("x0"), F.col("value"))
        level = kids.select(F.col("c_id").alias("id"), F.lit(depth).alias("depth"), (F.col("x0") + before * scale).alias("x0"), (F.col("x0") + (before + F.col("c_value")) * scale).alias("x1"), F.col("c_value").alias("value"))
        level = written(level, "level")
        if level.isEmpty():
            break
        if depth >= most:
            raise ValueError("the tree has a cycle")
        out = out.union(level)
    deepest = out.agg((F.max("depth") + 1).alias("__n"))
    rows = out.crossJoin(F.broadcast(deepest))  # one row
    return rows.select("id", "depth", "value", "x0", "x1", (F.col("depth") * height / F.col("__n")).alias("y0"), ((F.col("depth") + 1) * height / F.col("__n")).alias("y1"))


def modify(df: DataFrame, kind: str, rows: DataFrame | None = None, key: str | None = None, test: str | None = None) -> DataFrame:
    """insert, remove, toggle, upsert or clear, as new tables."""
    if kind == "clear":
        return df.limit(0) if test is None else filter_(df, f"!({test})")
    if kind == "insert":
        return df.unionByName(rows, allowMissingColumns=True)
    if kind == "remove":
        return df.join(rows.select(key).distinct(), key, "left_anti")
    if kind == "upsert":
        return df.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    if kind == "toggle":
        kept = df.join(rows.select(key).distinct(), key, "left_anti")
        return kept.unionByName(rows.join(df.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    raise ValueError(f"unknown modification {kind!r}")
