"""Scales: domains from literals or data, ranges, and each scale as a Column of its input.

What depends on data is a one-row extent or a list of distinct values; a domain list is joined by
broadcast only when it was counted small, as is every list that becomes an expression."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import ticks
from millrace.operators.aggregates import ORDER, aggregate_column

#: A discrete domain of at most so many values becomes an expression; longer ones are joined.
LITERAL_DOMAIN = 1000


def _rule(hexes: str) -> list[str]:
    return ["#" + h for h in hexes.split()]


#: Named ranges.
CATEGORY10 = _rule("1f77b4 ff7f0e 2ca02c d62728 9467bd 8c564b e377c2 7f7f7f bcbd22 17becf")
CATEGORY20 = _rule("1f77b4 aec7e8 ff7f0e ffbb78 2ca02c 98df8a d62728 ff9896 9467bd c5b0d5 8c564b c49c94 e377c2 f7b6d2 7f7f7f c7c7c7 bcbd22 dbdb8d 17becf 9edae5")
CATEGORY20B = _rule("393b79 5254a3 6b6ecf 9c9ede 637939 8ca252 b5cf6b cedb9c 8c6d31 bd9e39 e7ba52 e7cb94 843c39 ad494a d6616b e7969c 7b4173 a55194 ce6dbd de9ed6")
CATEGORY20C = _rule("3182bd 6baed6 9ecae1 c6dbef e6550d fd8d3c fdae6b fdd0a2 31a354 74c476 a1d99b c7e9c0 756bb1 9e9ac8 bcbddc dadaeb 636363 969696 bdbdbd d9d9d9")
SHAPES = ["circle", "cross", "diamond", "square", "triangle-down", "triangle-up"]


@dataclass
class Continuous:
    """linear, time, log, pow, sqrt: affine after a transform of the domain."""

    domain: Sequence[float]
    range: Sequence[float]
    type: str = "linear"
    exponent: float = 1.0
    clamp: bool = False
    round: bool = False

    def _t(self, x):
        column = isinstance(x, Column)
        if self.type == "log":
            if column:
                return F.when(F.lit(self.domain[0] > 0), F.log10(x)).otherwise(-F.log10(-x))
            return math.log10(x) if self.domain[0] > 0 else -math.log10(-x)
        if self.type in ("pow", "sqrt"):
            e = 0.5 if self.type == "sqrt" else self.exponent
            return F.signum(x) * F.pow(F.abs(x), F.lit(e)) if column else math.copysign(abs(x) ** e, x)
        return x

    def apply(self, x: Column) -> Column:
        x = x.cast("double")
        d = [float(self._t(v)) for v in self.domain]
        r = [float(v) for v in self.range]
        if self.clamp:
            x = F.least(F.greatest(x, F.lit(float(min(self.domain)))), F.lit(float(max(self.domain))))
        t = self._t(x)
        out = None
        for i in range(len(d) - 1):  # a piece for each pair of neighbours
            span = d[i + 1] - d[i]
            y = r[i] + (t - d[i]) / span * (r[i + 1] - r[i]) if span else F.lit((r[i] + r[i + 1]) / 2)
            if i == len(d) - 2:
                out = y if out is None else out.otherwise(y)
            else:
                inside = t <= d[i + 1] if d[-1] > d[0] else t >= d[i + 1]
                out = F.when(inside, y) if out is None else out.when(inside, y)
        return F.round(out) if self.round else out

    def invert(self, y: Column) -> Column:
        if self.type not in ("linear", "time"):
            raise ValueError("only affine scales are inverted")
        return Continuous(self.range, self.domain).apply(y)

    def band(self) -> float:
        return 0.0

    def ticks(self, count: float = 10) -> list[float]:
        lo, hi = self.domain[0], self.domain[-1]
        return ticks.log_ticks(lo, hi) if self.type == "log" else ticks.time_ticks(lo, hi, count) if self.type in ("time", "utc") else ticks.linear_ticks(lo, hi, count)

    def ticks_frame(self, spark: SparkSession, count: float = 10, values: Sequence | None = None, fmt: str | None = None) -> DataFrame:
        from millrace.functions.dates import strftime
        from millrace.functions.numbers import auto_format, d3_format

        rows = spark.createDataFrame([(float(v),) for v in (values or self.ticks(count))], "value double")
        x = F.col("value")
        text = strftime(F.timestamp_millis(x.cast("long")), fmt or "%Y-%m-%d") if self.type in ("time", "utc") else d3_format(x, fmt or auto_format(float(self.domain[0]), float(self.domain[-1]), int(count)))
        return rows.select("value", self.apply(x).alias("position"), text.alias("text"))


@dataclass
class Ordinal:
    """Value i of the domain gets range[i mod n]; with bands or points the range is computed."""

    domain: list
    range: Sequence
    size: float = 0.0

    def apply(self, x: Column) -> Column:
        if len(self.domain) > LITERAL_DOMAIN:
            raise ValueError("a domain this long must be joined: use mapped()")
        if not self.domain:
            return F.lit(None)
        pairs = [y for i, v in enumerate(self.domain) for y in (F.lit(str(v)), F.lit(self.range[i % len(self.range)]))]
        return F.try_element_at(F.create_map(*pairs), x.cast("string"))

    def band(self) -> float:
        return self.size

    def ticks_frame(self, spark: SparkSession, count: float = 10, values: Sequence | None = None, fmt: str | None = None) -> DataFrame:
        shown = values or self.domain
        rows = spark.createDataFrame([(str(v),) for v in shown], "value string")
        return rows.select("value", (self.apply(F.col("value")) + self.size / 2).alias("position"), F.col("value").alias("text"))


def mapped(df: DataFrame, column: str, domain: DataFrame, range_: Sequence, output: str) -> DataFrame:
    """An ordinal scale over a domain table of (value, index): unseen values get a null."""
    key = F.element_at(F.array(*map(F.lit, range_)), (F.col("__i") % len(range_) + 1).cast("int"))
    small = domain.select(F.col("value").alias("__v"), F.col("index").alias("__i"))
    if small.limit(LITERAL_DOMAIN + 1).count() <= LITERAL_DOMAIN:
        small = F.broadcast(small)
    return df.join(small, F.col(column) == F.col("__v"), "left").withColumn(output, key).drop("__v", "__i")


def domain_frame(sources: Sequence[tuple[DataFrame, Sequence[str]]], sort: bool | dict = False) -> DataFrame:
    """(value, index) of the distinct values of fields of datasets: by first appearance, in natural order, or by an aggregate."""
    parts = []
    for df, fields_ in sources:
        for f in fields_:
            order = F.col(ORDER) if ORDER in df.columns else F.lit(0)
            extra = [aggregate_column(df, sort["op"], sort["field"]).alias("by")] if isinstance(sort, dict) else []
            parts.append(df.filter(F.col(f).isNotNull()).groupBy(F.col(f).alias("value")).agg(F.min(order).alias("first"), *extra).withColumn("source", F.lit(len(parts))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = [F.min("by").alias("by")] if isinstance(sort, dict) else []
    out = out.groupBy("value").agg(F.min(F.struct("source", "first")).alias("first"), *by)
    keys = [F.col("by").desc() if sort.get("order") == "desc" else F.col("by"), F.col("value")] if isinstance(sort, dict) else [F.col("value")] if sort else [F.col("first"), F.col("value")]
    # Distinct values, not rows: their number is the domain's.
    return out.select("value", (F.row_number().over(W.orderBy(*keys)) - 1).alias("index"))


@dataclass
class Bucketed:
    """quantile, quantize and threshold: range[insertion point of x in the cuts]."""

    cuts: Sequence[float]
    range: Sequence
    found: list = field(default_factory=list)

    def apply(self, x: Column) -> Column:
        out = None
        for i, c in enumerate(self.cuts):
            out = F.when(x < c, F.lit(self.range[min(i, len(self.range) - 1)])) if out is None else out.when(x < c, F.lit(self.range[min(i, len(self.range) - 1)]))
        last = F.lit(self.range[min(len(self.cuts), len(self.range) - 1)])
        return F.when(x.isNull(), F.lit(None)).otherwise(last if out is None else out.otherwise(last))

    def of(self, x: float):
        return self.range[min(bisect.bisect_right(list(self.cuts), x), len(self.range) - 1)]

    def band(self) -> float:
        return 0.0

    def ticks_frame(self, spark: SparkSession, count: float = 10, values: Sequence | None = None, fmt: str | None = None) -> DataFrame:
        rows = spark.createDataFrame([(float(c),) for c in self.cuts], "value double")
        return rows.select("value", self.apply(F.col("value")).alias("position"), F.col("value").cast("string").alias("text"))


def quantile(df: DataFrame, column: str, range_: Sequence) -> Bucketed:
    """Cuts at the exact quantiles of a column."""
    n = len(range_)
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    cuts = df.agg(F.percentile(x, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("q")).first().q if n > 1 else []
    return Bucketed(list(cuts or []), range_)


def quantize(lo: float, hi: float, range_: Sequence) -> Bucketed:
    n = len(range_)
    return Bucketed([lo + (hi - lo) * i / n for i in range(1, n)], range_)


def extent(df: DataFrame, *columns: str, zero: bool = False) -> tuple[float, float]:
    """Smallest and largest of numeric columns, with 0 if asked."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lows, highs = [row[f"lo{i}"] for i in range(len(columns))], [row[f"hi{i}"] for i in range(len(columns))]
    lo = min([x for x in lows if x is not None], default=0.0)
    hi = max([x for x in highs if x is not None], default=0.0)
    return (min(lo, 0.0), max(hi, 0.0)) if zero else (lo, hi)


def bands(n: int, start: float, stop: float, padding: float = 0.0, outer: float | None = None, rounded: bool = False) -> tuple[list[float], float]:
    """(starts, width) of n bands over an interval."""
    outer = padding if outer is None else outer
    back = stop < start
    s, e = min(start, stop), max(start, stop)
    room = max(n - padding + 2 * outer, 1e-12)
    step = (e - s) / room
    if rounded:
        step = math.floor(step)
        first = s + round((e - s - (n - padding) * step) / 2)
        width = float(round(step * (1 - padding)))
    else:
        first, width = s + step * outer, step * (1 - padding)
    out = [first + step * i for i in range(n)]
    return (out[::-1] if back else out), width


def points(n: int, start: float, stop: float, padding: float = 0.0, rounded: bool = False) -> list[float]:
    if n < 2:
        middle = (start + stop) / 2
        return [float(round(middle)) if rounded else middle][:n]
    step = (stop - start) / (n - 1 + padding)
    if rounded:
        step = math.trunc(step)
        first = start + round((stop - start - step * (n - 1 + padding)) / 2 + step * padding / 2)
    else:
        first = start + step * padding / 2
    return [first + step * i for i in range(n)]


def named_range(name, spec) -> list:
    if isinstance(name, list):
        return name
    sizes = {"width": [0, spec.get("width", 500)], "height": [spec.get("height", 500), 0]}
    known = {"category10": CATEGORY10, "category20": CATEGORY20, "category20b": CATEGORY20B, "category20c": CATEGORY20C, "shapes": SHAPES}
    if name in sizes:
        return sizes[name]
    if name in known:
        return known[name]
    raise ValueError(f"unknown range {name!r}")


def from_spec(s: dict, spec) -> Continuous | Ordinal | Bucketed:
    """A scale of a specification; data domains are computed here, by one aggregation each."""
    kind = s.get("type", "linear")
    range_ = named_range(s.get("range", "width"), spec.spec)
    if s.get("reverse"):
        range_ = range_[::-1]
    domain = s.get("domain")
    refs = [] if not isinstance(domain, dict) else domain.get("fields", [domain])
    sources = []
    for r in refs:
        f = r["field"]
        sources.append((spec.dataset(r.get("data", domain.get("data"))), [f] if isinstance(f, str) else list(f)))
    if kind == "ordinal":
        if sources:
            sort = domain.get("sort", s.get("sort", False))
            rows = domain_frame(sources, sort).orderBy("index").limit(LITERAL_DOMAIN + 1).collect()
            domain = [r.value for r in rows]
        n = len(domain or [])
        if s.get("points"):
            return Ordinal(list(domain or []), points(n, *map(float, range_[:2]), s.get("padding", 0.0), s.get("round", False)))
        numeric = len(range_) == 2 and all(isinstance(x, (int, float)) for x in range_) and s.get("range") not in ("shapes",)
        if s.get("bandSize"):
            return Ordinal(list(domain or []), [s["bandSize"] * i for i in range(n)], s["bandSize"])
        if numeric:
            starts, width = bands(n, *map(float, range_), s.get("padding", 0.0), s.get("outerPadding"), s.get("round", False))
            return Ordinal(list(domain or []), starts, width)
        return Ordinal(list(domain or []), range_)
    if kind == "quantile":
        df, names = sources[0]
        return quantile(df, names[0], range_)
    if kind == "threshold":
        return Bucketed(list(domain), range_)
    if sources:
        found = [extent(df, *names) for df, names in sources]
        lo, hi = min(x[0] for x in found), max(x[1] for x in found)
    else:
        lo, hi = (float(x) for x in (domain or [0, 1])[:2])
    lo = s.get("domainMin", lo)
    hi = s.get("domainMax", hi)
    if s.get("zero", kind in ("linear", "pow", "sqrt", "quantize") and bool(sources)):
        lo, hi = min(lo, 0.0), max(hi, 0.0)
    if kind == "quantize":
        return quantize(lo, hi, range_)
    if s.get("nice"):
        lo, hi = ticks.nice_time(lo, hi, s["nice"] if isinstance(s["nice"], str) else None) if kind in ("time", "utc") else ticks.nice(lo, hi)
    whole = domain if isinstance(domain, list) and len(domain) > 2 else [lo, hi]
    return Continuous(whole, range_, kind, s.get("exponent", 1.0), s.get("clamp", False), s.get("round", False))
