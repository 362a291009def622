"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most`` (3): the rates that stay closest, in entropy over
words, to the corpus itself while each source's words meet its target and the source's mean
log-length stays what it was. The dual of that problem is convex and has two numbers a source; its
solution tilts the odds of a word exponentially, rate = most / (1 + (most - 1) exp(-(a + b g))),
with g the document's centred log-length: as rates are bounded, the tilt is of rate / (most - rate). Newton steps solve it: each step is one distributed
aggregation of gradient and Hessian by source, so what reaches the driver is a row a source.

Rates become whole copies. The floor is certain; the rest goes to the documents whose hash, divided
by the rest, is lowest, up to a threshold that is calibrated by source: histograms of the threshold,
each round finer, find where the source's words come nearest its target. Hashes depend on doc_id
and size only, so reruns agree.

Sources are ordered by code point with null last, weigh 5, 2, 1 repeating, and share all words;
targets over ``most`` times their source's words stop there and the excess goes to the others by
weight until none is above. Null texts have no words; documents without words are taken once, which
adds no words. Repeated rows flip together. An empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
STEPS = 20
BINS = 256
ROUNDS = 4
#: Sources whose parameters are broadcast, at most; more are joined by shuffle. The driver holds some numbers a source.
FEW = 100_000
#: Decimals of the multipliers that are kept: sums of doubles differ in the last places with the order of tasks.
PLACES = 7


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't white space."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(common.SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+", -1))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """The target of each source, from all sources' sizes."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    total = float(sum(n for _, n in order))
    found: dict[str | None, float] = {}
    free = dict(order)
    while free:
        rest = total - sum(found.values())
        share = sum(weight[s] for s in free)
        over = [s for s, n in free.items() if rest * weight[s] / share > most * n]
        if not over:
            found |= {s: rest * weight[s] / share for s in free}
            break
        for s in over:
            found[s] = float(most * free.pop(s))
    return found


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a row a source, with a hint to broadcast it if there are at most ``FEW``."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= FEW else df


def _params(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return _few(spark, rows, "p_source string, a double, b double, centre double, rest double, t double, capped boolean")


def _with(sizes: DataFrame, params: DataFrame) -> DataFrame:
    return sizes.join(params, F.col("source").eqNullSafe(F.col("p_source")))


def _rate() -> Column:
    z = F.col("a") + F.col("b") * (F.log1p(F.col("size").cast("double")) - F.col("centre"))
    return F.when(F.col("capped"), F.lit(float(MOST))).otherwise(F.lit(float(MOST)) / (1 + (MOST - 1) * F.exp(-z)))


def _place() -> Column:
    """The document's hash as a number in [0, 1), over the rest of its rate: the lower, the sooner it gets one more copy."""
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(29)), 11) / F.lit(float(1 << 53))
    return u / F.greatest(F.col("fraction"), F.lit(1e-12))


def balance(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[dict, list[tuple]]:
    """(source -> (size, target), parameters by source) for a table of doc_id, source and size."""
    spark = sizes.sparkSession
    g = F.log1p(F.col("size").cast("double"))
    got = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.col("size") * g).alias("g")).collect()
    got.sort(key=lambda r: (r.source is None, r.source or ""))
    size = {r.source: r.n for r in got}
    target = targets(list(size.items()), weights)
    state = {s: [0.0, 0.0] for s in size}  # rates of 1: the corpus itself
    centre = {r.source: round(r.g / r.n, PLACES) if r.n else 0.0 for r in got}
    capped = {s: not n or target[s] >= MOST * n * (1 - 1e-9) for s, n in size.items()}

    def rows(rest=None, threshold=None) -> list[tuple]:
        return [(s, *state[s], centre[s], 0.0, (threshold or {}).get(s, 1.0), capped[s]) for s in size]

    for _ in range(STEPS):
        if all(capped.values()):
            break
        tilt = _with(sizes, _params(spark, rows())).filter(~F.col("capped"))
        x = F.log1p(F.col("size").cast("double")) - F.col("centre")
        r = _rate()
        slope = r * (1 - r / MOST)
        w = F.col("size").cast("double")
        found = tilt.groupBy("source").agg(F.sum(w * r).alias("f"), F.sum(w * x * r).alias("fx"), F.sum(w * slope).alias("h"), F.sum(w * x * slope).alias("hx"), F.sum(w * x * x * slope).alias("hxx")).collect()
        worst = 0.0
        for q in found:
            s = q.source
            e, ex = target[s] - q.f, -q.fx
            worst = max(worst, abs(e) / max(1.0, target[s]), abs(ex) / max(1.0, size[s]))
            ridge = 1e-9 * (q.h + q.hxx) + 1e-12
            a, b, c = q.h + ridge, q.hx, q.hxx + ridge
            det = a * c - b * b
            da, db = ((c * e - b * ex) / det, (a * ex - b * e) / det) if det > 1e-9 * a * c else (e / a, 0.0)
            step = max(1.0, abs(da) / 2, abs(db) / 2)  # damped: the odds move by a factor of e squared at most
            state[s][0] += da / step
            state[s][1] += db / step
        if worst < 1e-9:
            break
    state = {s: [round(x, PLACES) for x in ab] for s, ab in state.items()}
    # Thresholds: the words taken grow with t, in steps of one document.
    low, high = {s: 0.0 for s in size}, {s: 4.0 for s in size}
    for _ in range(ROUNDS):
        spec = _few(spark, [(s, low[s], high[s]) for s in size], "q_source string, low double, high double")
        d = _with(sizes, _params(spark, rows())).filter(~F.col("capped")).join(spec, F.col("source").eqNullSafe(F.col("q_source")))
        d = d.withColumn("rate", _rate()).withColumn("fraction", F.col("rate") - F.floor("rate"))
        bin_ = F.greatest(F.lit(-1), F.least(F.lit(BINS), F.floor((_place() - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * BINS))).cast("int")
        w = F.col("size")
        bins = d.groupBy("source", bin_.alias("bin")).agg(F.sum(w).alias("n"), F.sum(w * F.floor("rate")).alias("sure")).collect()
        by: dict = {}
        for q in bins:
            by.setdefault(q.source, {})[q.bin] = (q.n, q.sure)
        for s, cells in by.items():
            taken = sum(x[1] for x in cells.values()) + cells.get(-1, (0, 0))[0]
            width = (high[s] - low[s]) / BINS
            at = 0
            while at < BINS and taken + cells.get(at, (0, 0))[0] <= target[s]:
                taken += cells.get(at, (0, 0))[0]
                at += 1
            over = taken + cells.get(at, (0, 0))[0] - target[s] if at < BINS else math.inf
            # The last cell is taken whole when that comes nearer, once cells are as fine as they get.
            low[s], high[s] = low[s] + width * at, low[s] + width * min(BINS, at + 1)
            by[s] = (low[s], high[s], target[s] - taken, over)
    threshold = {s: x[1] if x[3] < x[2] else x[0] for s, x in by.items()}
    return {s: (size[s], target[s]) for s in size}, rows(threshold=threshold)


def with_copies(docs: DataFrame, params: list[tuple]) -> DataFrame:
    """``docs`` (doc_id, source, size and others) plus ``copies``; no shuffle."""
    tilt = _with(docs, _params(docs.sparkSession, params)).withColumn("rate", _rate()).withColumn("fraction", F.col("rate") - F.floor("rate"))
    more = F.when(F.col("capped") | (F.col("fraction") <= 0), F.lit(0)).otherwise((_place() < F.col("t")).cast("int"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(MOST), F.floor("rate") + more)).cast("int").alias("copies")
    return tilt.select(*[F.col(c) for c in docs.columns], copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = common.written(common.documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    by_source, params = balance(sizes)
    spec = _few(spark, [(s, n, t) for s, (n, t) in by_source.items()], "k_source string, source_size long, target double")
    mixed = with_copies(sizes, params).join(spec, F.col("source").eqNullSafe(F.col("k_source")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged."""
    sizes = docs.withColumn("__size", word_count(F.col("text")))
    table = common.written(sizes.select("doc_id", "source", F.col("__size").alias("size")), "sizes")
    _, params = balance(table)
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    return with_copies(own, params).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
