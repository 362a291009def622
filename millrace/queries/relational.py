"""Dataset transforms and aggregates on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import transforms as t
from millrace.operators.aggregates import ORDER, aggregate
from millrace.queries import query, table


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """The row order is the primary key; a struct of keys compares key by key."""
    return df.withColumn(ORDER, F.struct(*keys) if len(keys) > 1 else F.col(keys[0]))


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue, round(avg(l_quantity), 6) AS mean_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def aggregate_basic(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    items = t.formula(items, "revenue", "datum.l_extendedprice * (1 - datum.l_discount)")
    out = aggregate(items, ["l_returnflag", "l_linestatus"], [{"field": "l_quantity", "ops": ["sum", "mean"], "as": ["sum_qty", "mean_qty"]}, {"field": "l_extendedprice", "ops": ["sum"], "as": ["sum_base"]}, {"field": "revenue", "ops": ["sum"], "as": ["sum_revenue"]}, {"field": "*", "ops": ["count"], "as": ["n"]}])
    return _round(_round(out, 2, "sum_qty", "sum_base", "sum_revenue"), 6, "mean_qty")


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
  CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size
FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 40 AND l_returnflag <> 'N'
""")
def filter_formula(spark: SparkSession, sf: str) -> DataFrame:
    items = t.filter_(table(spark, sf, "lineitem"), "datum.l_discount >= 0.05 && datum.l_quantity < 40 && datum.l_returnflag != 'N'")
    items = t.formulas(items, {"charge": "datum.l_extendedprice * (1 - datum.l_discount) * (1 + datum.l_tax)", "size": "datum.l_quantity > 25 ? 'big' : 'small'"})
    return _round(items.select("l_orderkey", "l_linenumber", "charge", "size"), 6, "charge")


@query("""
SELECT o_orderpriority, count(*) AS n, count(o_totalprice) AS valid, count(*) FILTER (o_totalprice IS NULL) AS missing,
  count(DISTINCT o_orderstatus) AS statuses, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
  round(var_samp(o_totalprice) / 1e6, 4) AS variance, round(var_pop(o_totalprice) / 1e6, 4) AS variancep,
  round(stddev_samp(o_totalprice), 4) AS stdev, round(stddev_pop(o_totalprice), 4) AS stdevp,
  round((avg(o_totalprice) - quantile_cont(o_totalprice, 0.5)) / stddev_samp(o_totalprice), 6) AS skew
FROM orders GROUP BY ALL
""")
def aggregate_stats(spark: SparkSession, sf: str) -> DataFrame:
    ops = ["valid", "missing", "min", "max", "median", "q1", "q3", "variance", "variancep", "stdev", "stdevp", "modeskew"]
    names = ["valid", "missing", "lo", "hi", "median", "q1", "q3", "variance", "variancep", "stdev", "stdevp", "skew"]
    out = aggregate(table(spark, sf, "orders"), ["o_orderpriority"], [{"field": "*", "ops": ["count"], "as": ["n"]}, {"field": "o_totalprice", "ops": ops, "as": names}, {"field": "o_orderstatus", "ops": ["distinct"], "as": ["statuses"]}])
    out = out.withColumns({c: F.col(c) / 1e6 for c in ("variance", "variancep")}).withColumn("statuses", F.col("statuses").cast("long"))
    return _round(_round(out, 2, "lo", "hi"), 4, "median", "q1", "q3", "variance", "variancep", "stdev", "stdevp").withColumn("skew", F.round("skew", 6))


@query("""
SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest
FROM orders GROUP BY ALL
""")
def argminmax(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate(_ordered(table(spark, sf, "orders"), "o_orderkey"), ["o_orderpriority"], {"o_totalprice": ["argmin", "argmax"]})
    return out.select("o_orderpriority", F.col("argmin_o_totalprice.o_orderkey").alias("cheapest"), F.col("argmax_o_totalprice.o_orderkey").alias("dearest"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL")
def aggregate_values(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate(_ordered(table(spark, sf, "nation"), "n_nationkey"), ["n_regionkey"], {"n_name": "values"})
    return out.select("n_regionkey", F.array_join("values_n_name", ",").alias("names"))


@query("""
SELECT r_name || '|' || r_regionkey AS key, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS rows_text, count(*) AS n
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
""")
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    both = _ordered(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_nationkey")
    out = t.facet(both, ["r_name", "r_regionkey"], [{"field": "*", "ops": ["count"], "as": ["n"]}])
    rows = F.transform("values", lambda v: F.concat_ws(":", v["n_nationkey"].cast("string"), v["n_name"]))
    return out.select("key", F.array_join(rows, ";").alias("rows_text"), "n")


@query("""
WITH s AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(max(e), 2) AS top FROM s GROUP BY ALL
""")
def facet_stacked(spark: SparkSession, sf: str) -> DataFrame:
    """A sub-transform (stack) runs on the flat rows by window before rows are gathered."""
    items = _ordered(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select("l_returnflag", "l_linestatus", "l_quantity", ORDER)
    out = t.stack(items, "l_quantity", ["l_returnflag", "l_linestatus"])
    return _round(aggregate(out.drop(ORDER), ["l_returnflag", "l_linestatus"], [{"field": "*", "ops": ["count"], "as": ["n"]}, {"field": "layout_end", "ops": ["max"], "as": ["top"]}]), 2, "top")


@query("""
WITH x AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
c AS (SELECT v.step FROM x, (VALUES (0.1), (0.2), (0.5), (1.0), (2.0), (5.0), (10.0), (20.0)) v(step) WHERE (hi - lo) / v.step <= 20 ORDER BY v.step LIMIT 1)
SELECT CAST(floor(l_quantity / step) * step AS DOUBLE) AS bin_start, CAST(floor(l_quantity / step) * step + step AS DOUBLE) AS bin_end, count(*) AS n
FROM lineitem, c GROUP BY ALL
""")
def bin_quantity(spark: SparkSession, sf: str) -> DataFrame:
    out = t.bin_(table(spark, sf, "lineitem").select("l_quantity"), "l_quantity", maxbins=20)
    return aggregate(out, ["bin_start", "bin_end"], [{"field": "*", "ops": ["count"], "as": ["n"]}])


@query("""
SELECT CAST(floor((o_totalprice - 0) / 25000) * 25000 AS DOUBLE) AS bin_start, CAST(floor(o_totalprice / 25000) * 25000 + 12500 AS DOUBLE) AS bin_mid, count(*) AS n FROM orders GROUP BY ALL
""")
def bin_fixed_step(spark: SparkSession, sf: str) -> DataFrame:
    out = t.bin_(table(spark, sf, "orders").select("o_totalprice"), "o_totalprice", min=0.0, max=600000.0, step=25000.0)
    return aggregate(out, ["bin_start", "bin_mid"], [{"field": "*", "ops": ["count"], "as": ["n"]}])


@query(r"""
SELECT text, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS text FROM documents) w
WHERE NOT regexp_full_match(text, 'the|of|and|de|la|die|der', 'i') GROUP BY ALL
""")
def countpattern_docs(spark: SparkSession, sf: str) -> DataFrame:
    return t.countpattern(table(spark, sf, "documents"), "text", r"[\p{L}\p{N}_']+", stopwords="the|of|and|de|la|die|der", output={"count": "n"})


@query("SELECT r.r_name AS region, n.n_name AS nation FROM region r CROSS JOIN nation n WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey > 3")
def cross_regions(spark: SparkSession, sf: str) -> DataFrame:
    out = t.cross(table(spark, sf, "region"), table(spark, sf, "nation"), test="datum.a.r_regionkey == datum.b.n_regionkey && datum.b.n_nationkey > 3")
    return out.select(F.col("a.r_name").alias("region"), F.col("b.n_name").alias("nation"))


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def cross_no_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    out = t.cross(_ordered(table(spark, sf, "nation"), "n_nationkey"), diagonal=False)
    return out.select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("SELECT c_custkey, n_name AS nation, n_regionkey AS regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_nation(spark: SparkSession, sf: str) -> DataFrame:
    out = t.lookup(table(spark, sf, "customer"), table(spark, sf, "nation"), ["c_nationkey"], ["nation"], "n_nationkey")
    return out.select("c_custkey", F.col("nation.n_name").alias("nation"), F.col("nation.n_regionkey").alias("regionkey"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    default = F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    out = t.lookup(table(spark, sf, "documents").select("doc_id"), labels, ["doc_id"], ["label"], "doc_id", default)
    return out.select("doc_id", "label.quality", "label.toxic")


@query("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def lookup_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    orders = _ordered(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    out = t.lookup(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], ["o"], "o_custkey")
    return out.select("c_custkey", F.col("o.o_orderkey").alias("last_order"))


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) ON s_nationkey = i")
def lookup_index(spark: SparkSession, sf: str) -> DataFrame:
    nations = t.with_order(table(spark, sf, "nation"), "n_nationkey")
    out = t.lookup(table(spark, sf, "supplier"), nations, ["s_nationkey"], ["n"])
    return out.select("s_suppkey", F.col("n.n_name").alias("nation"))


_STACK = """
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS e,
  sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem), m AS (SELECT max(s) AS most FROM w)
SELECT l_orderkey, l_linenumber, {0} FROM w, m
"""


def _stack(spark: SparkSession, sf: str, offset: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out = t.stack(items, "l_quantity", ["l_orderkey"], ["l_linenumber", "l_quantity"], offset)
    return _round(out.drop("l_quantity"), 9, "layout_start", "layout_mid", "layout_end")


@query(_STACK.format("round(e - v, 9) AS layout_start, round(e - v / 2, 9) AS layout_mid, round(e, 9) AS layout_end"))
def stack_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _stack(spark, sf, "zero")


@query(_STACK.format("round(e - v + (most - s) / 2, 9) AS layout_start, round(e - v / 2 + (most - s) / 2, 9) AS layout_mid, round(e + (most - s) / 2, 9) AS layout_end"))
def stack_center(spark: SparkSession, sf: str) -> DataFrame:
    return _stack(spark, sf, "center")


@query(_STACK.format("round((e - v) / s, 9) AS layout_start, round((e - v / 2) / s, 9) AS layout_mid, round(e / s, 9) AS layout_end"))
def stack_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _stack(spark, sf, "normalize")


@query(f"""
WITH g AS (SELECT c_mktsegment, count(*)::DOUBLE AS v FROM customer GROUP BY ALL), w AS (SELECT *, sum(v) OVER (ORDER BY c_mktsegment ROWS UNBOUNDED PRECEDING) AS e, sum(v) OVER () AS s FROM g)
SELECT c_mktsegment, round((e - v) * {2 * math.pi!r} / s, 6) AS layout_start, round((e - v / 2) * {2 * math.pi!r} / s, 6) AS layout_mid, round(e * {2 * math.pi!r} / s, 6) AS layout_end FROM w
""")
def pie_segment(spark: SparkSession, sf: str) -> DataFrame:
    groups = aggregate(table(spark, sf, "customer"), ["c_mktsegment"], [{"field": "*", "ops": ["count"], "as": ["v"]}])
    out = t.pie(_ordered(groups, "c_mktsegment"), "v")
    return _round(out.drop("v", ORDER), 6, "layout_start", "layout_mid", "layout_end")


@query("SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All columns go along, in 16 ranges."""
    return t.rank(table(spark, sf, "orders").repartition(16), ["-o_totalprice", "o_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, round(e - l_quantity, 6) AS layout_start, round(e - l_quantity / 2, 6) AS layout_mid, round(e, 6) AS layout_end
FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
""")
def stack_few_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Three groups that hold all rows, so sums run over ranges; all columns go along."""
    out = t.stack(table(spark, sf, "lineitem").repartition(16), "l_quantity", ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return _round(out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "layout_start", "layout_mid", "layout_end"), 6, "layout_start", "layout_mid", "layout_end")


@query(f"""
WITH w AS (SELECT *, sum(c_acctbal + 1000) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS e, sum(c_acctbal + 1000) OVER () AS s FROM customer)
SELECT c_custkey, c_name, c_mktsegment, round((e - c_acctbal - 1000) * {2 * math.pi!r} / s, 6) AS layout_start, round(e * {2 * math.pi!r} / s, 6) AS layout_end FROM w
""")
def pie_customers(spark: SparkSession, sf: str) -> DataFrame:
    """A slice a customer, by balance; all columns go along."""
    customers = _ordered(table(spark, sf, "customer").withColumn("size", F.col("c_acctbal") + 1000).repartition(16), "c_custkey")
    out = t.pie(customers, "size").select("c_custkey", "c_name", "c_mktsegment", "layout_start", "layout_end")
    return _round(out, 6, "layout_start", "layout_end")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders")
def rank_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return t.rank(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], ["o_custkey"]).drop("o_orderdate")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_suppkey")
def sort_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return t.sort(table(spark, sf, "supplier"), ["-s_nationkey", "s_suppkey"]).select("s_suppkey", "s_name", "s_acctbal")


@query("""
SELECT l_orderkey, l_linenumber, key, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR key IN (l_quantity, l_discount, l_tax))
""")
def fold_measures(spark: SparkSession, sf: str) -> DataFrame:
    return t.fold(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])


@query("""
WITH d AS (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY ALL)
SELECT c.o_custkey, p.o_orderpriority, coalesce(d.total, 0) AS total FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN d USING (o_custkey, o_orderpriority)
""")
def impute_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders; many customers have none of some priority."""
    sums = aggregate(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], [{"field": "o_totalprice", "ops": ["sum"], "as": ["total"]}])
    return t.impute(_round(sums, 4, "total"), "total", ["o_orderpriority"], ["o_custkey"])


@query("SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS kids FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def treeify_nations(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    out = t.treeify(_ordered(nations, "n_nationkey"), ["r_regionkey"])
    return out.select("r_regionkey", F.array_join(F.transform("values", lambda v: v["n_name"]), ",").alias("kids"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def predicate_in(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.plans.predicates import Predicates

    customers = t.filter_(table(spark, sf, "customer"), "datum.c_mktsegment == 'BUILDING'")
    rules = Predicates([{"name": "wanted", "type": "in", "item": {"arg": "key"}, "data": "customers", "field": "c_custkey"}], {"customers": customers})
    return rules.keep(table(spark, sf, "orders"), "wanted", {"key": "o_custkey"}).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R') OR l_discount > 0.09")
def predicate_rules(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.plans.predicates import Predicates

    rules = Predicates([
        {"name": "mid", "type": "in", "item": {"arg": "x"}, "range": [20, 10]},
        {"name": "returned", "type": "==", "operands": [{"arg": "flag"}, "R"]},
        {"name": "cheap", "type": ">", "operands": [{"arg": "d"}, 0.09]},
        {"name": "both", "type": "&&", "operands": [{"predicate": "mid"}, {"predicate": "returned"}]},
        {"name": "any", "type": "||", "operands": [{"predicate": "both"}, {"predicate": "cheap"}]},
    ])
    return rules.keep(table(spark, sf, "lineitem"), "any", {"x": "l_quantity", "flag": "l_returnflag", "d": "l_discount"}).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.sources.formats import typed_json

    events = typed_json(table(spark, sf, "events"), "props", {"k": "number"}, into="p")
    return t.filter_(events, "datum.p.k > 50").select("event_id", F.col("p.k").cast("long").alias("k"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def modify_remove_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without all labelled ones; the labels cover some."""
    return t.modify(table(spark, sf, "documents").select("doc_id", "source"), "remove", table(spark, sf, "labels"), "doc_id")


@query("""
WITH r AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY ALL)
SELECT 'region' AS kind, k AS id, n FROM r UNION ALL SELECT 'total', -1, (SELECT count(*) FROM nation)
""")
def spec_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A whole specification: named datasets that read one another."""
    from millrace.plans.spec import Spec

    spec = Spec({
        "version": 2,
        "data": [
            {"name": "nations", "transform": [{"type": "formula", "field": "k", "expr": "datum.n_regionkey"}]},
            {"name": "regions", "source": "nations", "transform": [{"type": "aggregate", "groupby": ["k"], "summarize": [{"field": "*", "ops": ["count"], "as": ["n"]}]}]},
        ],
    }, spark, tables={"nations": table(spark, sf, "nation")})
    regions = spec.dataset("regions")
    total = regions.agg(F.sum("n").alias("n"))
    return regions.select(F.lit("region").alias("kind"), F.col("k").cast("int").alias("id"), "n").union(total.select(F.lit("total"), F.lit(-1), "n"))
