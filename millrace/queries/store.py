"""Store queries: title search, existence, redirects, the dump source."""

from __future__ import annotations

import bz2
import itertools
import json
import os
import uuid
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch
from millrace.queries import query, table
from millrace.sources import dump, formats, search


@query("""
SELECT title FROM (SELECT DISTINCT p_name AS title FROM part) WHERE regexp_matches(title, '(?i)bl')
ORDER BY CASE WHEN starts_with(lower(title), 'bl') THEN 0 ELSE 1 END, lower(title), title LIMIT 500
""")
def title_search(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    return search.search(titles, "bl")


@query("SELECT o_custkey AS key, (c_custkey IS NOT NULL) AS \"exists\" FROM (SELECT DISTINCT o_custkey + 300 AS o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def exists_flag(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "orders").select((F.col("o_custkey") + 300).alias("key")).distinct()
    return search.exists(links, table(spark, sf, "customer"), "key", "c_custkey")


@query("SELECT o_custkey AS key FROM (SELECT DISTINCT o_custkey + 300 AS o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def red_links(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "orders").select((F.col("o_custkey") + 300).alias("key")).distinct()
    return search.missing(links, table(spark, sf, "customer"), "key", "c_custkey")


@query("SELECT 'C' || c_custkey AS title, 'C' || CASE WHEN c_custkey >= 100 THEN c_custkey // 100 WHEN c_custkey >= 10 THEN c_custkey // 10 ELSE c_custkey END AS resolved FROM customer")
def redirect_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's page redirects to that of its number without the last digit; two hops at most are followed."""
    c = table(spark, sf, "customer")
    name = lambda n: F.concat(F.lit("C"), n.cast("long"))
    redirects = c.filter("c_custkey >= 10").select(name(F.col("c_custkey")).alias("title"), name(F.floor(F.col("c_custkey") / 10)).alias("target"))
    return search.resolve(c.select(name(F.col("c_custkey")).alias("title")), redirects)


@query("""
WITH n AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS i FROM region), k AS (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS j FROM nation),
r AS (SELECT r_regionkey, i + (SELECT count(*) FROM nation WHERE n_regionkey < n.r_regionkey) AS num FROM n)
SELECT 'world' AS name, CAST(NULL AS DOUBLE) AS parent, 0::BIGINT AS num
UNION ALL SELECT r_name, 0, num FROM r JOIN region USING (r_regionkey)
UNION ALL SELECT n_name, num::DOUBLE, num + 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 FROM nation JOIN r ON n_regionkey = r_regionkey
""")
def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A document of regions and their nations, flattened depth first."""
    kids = F.array_sort(F.collect_list(F.struct("n_nationkey", F.struct(F.col("n_name").alias("name")).alias("kid"))))
    nested = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(kids, lambda k: k["kid"]).alias("children"))
    regions = table(spark, sf, "region").join(nested, "r_regionkey", "left").orderBy("r_regionkey").select(F.col("r_name").alias("name"), "children")
    tree = {"name": "world", "children": [json.loads(x) for x in regions.toJSON().collect()]}  # the one document of the format
    return formats.treejson(spark, tree).select("name", "parent", F.col("__ord").alias("num"))


_TITLE = "replace(replace(p_name, ' ', ' & '), 'bolt', '\"bolt\"') || ' ' || p_partkey"


def _dump(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A dump and its index, written to the shared folder: a stream of 50 pages for the parts in order, after the header.

    Its one file has to be written by one process; a dump of parts is small."""
    where = f"{scratch.folder(spark).removeprefix('file://').removeprefix('file:')}/millrace/dump-{uuid.uuid4().hex}"
    os.makedirs(where)
    path, index, lines = f"{where}/20240102-multistream.xml.bz2", f"{where}/index.txt", []
    title = F.expr(_TITLE)
    rows = table(spark, sf, "part").select("p_partkey", title.alias("title"), F.concat(F.lit("Size "), "p_size", F.lit(" < & >")).alias("body"), F.when(F.col("p_size") == 1, F.lit("Ones")).alias("target")).orderBy("p_partkey").toLocalIterator()
    with open(path, "wb") as f:
        f.write(bz2.compress(b'<mediawiki><siteinfo><sitename>Parts</sitename><namespaces><namespace key="0" case="first-letter" /></namespaces></siteinfo>'))
        while some := list(itertools.islice(rows, 50)):
            at = f.tell()
            lines += [f"{at}:{r.p_partkey}:{escape(r.title, {chr(34): '&quot;'})}" for r in some]
            page = lambda r: f"<page><title>{escape(r.title)}</title><id>{r.p_partkey}</id>" + (f"<redirect title={quoteattr(r.target)} />" if r.target else "") + f"<revision><id>1</id><model>wikitext</model><text>{escape(r.body)}</text></revision></page>"
            f.write(bz2.compress("".join(map(page, some)).encode()))
    with open(index, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path, index


@query(f"SELECT p_partkey AS id, {_TITLE} AS title FROM part")
def dump_titles(spark: SparkSession, sf: str) -> DataFrame:
    return dump.title_index(spark, "file://" + _dump(spark, sf)[1]).select("id", "title")


@query(f"SELECT p_partkey AS id, {_TITLE} AS title, 'wikitext' AS model, 'Size ' || p_size || ' < & >' AS body, CASE WHEN p_size = 1 THEN 'Ones' END AS redirect FROM part")
def dump_articles(spark: SparkSession, sf: str) -> DataFrame:
    return dump.articles(spark, *_dump(spark, sf)).drop("offset")


@query(f"SELECT s_suppkey, p_partkey AS id, 'Size ' || p_size || ' < & >' AS body FROM supplier JOIN part ON p_partkey = s_suppkey * 7")
def dump_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The article of each supplier's page title, by a join of titles."""
    pages = dump.articles(spark, *_dump(spark, sf))
    parts = table(spark, sf, "part").select((F.col("p_partkey") / 7).alias("of"), F.expr(_TITLE).alias("wanted"))
    wanted = table(spark, sf, "supplier").join(parts, F.col("of") == F.col("s_suppkey")).select("s_suppkey", "wanted")
    found = search.lookup(wanted, pages, "wanted")
    return found.join(wanted, F.col("title") == F.col("wanted")).select("s_suppkey", "id", "body")
