"""Extractors on the driver's HTML pages, and on wiki pages written from the driver's tables: one a part, with a
template library of nations and regions. Their SQL finds the answers in the tables, not in the markup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.markup import expand, extract
from millrace.queries import query, table

#: The markup of a part's page, around its columns.
PAGE = """'''{p_name}''' {p_partkey} is of the [[{p_brand}|brand {p_brand}]] and among the [[Type/{p_type}]]s.
== Size ==
It is {p_size}.<ref name="size">Measured {p_size}</ref> It costs<ref>List of {p_partkey}</ref> that much.<ref name="size" /><ref group="n">Note</ref>
=== Part {p_partkey} in ''short'' ===
<nowiki>[[no link]]</nowiki> [https://shop.example/{p_partkey} Shop] and https://parts.example/{p_size}.
{{Infobox|name={p_name}|size = {p_size} |{p_brand}}}
{| class="wikitable"
! Brand !! Size
|-
| {p_brand} || {p_size}
|}
* of {p_type}
** of {p_size}
[[:Category:Unused]][[Category:{p_type}]]
[[Category:size {p_size}|{p_partkey}]]"""


def _filled(pattern: str) -> Column:
    """A pattern with the columns it names in braces."""
    parts = re.split(r"\{(p_\w+)\}", pattern)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("Part "), "p_partkey").alias("title"), _filled(PAGE).alias("text"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.html_links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CAST(regexp_extract(h, '<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')) AS h FROM pages)")
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return extract.html_headings(table(spark, sf, "pages")).select("page_id", "level", "title")


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages
""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.html_text(table(spark, sf, "pages"))


@query("SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return extract.source_lines(table(spark, sf, "documents"), "doc_id").select("page_id", "line", "text")


@query("""
SELECT p_partkey AS page_id, replace(p_brand, '#' || split_part(p_brand, '#', 2), '') AS target, 'brand ' || p_brand AS caption FROM part
UNION ALL SELECT p_partkey, 'Type/' || p_type, 'Type/' || p_type || 's' FROM part UNION ALL SELECT p_partkey, 'Category:Unused', 'Category:Unused' FROM part
""")
def wiki_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.links(_pages(spark, sf)).select("page_id", "target", "caption")


@query("SELECT category, count(DISTINCT p_partkey) AS pages FROM (SELECT p_type AS category, p_partkey FROM part UNION ALL SELECT 'Size ' || p_size, p_partkey FROM part) GROUP BY ALL")
def wiki_categories(spark: SparkSession, sf: str) -> DataFrame:
    return extract.category_sizes(extract.categories(_pages(spark, sf)))


@query("SELECT p_partkey AS page_id, 2::INTEGER AS level, 'Size' AS title, 'Size' AS anchor FROM part UNION ALL SELECT p_partkey, 3, 'Part ' || p_partkey || ' in short', 'Part_' || p_partkey || '_in_short' FROM part")
def wiki_headings(spark: SparkSession, sf: str) -> DataFrame:
    return extract.headings(_pages(spark, sf)).drop("at")


@query("""
SELECT p_partkey AS page_id, '' AS grp, 1::INTEGER AS number, 'size' AS name, 'Measured ' || p_size AS text, 2::BIGINT AS uses FROM part
UNION ALL SELECT p_partkey, '', 2, NULL, 'List of ' || p_partkey, 1 FROM part UNION ALL SELECT p_partkey, 'n', 1, NULL, 'Note', 1 FROM part
""")
def wiki_references(spark: SparkSession, sf: str) -> DataFrame:
    return extract.references(_pages(spark, sf))


@query("SELECT p_partkey AS page_id, 'Infobox' AS target, p_name AS name, p_size::VARCHAR AS size, p_brand AS first FROM part")
def wiki_templates(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda n: F.try_element_at("arguments", F.lit(n))
    return extract.templates(_pages(spark, sf)).select("page_id", "target", own("name").alias("name"), own("size").alias("size"), own("1").alias("first"))


@query("""
SELECT p_partkey AS page_id, "row"::INTEGER AS "row", col::INTEGER AS col, "row" = 0 AS heading, CASE WHEN "row" = 0 THEN (['Brand', 'Size'])[col + 1] WHEN col = 0 THEN p_brand ELSE p_size::VARCHAR END AS text
FROM part, range(2) r("row"), range(2) c(col)
""")
def wiki_tables(spark: SparkSession, sf: str) -> DataFrame:
    return extract.table_cells(_pages(spark, sf)).select("page_id", "row", "col", "heading", "text")


@query("SELECT s_suppkey AS page_id, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0 OR s_suppkey % 2 = 0")
def wiki_redirects(spark: SparkSession, sf: str) -> DataFrame:
    """A page a supplier: every other one and those in debt redirect to their nation, the others say so in their text."""
    both = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    moved = (F.col("s_acctbal") < 0) | (F.col("s_suppkey") % 2 == 0)
    text = F.concat(F.when(moved, F.lit("#REDIRECT [[")).otherwise(F.lit("No #REDIRECT [[")), "n_name", F.lit("]]\n[[Category:Moved]]"))
    return extract.redirects(both.select(F.col("s_suppkey").alias("page_id"), text.alias("text")))


@query("SELECT p_partkey AS page_id, 'external' AS kind, 'https://shop.example/' || p_partkey AS target, 'Shop' AS caption FROM part UNION ALL SELECT p_partkey, 'url', 'https://parts.example/' || p_size, NULL FROM part")
def wiki_external_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.external_links(_pages(spark, sf)).drop("at")


_LOOP = '<strong class="error">Template loop: [[Template:Loop]]</strong>'


@query(f"""
SELECT c_name AS title, c_name || ' of ' || upper(n_name) || ' in ' || r_name || ', ' || c_mktsegment || ': ' || CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END || ' ' || (c_custkey * 3 + 1)
  || CASE WHEN c_nationkey % 5 = 0 THEN ' o{_LOOP}' ELSE ' [[:Template:Missing ' || c_nationkey || ']]' END || ' ' || CASE WHEN c_custkey % 7 < 5 THEN 'region ' || (c_custkey % 7) ELSE 'none' END AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def template_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """A page a customer calls templates of nations, those of regions, by redirects, with arguments, loops and missing ones."""
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    page = F.concat(
        F.lit("{{Nation "), "c_nationkey", F.lit("|{{PAGENAME}}|place={{Segment|"), "c_mktsegment", F.lit("}}}}: {{#ifexpr: "), F.col("c_acctbal").cast("decimal(18,2)"), F.lit(" < 0|owes|has}} {{#expr: "), "c_custkey", F.lit(" * 3 + 1}} {{#switch: "), F.col("c_nationkey") % 5,
        F.lit("|0={{Loop}}|#default={{Missing "), "c_nationkey", F.lit("}}}} {{#ifexist:Template:Region "), F.col("c_custkey") % 7, F.lit("|region "), F.col("c_custkey") % 7, F.lit("|none}}"),
    )
    named = lambda kind, key: F.concat(F.lit(f"Template:{kind} "), key).alias("title")
    library = n.select(named("Nation", "n_nationkey"), F.concat(F.lit("#REDIRECT [[Template:Land "), "n_nationkey", F.lit("]]")).alias("text"))
    library = library.union(n.select(named("Land", "n_nationkey"), F.concat(F.lit("{{{1}}} of {{uc:"), "n_name", F.lit("}} in {{Region "), "n_regionkey", F.lit("}}, {{{place|nowhere}}}<noinclude>{{Missing}}</noinclude>"))))
    library = library.union(r.select(named("Region", "r_regionkey"), F.concat("r_name", F.lit("<noinclude> is a region</noinclude>"))))
    library = library.union(spark.createDataFrame([("Template:Segment", "{{{1}}}"), ("Template:Loop", "o{{Loop}}")], "title string, text string"))
    return expand.expand(c.select(F.col("c_name").alias("title"), page.alias("text")), library)
