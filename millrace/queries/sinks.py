"""Colours, SVG and HTML of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import colors
from millrace.queries import query, table
from millrace.queries.extract import _filled
from millrace.sinks import html, svg


def _sql_hex(*parts: str) -> str:
    return "'#' || " + " || ".join(f"printf('%02x', CAST(round(least(greatest({p}, 0), 1) * 255) AS BIGINT))" for p in parts)


_LINEAR = ["3.2404542 * x - 1.5371385 * y - 0.4985314 * z", "-0.969266 * x + 1.8760108 * y + 0.041556 * z", "0.0556434 * x - 0.2040259 * y + 1.0572252 * z"]
_GAMMA = "CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE pow(greatest({0}, 0), 1 / 2.4) * 1.055 - 0.055 END"
_CUBE = "CASE WHEN {0} > 6.0 / 29 THEN pow({0}, 3) ELSE 3 * pow(6.0 / 29, 2) * ({0} - 4.0 / 29) END"


@query(f"""
WITH p AS (SELECT p_partkey, p_size, CAST(p_partkey * 7 % 360 AS DOUBLE) AS h, p_size / 60.0 AS s, 0.25 + p_partkey % 10 / 20.0 AS l FROM part),
q AS (SELECT *, s * least(l, 1 - l) AS a, (p_size + 30 + 16) / 116.0 AS fy, radians(h) AS t FROM p),
k AS (SELECT *, (h / 30) % 12 AS k0, (h / 30 + 8) % 12 AS k8, (h / 30 + 4) % 12 AS k4, fy + (p_size - 25) / 500.0 AS fx, fy - (20 - p_size) / 200.0 AS fz, fy + p_size * cos(t) / 500 AS gx, fy - p_size * sin(t) / 200 AS gz FROM q),
c AS (SELECT *, ({_CUBE.format('fx')}) * 0.95047 AS x, ({_CUBE.format('fy')}) AS y, ({_CUBE.format('fz')}) * 1.08883 AS z FROM k),
d AS (SELECT *, {', '.join(f'{e} AS l{i}' for i, e in enumerate(_LINEAR))} FROM c),
e AS (SELECT * EXCLUDE (x, z), ({_CUBE.format('gx')}) * 0.95047 AS x, ({_CUBE.format('gz')}) * 1.08883 AS z FROM d),
f AS (SELECT *, {', '.join(f'{e} AS m{i}' for i, e in enumerate(_LINEAR))} FROM e)
SELECT p_partkey, {_sql_hex('p_size * 5 / 255.0', 'p_partkey % 256 / 255.0', '128 / 255.0')} AS rgb, {_sql_hex(*[f'l - a * greatest(-1, least({k} - 3, 9 - {k}, 1))' for k in ('k0', 'k8', 'k4')])} AS hsl,
  {_sql_hex(*[_GAMMA.format(f'l{i}') for i in range(3)])} AS lab, {_sql_hex(*[_GAMMA.format(f'm{i}') for i in range(3)])} AS hcl FROM f
""")
def color_spaces(spark: SparkSession, sf: str) -> DataFrame:
    """A colour a part in each space."""
    size, h = F.col("p_size"), F.col("p_partkey") * 7 % 360
    values = {"rgb": {"r": size * 5, "g": F.col("p_partkey") % 256, "b": None}, "hsl": {"h": h, "s": size / 60, "l": 0.25 + F.col("p_partkey") % 10 / 20}, "lab": {"l": size + 30, "a": size - 25, "b": 20 - size}, "hcl": {"h": h, "c": size, "l": size + 30}}
    return table(spark, sf, "part").select("p_partkey", *[colors.of(v).alias(n) for n, v in values.items()])


_NUMBER = "regexp_replace(printf('%.3f', CAST({} AS DOUBLE)), '\\.?0+$', '')"


@query(f"""
SELECT n_nationkey, '<rect x="' || n_nationkey * 10 || '" y="' || {_NUMBER.format('100 - n_regionkey * 12.5')} || '" width="8" height="' || {_NUMBER.format('n_regionkey * 12.5')} || '" fill="#1f77b4" />' AS rect,
  '<text x="' || n_nationkey * 10 || '" y="0">' || n_name || ' &amp; &lt;co&gt;</text>' AS label, '<line x1="0" y1="' || n_nationkey || '" x2="50" y2="' || n_nationkey || '" stroke="black" />' AS rule FROM nation
""")
def svg_elements(spark: SparkSession, sf: str) -> DataFrame:
    """A bar, a label and a rule a nation."""
    n, key = table(spark, sf, "nation"), F.col("n_nationkey")
    bars = n.select("n_nationkey", (key * 10).alias("x"), (100 - F.col("n_regionkey") * 12.5).alias("y"), F.lit(8).alias("width"), (F.col("n_regionkey") * 12.5).alias("height"), F.lit("#1f77b4").alias("fill"))
    labels = n.select("n_nationkey", (key * 10).alias("x"), F.concat("n_name", F.lit(" & <co>")).alias("text"))
    rules = n.select("n_nationkey", F.lit(0).alias("x"), key.alias("y"), F.lit(50).alias("x2"), F.lit("black").alias("stroke"))
    out = None
    for df, kind, name in ((bars, "rect", "rect"), (labels, "text", "label"), (rules, "rule", "rule")):
        own = svg.elements(df, kind, name).select("n_nationkey", name)
        out = own if out is None else out.join(own, "n_nationkey")
    return out


@query("""
WITH p AS (SELECT s_nationkey, string_agg(s_suppkey || ',' || s_suppkey % 7, 'L' ORDER BY s_suppkey) AS there, string_agg(s_suppkey || ',' || (s_suppkey % 7 + 1), 'L' ORDER BY s_suppkey DESC) AS back FROM supplier GROUP BY ALL)
SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="300" height="100">' || string_agg('<path d="M' || there || '" fill="none" />', '' ORDER BY s_nationkey) || '</svg>' AS lines,
  '<svg xmlns="http://www.w3.org/2000/svg" width="300" height="100">' || string_agg('<path d="M' || there || 'L' || back || 'Z" />', '' ORDER BY s_nationkey) || '</svg>' AS areas FROM p
""")
def svg_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Two charts: a line and an area a nation through its suppliers."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select("s_nationkey", k.alias("x"), (k % 7).alias("y"), (k % 7 + 1).alias("y2"))
    charts = [svg.document(svg.paths(s, ["s_nationkey"], "x", kind), "s_nationkey", 300, 100).withColumnRenamed("svg", name) for kind, name in (("line", "lines"), ("area", "areas"))]
    return charts[0].crossJoin(charts[1])  # one row each


_HTML = """\
'''{p_name}''' is ''of {p_type}'' & [[Brand|the {p_brand}]]s.<ref>List {p_partkey}</ref>
Next line of [https://shop.example/{p_partkey} Shop]<ref>Two</ref>.

== Size ==
* one
** of {p_size}
* two
# first
{| class="x"
! A !! B
|-
| {p_size} || [[C]]
|}
----
End &eacute; <nowiki>[[no]]</nowiki>"""


@query("""
SELECT p_partkey AS page_id, '<p><b>' || p_name || '</b> is <i>of ' || p_type || '</i> &amp; <a href="/wiki/Brand">the ' || p_brand || 's</a>.<sup>[1]</sup> Next line of <a href="https://shop.example/' || p_partkey || '">Shop</a><sup>[2]</sup>.</p>'
  || '<h2>Size</h2><ul><li>one<ul><li>of ' || p_size || '</li></ul></li><li>two</li></ul><ol><li>first</li></ol><table><tr><th>A</th><th>B</th></tr><tr><td>' || p_size || '</td><td><a href="/wiki/C">C</a></td></tr></table><hr /><p>End é [[no]]</p>'
  || '<ol><li>List ' || p_partkey || '</li><li>Two</li></ol>' AS html FROM part
""")
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a part with each kind of block."""
    return html.render(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), _filled(_HTML).alias("text")))
