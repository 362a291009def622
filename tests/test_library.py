"""Operators beyond the registered queries: spec, formats, dump, layouts, expansion, streams."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from millrace.layout import geo, graphs, timeline, treemap, words
from millrace.markup import expand, extract
from millrace.operators import transforms as t
from millrace.operators.aggregates import ORDER, aggregate
from millrace.plans.spec import Spec, SpecError
from millrace.sources import dump, formats, search, topology
from millrace.streaming import events


def test_spec_graph(spark):
    sales = [("north", "tea", 12), ("north", "salt", 30), ("south", "tea", 45), ("south", "salt", 15), ("west", "tea", 8)]
    spec = Spec(json.dumps({
        "version": 2, "width": 300, "height": 50,
        "data": [
            {"name": "sales", "values": [{"place": p, "good": g, "tons": n} for p, g, n in sales]},
            {"name": "sums", "source": "sales", "transform": [{"type": "aggregate", "groupby": ["place"], "summarize": [{"field": "tons", "ops": ["sum"]}]}]},
        ],
        "scales": [{"name": "across", "type": "ordinal", "range": "width", "domain": {"data": "sales", "field": "place"}}, {"name": "up", "type": "linear", "range": "height", "zero": True, "domain": {"data": "sums", "field": "sum_tons"}}, {"name": "ink", "type": "ordinal", "range": "category10", "domain": {"data": "sales", "field": "good"}}],
        "predicates": [{"name": "heavy", "type": ">", "operands": [{"arg": "n"}, 20]}],
    }), spark)
    assert {r.place: r.sum_tons for r in spec.dataset("sums").collect()} == {"north": 42.0, "south": 60.0, "west": 8.0}
    mark = {"from": {"data": "sales", "transform": [{"type": "stack", "groupby": ["place"], "sortby": ["good"], "field": "tons"}]}, "properties": {"enter": {"x": {"scale": "across", "field": "place"}, "width": {"scale": "across", "band": True}, "y": {"scale": "up", "field": "layout_start"}, "y2": {"scale": "up", "field": "layout_end"}, "fill": {"scale": "ink", "field": "good"}, "opacity": [{"predicate": "heavy", "input": {"n": "tons"}, "value": 0.9}, {"value": 0.3}]}}}
    rows = spec.mark(mark).orderBy(ORDER).collect()
    assert [r.x for r in rows] == [0, 0, 100, 100, 200] and {r.width for r in rows} == {100.0}
    assert [r.fill for r in rows] == ["#1f77b4", "#ff7f0e", "#1f77b4", "#ff7f0e", "#1f77b4"] and [r.opacity for r in rows] == [0.3, 0.9, 0.9, 0.3, 0.3]
    # Salt lies below tea: the first place's tea begins at 30 of 60, upside down in 50 pixels.
    assert rows[0].y == pytest.approx(50 - 50 * 30 / 60) and rows[0].height == pytest.approx(50 * 12 / 60)
    with pytest.raises(SpecError):
        Spec({"data": [{"name": "a", "source": "b"}, {"name": "b", "source": "a"}]}, spark)
    with pytest.raises(SpecError):
        Spec({"version": 1}, spark)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_sums_with_other_columns(spark, adaptive):
    """Rows that carry columns beside the keys, ties and nulls among the keys: no row is lost, none numbered twice."""
    n = 200_000
    keys = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("u"), (F.col("id") % 97).cast("double").alias("v"), F.repeat(F.lit("p"), 50).alias("payload"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
        ranked = t.rank(df, ["u"])
        assert ranked.filter("rank = u").count() == n and ranked.columns == ["u", "v", "payload", "g", "rank"]
        tied = t.rank(df, ["v"]).groupBy("v").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("n")).orderBy("v").collect()
        assert tied[0].lo == 0 and tied[-1].hi == n - 1 and all(r.hi - r.lo + 1 == r.n for r in tied)
        stacked = t.stack(df, "v", ["g"], ["u"]).groupBy("g").agg(F.count("*").alias("n"), F.max("layout_end").alias("top"), F.sum("v").alias("sum"), F.sum(F.col("layout_end") - F.col("layout_start")).alias("sizes"))
        got = stacked.collect()
        assert sum(r.n for r in got) == n and all(r.top == r.sum == r.sizes for r in got)
        pie = t.pie(t.with_order(df, "u"), "v").agg(F.count("*"), F.max("layout_end")).first()
        assert pie[0] == n and pie[1] == pytest.approx(2 * 3.141592653589793)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_impute_by_means(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 5.0)], "g string, k int, v double")  # a null group is a group
    got = {(r.g, r.k): r.v for r in t.impute(df, "v", ["k"], ["g"], "mean").collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 4.0, (None, 1): 5.0, (None, 2): 5.0}
    assert [r.v for r in t.impute(df.drop("g"), "v", ["k"], method="max").collect()].count(None) == 0


def test_formats(spark, tmp_path):
    rows = formats.inline(spark, [1, {"data": 2, "s": "x"}, None and {}, [3]][:2])
    assert [(r.data, r.s) for r in rows.orderBy(ORDER).collect()] == [(1.0, None), (2.0, "x")]
    typed = formats.typed_fields(formats.inline(spark, [{"d": "2000-01-02", "n": "5", "b": "true"}, {"d": "zzz", "n": "x", "b": None}]), {"d": "date", "n": "number", "b": "boolean"}).orderBy(ORDER).collect()
    assert typed[0].d == 946771200000.0 and typed[0].n == 5.0 and typed[0].b is True and typed[1].d != typed[1].d and typed[1].n is None
    (tmp_path / "a.tsv").write_text("k\tv\n1\t2\n")
    assert formats.read(spark, f"{tmp_path}/a.tsv", "tsv", {"v": "number"}).first().v == 2.0
    topo = {"type": "Topology", "transform": {"scale": [1, 1], "translate": [0, 0]}, "arcs": [[[0, 0], [1, 0], [0, 1]], [[1, 1], [-1, 0], [0, -1]]], "objects": {"o": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": 7, "arcs": [[0, 1]]}]}}}
    f = topology.features(spark, topo, "o").first()
    assert json.loads(f.geometry)["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]] and f.id == "7"
    assert topology.mesh(topo, "o")["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    assert [(r.x, r.y) for r in topology.arcs(spark, topo).filter("arc = 0").orderBy("at").collect()] == [(0, 0), (1, 0), (1, 1)]


def make_dump(folder):
    page = lambda i, title, text, extra="": f"<page><title>{title}</title><ns>0</ns><id>{i}</id>{extra}<revision><id>1</id><model>wikitext</model><text>{text}</text></revision></page>"
    head = '<mediawiki xmlns="x"><siteinfo><sitename>Test</sitename><namespaces><namespace key="0" case="first-letter" /><namespace key="14" case="first-letter">Category</namespace></namespaces></siteinfo>'
    streams = [[page(1, "A &amp; B", "one [[C]]"), page(2, "C", "two")], [page(3, "R", "#REDIRECT [[C]]", '<redirect title="C" />')]]
    out, index = bz2.compress(head.encode()), []
    for s in streams:
        index += [(len(out), p) for p in s]
        out += bz2.compress("".join(s).encode())
    path, idx = folder / "20240102-multistream.xml.bz2", folder / "index.txt"
    path.write_bytes(out)
    ids = iter([(1, "A &amp; B"), (2, "C"), (3, "R")])
    idx.write_text("".join(f"{o}:{i}:{t}\n" for (o, _), (i, t) in zip(index, ids, strict=True)))
    return str(path), str(idx)


def test_dump(spark, tmp_path):
    path, index = make_dump(tmp_path)
    assert dump.header(path)["site_name"] == "Test" and dump.header(path)["creation_date"] == "20240102"
    assert {r.name for r in dump.namespaces(spark, path).collect()} == {"", "Category"}
    titles = dump.title_index(spark, index)
    assert sorted(r.title for r in titles.collect()) == ["A & B", "C", "R"]
    pages = dump.articles(spark, path, index)
    got = {r.title: (r.id, r.body, r.redirect) for r in pages.collect()}
    assert got == {"A & B": (1, "one [[C]]", None), "C": (2, "two", None), "R": (3, "#REDIRECT [[C]]", "C")}
    assert [r.body for r in dump.get_articles(spark, path, index, ["A & B"]).collect()] == ["one [[C]]"]
    redirects = pages.filter("redirect is not null").select("title", F.col("redirect").alias("target"))
    assert {r.title: r.resolved for r in search.resolve(titles.select("title"), redirects).collect()} == {"A & B": "A & B", "C": "C", "R": "C"}
    links = extract.links(pages.select(F.col("id").alias("page_id"), F.col("body").alias("text")))
    assert {(r.page_id, r.target, r.exists) for r in search.exists(links, titles).collect()} == {(1, "C", True)}
    (tmp_path / "bad.txt").write_text("nope\n")
    with pytest.raises(Exception, match="bad index line"):
        dump.title_index(spark, f"{tmp_path}/bad.txt").collect()


def test_expansion(spark):
    library = spark.createDataFrame([("Template:A", "[{{{1|none}}}:{{{x|}}}]"), ("Template:B", "{{A|{{{1}}}|x={{uc:{{{2}}}}}}}"), ("Template:Loop", "{{Loop}}"), ("Template:Sw", "{{#switch:{{{1}}}|a|b=AB|c=C|#default=D}}")], "title string, text string")
    cases = {"p1": ("{{B|q|r}}", "[q:R]"), "p2": ("{{A}}", "[none:]"), "p3": ("{{Sw|a}}{{Sw|c}}{{Sw|z}}", "ABCD"), "p4": ("{{Nope}}", "[[:Template:Nope]]"), "p5": ("{{#ifexpr: 1 > 2|y|n}}{{#ifeq:01|1|same|not}}{{lc:ABC}}{{!}}", "nsameabc|"), "p6": ("{{PAGENAME}} {{#expr: 1/0}}", 'p6 <strong class="error">Expression error: division by zero</strong>')}
    got = {r.title: r.text for r in expand.expand(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "title string, text string"), library).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_expansion_paths(spark):
    """Loops end at once however wide they are; existence, time, page and site words are reached from calls."""
    import datetime as dt

    loop = lambda t: f'<strong class="error">Template loop: [[Template:{t}]]</strong>'
    library = spark.createDataFrame([("Template:A", "x{{A}}{{A}}"), ("Template:B", "b{{C}}"), ("Template:C", "c{{B}}"), ("Template:Twice", "{{{1}}}{{{1}}}"), ("Template:Row", "* item"), ("Template:Self", "s{{:Own}}"), ("Template:Deep", "d{{B}}{{Row}}"), ("Own", "o{{Self}}"), ("Talk:Page/sub", "")], "title string, text string")
    cases = {
        "p1": ("{{A}}", f"x{loop('A')}{loop('A')}"),
        "p2": ("{{B}}{{C}}", f"bc{loop('B')}cb{loop('C')}"),
        "p3": ("{{Twice|{{Twice|{{Twice|z}}}}}}", "z" * 8),
        "p4": ("a{{Row}}\n{{Row}}", "a\n* item\n* item"),
        "p5": ("{{#ifexist:Own|yes|no}}{{#ifexist:nowhere|yes|{{lc:NO}}}}{{#ifexist:Talk:Page/sub|talk}}", "yesnotalk"),
        "Own": ("o{{Self}}", f"oso{loop('Self')}"),
        "Talk:Page/sub": ("{{PAGENAME}} {{NAMESPACE}} {{NAMESPACENUMBER}} {{SUBJECTPAGENAME}} {{TALKPAGENAME:Own}} {{SUBPAGENAME}} {{BASEPAGENAME}} {{TALKSPACE}}", "Page/sub Talk 1 Page/sub Talk:Own sub Page Talk"),
        "p6": ("{{CURRENTYEAR}}-{{CURRENTMONTH}}-{{LOCALDAY2}} {{CURRENTDAYNAME}} {{CURRENTWEEK}} {{CURRENTTIMESTAMP}} {{#time:j F Y|2004-02-29}} {{#time:xrY}}", "2021-03-04 Thursday 9 20210304050607 29 February 2004 MMXXI"),
        "p7": ("{{SERVER}} {{localurl:A b}} {{fullurl:A b|x=1}} {{NUMBEROFPAGES}} {{int:hello}}", "//w.example /wiki/A_b //w.example/wiki/A_b?x=1 8 ⧼hello⧽"),
        "p8": ("{{Deep}}", f"dbc{loop('B')}\n* item"),
        "p9": (None, ""),
    }
    pages = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "title string, text string")
    out = expand.expand(pages, library, {"SERVER": "//w.example", "NUMBEROFPAGES": "8"}, clock=dt.datetime(2021, 3, 4, 5, 6, 7))
    got = {r.title: r.text for r in out.collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_layouts(spark):
    boxes = treemap.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4, 1)
    assert sum(w * h for _, _, w, h in boxes) == pytest.approx(24)
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a[0] + a[2] <= b[0] + 1e-9 or b[0] + b[2] <= a[0] + 1e-9 or a[1] + a[3] <= b[1] + 1e-9 or b[1] + b[3] <= a[1] + 1e-9
    p = graphs.simulate(10, [(0, i) for i in range(1, 10)])
    assert abs(p).max() < 5000 and (graphs.simulate(10, [(0, i) for i in range(1, 10)]) == p).all()
    spots = words.place([("alpha", 40, 0), ("beta", 30, 0), ("gamma", 20, 90)], (400, 300))
    assert all(spots)
    import numpy as np

    for name in geo.NAMES:
        raw = geo.CLOSED.get(name) or geo.ITERATIVE[name]
        x, y = raw(geo._Numpy, np.array([-0.8, 0.7]), np.array([0.6, 0.7]), {})
        assert np.isfinite(np.asarray(x, float)).all() and np.isfinite(np.asarray(y, float)).all() or name == "albersUsa", name
    x, y = geo.ITERATIVE["mollweide"](geo._Numpy, np.array([0.5]), np.array([0.8]), {})
    theta = np.arcsin(y / np.sqrt(2))
    assert np.arcsin((2 * theta + np.sin(2 * theta)) / np.pi) == pytest.approx(0.8)
    path = geo.path({"type": "LineString", "coordinates": [[0, 0], [1, 0]]}, "equirectangular", {"scale": 180 / np.pi, "translate": [0, 0]})
    assert path == "M0,0L1,0"
    df = spark.createDataFrame([('{"type": "Point", "coordinates": [10, 20]}',)], "g string")
    assert geo.geopath(df, "g", "mercator").first().layout_path.startswith("M")
    with pytest.raises(timeline.TimelineError):
        timeline.segments(spark, timeline.parse("Period = from:1900 till:1950\nPlotData =\n  bar:a from:1800 till:1910\n"))
    t_ = timeline.parse("Period = from:1900 till:1950\nScaleMajor = unit:year increment:10 start:1900\n")
    assert timeline.scale_marks(t_) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])


def test_cross_with_an_equality_is_a_hash_join(spark):
    a = spark.range(100).withColumn("k", F.col("id") % 7)
    plan = t.cross(a, a, test="datum.a.id == datum.b.k")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_aggregate_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", float("nan"), 1), ("a", None, 2), ("b", 5.0, 3), (None, 2.0, 4)], f"k string, v double, `{ORDER}` long")
    out = {r.k: r for r in aggregate(df, ["k"], {"v": ["count", "valid", "missing", "sum", "median", "variance", "values"]}).collect()}
    assert (out["a"].count_v, out["a"].valid_v, out["a"].missing_v, out["a"].sum_v, out["a"].median_v, out["a"].variance_v) == (3, 1, 1, 1.0, 1.0, 0.0)
    assert out["b"].variance_v == 0.0 and out[None].sum_v == 2.0 and out["b"].values_v == [5.0]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:05:00", "b", 3.0), ("2024-01-01 01:00:00", "z", 0.0)], "t string, k string, v double").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream, "ts", "1 minute", ["k"], F.sum("v").alias("v"), late="5 minutes").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.v) for r in spark.table("windows").collect()} >= {("a", 3.0), ("b", 3.0)}


def test_hierarchy_has_no_last_level(spark):
    """A path deeper than any fixed number of levels, and a cycle."""
    n = 44
    rows = [(f"n{i}", f"n{i - 1}" if i else None, None if i < n - 1 else 3.0) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id string, parent string, v double")
    got = {r.id: (r.depth, r.value) for r in t.hierarchy(nodes, "id", "parent", "v").select("id", "depth", "value").collect()}
    assert got == {f"n{i}": (i, 3.0) for i in range(n)}
    ring = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0), ("leaf", "a", 1.0)], "id string, parent string, v double")
    with pytest.raises(ValueError, match="cycle"):
        t.hierarchy(ring, "id", "parent", "v")


def test_joins_by_order(spark):
    """The last earlier row by key against a plain search: ties, nulls, columns of the same name, gaps of many bins."""
    import random

    from millrace.operators import joins

    r = random.Random(8)
    make = lambda n: [(i, r.choice(["a", "b", None]), r.choice([None, float(r.randrange(0, 5000)), r.random() * 100]), r.randrange(50)) for i in range(n)]
    left, right = make(200), make(150)
    schema = "i int, k string, at double, v int"
    got = joins.asof(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnsRenamed({"v": "w"}), "at", ["k"], ["w", "i"], width=100.0)
    rows = [tuple(x) for x in got.collect()]
    want = []
    for i, k, at, v in left:
        best = max(((b, w, j) for j, q, b, w in right if q == k and b is not None and at is not None and b <= at), default=(None, None, None))
        want.append((i, k, at, v, best[1], best[2]))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_sinks(spark):
    """Markup that isn't closed, empty and null pages; marks without places."""
    from millrace.functions import colors
    from millrace.sinks import html, svg

    cases = {"": "", "'''bold": "<p><b>bold</b></p>", "#a\n##b\n*c": "<ol><li>a<ol><li>b</li></ol></li></ol><ul><li>c</li></ul>", "{|\n|a": "<table><tr><td>a</td></tr></table>", "a<b & \"c\"": '<p>a&lt;b &amp; "c"</p>', ";t\n:d": "<dl><dt>t</dt><dd>d</dd></dl>"}
    for text, want in cases.items():
        assert html.page(text) == want
    pages = spark.createDataFrame([(1, None), (2, "x")], "page_id long, text string")
    assert {r.page_id: r.html for r in html.render(pages).collect()} == {1: None, 2: "<p>x</p>"}
    marks = spark.createDataFrame([(1.5, None), (None, 2.0)], "x double, y double")
    assert [r.svg for r in svg.elements(marks, "symbol").collect()] == ['<circle cx="1.5" cy="0" r="5.642" />', '<circle cx="0" cy="2" r="5.642" />']
    with pytest.raises(ValueError):
        svg.elements(marks, "cube")
    one = spark.range(1).select(colors.hsl(120.0, 1.0, 0.5).alias("a"), colors.lab(100.0, 0.0, 0.0).alias("b"), colors.hcl(None, None, None).alias("c"), colors.rgb(300.0, -5.0, None).alias("d")).first()
    assert tuple(one) == ("#00ff00", "#ffffff", "#777777", "#ff0080")
