import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, infix, text, titles
from millrace.markup import tokens
from millrace.operators import scales, ticks, transforms

NOW = dt.datetime(2008, 7, 1, 10, 20, 30, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(("source", "want"), [
    ("2008-07-01T22:35:17", "2008-07-01 22:35:17"), ("20080701T22:35:17", "2008-07-01 22:35:17"), ("@1215282385", "2008-07-05 18:26:25"), ("10/Oct/2000:13:55:36 -0700", "2000-10-10 20:55:36"), ("2008:08:07 18:11:31", "2008-08-07 18:11:31"),
    ("30 June 2008", "2008-06-30 00:00:00"), ("June 2008", "2008-06-01 00:00:00"), ("June 30, 2008", "2008-06-30 00:00:00"), ("5/17/2006", "2006-05-17 00:00:00"), ("2008/6/30", "2008-06-30 00:00:00"), ("30.6.2008", "2008-06-30 00:00:00"), ("2008-W28-3", "2008-07-09 00:00:00"), ("2008W273", "2008-07-02 00:00:00"), ("2008.197", "2008-07-15 00:00:00"),
    ("yesterday noon", "2008-06-30 12:00:00"), ("tomorrow", "2008-07-02 00:00:00"), ("+1 week 2 days", "2008-07-10 10:20:30"), ("3 days ago", "2008-06-28 10:20:30"), ("next month", "2008-08-01 10:20:30"), ("last day of february 2008", "2008-02-29 00:00:00"), ("first monday of january 2009", "2009-01-05 00:00:00"), ("monday", "2008-07-07 00:00:00"), ("last friday", "2008-06-27 00:00:00"),
    ("back of 7pm", "2008-07-01 19:15:00"), ("front of 5am", "2008-07-01 04:45:00"), ("4pm + 2 hours", "2008-07-01 18:00:00"), ("2008-07-01 22:35:17 +0200", "2008-07-01 20:35:17"), ("1 July 2008 12:00 EST", "2008-07-01 17:00:00"), ("31 january 2008 +1 month", "2008-03-02 00:00:00"), ("now", "2008-07-01 10:20:30"), ("+5 weekdays", "2008-07-08 10:20:30"),
])
def test_free_text_dates(source, want):
    assert dates.parse_time(source, NOW).strftime("%Y-%m-%d %H:%M:%S") == want


@pytest.mark.parametrize(("source", "want"), [
    ("1 monday", "2021-03-15 10:30:00"), ("1 wednesday", "2021-03-10 10:30:00"), ("2 wednesday", "2021-03-17 10:30:00"), ("2 sundays ago", "2021-02-28 10:30:00"), ("last saturday ago", "2021-03-13 00:00:00"), ("third friday ago", "2021-02-19 00:00:00"),
    ("this week", "2021-03-08 10:30:00"), ("next week", "2021-03-15 10:30:00"), ("this week tuesday", "2021-03-09 00:00:00"), ("sunday last week", "2021-03-07 00:00:00"), ("previous week friday", "2021-03-05 00:00:00"),
    ("october", "2021-10-10 10:30:00"), ("eight weekday", "2021-03-22 10:30:00"), ("2021-03-13 this weekday", "2021-03-15 00:00:00"), ("@86400 +0200", "1970-01-02 00:00:00"), ("Mon, 01 Mar 2021 08:00:00 +0000 +30 days", "2021-03-31 08:00:00"),
])
def test_relative_dates(source, want):
    """Counted weekdays begin today, weeks begin on Monday, weekdays are found before other steps are made. Now is a Wednesday."""
    now = dt.datetime(2021, 3, 10, 10, 30, tzinfo=dt.timezone.utc)
    assert dates.parse_time(source, now).strftime("%Y-%m-%d %H:%M:%S") == want


@pytest.mark.parametrize("source", ["foo bar", "2008-13-45x", "32nd of never"])
def test_unreadable_dates(source):
    assert dates.parse_time(source, NOW) is None


@pytest.mark.parametrize(("source", "want"), [
    ("1+2*3", 7), ("(1+2)*3", 9), ("2^3^2", 64), ("-2^2", 4), ("7 mod 3", 1), ("-7 mod 3", -1), ("5 fmod 3", 2), ("1/4", 0.25), ("3 = 3", 1), ("1 <> 2", 1), ("2 >= 3", 0), ("not 0", 1), ("1 and 0", 0), ("1 or 0", 1), ("3.14159 round 2", 3.14), ("1e3", 1000), ("1.5e-1", 0.15), ("pi", math.pi), ("sqrt 16", 4), ("abs -3", 3), ("floor -1.5", -2), ("trunc -1.5", -1), ("ceil 1.2", 2), ("ln exp 2", 2), ("cos 0", 1), ("2 * pi", 2 * math.pi), ("1 − 3", -2),
])
def test_infix(source, want):
    assert infix.evaluate(source) == pytest.approx(want)


@pytest.mark.parametrize("source", ["1/0", "1 mod 0", "sqrt -1", "ln 0", "asin 2", "1 +", "(1", "1)", "foo", "1 2", "* 2", "%"])
def test_infix_errors(source):
    with pytest.raises(infix.InfixError):
        infix.evaluate(source)


def test_infix_columns_agree(spark):
    df = spark.createDataFrame([(5.5, 2.0), (-7.25, 3.0), (0.0, 1.0)], "a double, b double")
    for source in ["a + b * 2", "a mod b", "a fmod b", "a ^ b", "a round 1", "a > b and not b", "abs a / b", "trunc a"]:
        got = [r[0] for r in df.select(infix.compiled(source, a=F.col("a"), b=F.col("b"))).collect()]
        want = [infix.evaluate(_fill(source, r.a, r.b)) for r in df.collect()]
        assert got == pytest.approx(want), source


def _fill(source, a, b):
    out = []
    for w in source.split(" "):
        out.append({"a": f"({a})", "b": f"({b})"}.get(w, w))
    return " ".join(out)


def test_text(spark):
    x = F.lit
    row = spark.range(1).select(
        text.padleft(x("7"), 3).alias("a"), text.padleft(x("12345"), 3).alias("b"), text.titleparts(x("a/b/c"), 2, 2).alias("c"), text.urlencode(x("a b/ü"), "QUERY").alias("d"), text.urlencode(x("a b/c"), "WIKI").alias("e"),
        text.entities(x("&lt;a&gt; &amp;amp; &eacute; &#65; &nope; &amp")).alias("f"), text.strtr(x("hi all"), {"hi": "bye", "h": "-"}).alias("g"), text.lua_gsub(x("a1b22"), "%d+", "<%0>").alias("h"), text.lua_match(x("key = val"), "(%w+) = (%w+)").alias("i"),
        text.list_to_text(F.array(x("a"), x("b"), x("c"))).alias("j"), text.truncate(x("abcdef"), 3).alias("k"), text.normalised(x("é")).alias("l"), text.bit("bnot", x(0)).alias("m"), text.message("$1 of $2", x("a"), x(2)).alias("n"), text.iferror(x('<strong class="error">x</strong>'), x("bad"), x("ok")).alias("o"),
    ).first()
    assert list(row) == ["007", "12345", "b/c", "a+b%2F%C3%BC", "a_b/c", "<a> &amp; é A &nope; &amp", "bye all", "a<1>b<22>", "key", "a, b and c", "abc…", "é", 4294967295, "a of 2", "bad"]


def test_titles(spark):
    t = titles.parse_title(F.lit(" help_:  foo_bar/baz#Sec tion "))
    row = spark.range(1).select(t.alias("t")).select("t.*", titles.prefixed(F.col("t")).alias("full"), titles.key(F.col("t")).alias("key"), titles.base(F.col("t")).alias("base"), titles.talk(F.col("t")).alias("talk"), titles.root(F.col("t")).alias("root"), titles.words("fullpagenamee", F.col("t")).alias("e")).first()
    assert (row.ns, row.text, row.fragment, row.full, row.key, row.base, row.talk, row.root, row.e) == (12, "Foo bar/baz", "Sec tion", "Help:Foo bar/baz", "Help:Foo_bar/baz", "Foo bar", "Help talk:Foo bar/baz", "Foo bar", "Help:Foo_bar/baz")
    row = spark.range(1).select(*[titles.joined(F.lit("A/B"), F.lit(x)).alias(f"c{i}") for i, x in enumerate(["/c", "../", "../d", "x"])]).first()
    assert list(row) == ["A/B/c", "A", "A/d", "x"]


def test_ticks():
    assert ticks.linear_ticks(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert ticks.linear_ticks(0, 1, 4) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert ticks.nice(1.1, 10.9, 10) == (1, 11)
    assert ticks.log_ticks(1, 100)[0] == 1 and ticks.log_ticks(1, 100)[-1] == 100
    day = 86_400_000.0
    assert ticks.time_ticks(0, 4 * day, 4) == [0, day, 2 * day, 3 * day, 4 * day]


def test_bins():
    assert transforms.bin_options(0, 100, maxbins=20) == (0, 5)
    assert transforms.bin_options(1, 50, maxbins=10) == (0, 5)
    assert transforms.bin_options(0, 1, maxbins=20) == pytest.approx((0, 0.05))
    assert transforms.bin_options(3, 3) == (3, 1.0)


def test_scales():
    assert scales.bands(4, 0, 100, 0.2, 0.1, rounded=True)[1] == 20.0
    assert scales.points(3, 0, 10) == [0, 5, 10]
    assert scales.quantize(0, 10, ["a", "b"]).of(5) == "b"


def test_tokens():
    kinds = [t.kind for t in tokens.tokenize("== H ==\n* [[a|b]]s {{t|x={{u}}|y}} {{{p|d}}} <ref name=x>r</ref> https://e.org/a. ISBN 978-0-306-40615-7\n{|\n|-\n| a || b\n|}")]
    for k in ("heading", "list", "link", "template", "parameter", "extension", "autolink", "table_start", "table_row", "table_cell", "table_end"):
        assert k in kinds, k
    assert tokens.plain_text("'''Bold''' [[A|text]]s [https://x y] {{t}} &amp; <!-- c --><nowiki>[[n]]</nowiki>") == "Bold texts y  & [[n]]"
    spans = tokens.brace_spans("{{a|{{{b}}}}}")
    assert spans == {4: (11, 3), 0: (13, 2)}
    assert tokens.included("a<noinclude>b</noinclude><includeonly>c</includeonly>", True) == "ac"
    assert tokens.included("a<noinclude>b</noinclude><includeonly>c</includeonly>", False) == "ab"


def test_sections():
    from millrace.markup import sections

    page = 'a<section begin="x" />one<section end="x" />b<section begin=x/>two<section end=x/>c\n== H ==\nin h\n=== Sub ===\ndeep\n== Next ==\nout'
    assert sections.labelled(page, "x") == "onetwo"
    assert sections.unlabelled(page, "x", "-").startswith("a-b-c")
    assert sections.under_heading(page, "h") == "in h\n=== Sub ===\ndeep"
    assert sections.under_heading(page, "H", "Sub") == "in h"
    assert sections.under_heading(page, "none") == ""


def test_uris_and_zones(spark):
    from millrace.functions import uri

    row = spark.range(1).select(
        uri.parts(F.lit("https://u@example.org:81/a/b?x=1&y=a%20b#f")).alias("p"), uri.valid(F.lit("http://e.org/x")).alias("v"), uri.query_map(F.lit("x=1&y=a%20b&x=2&z")).alias("q"), uri.build_query({"a": F.lit("b c"), "n": F.lit(1)}).alias("b"),
        dates.in_zone(F.lit("2024-07-01 12:00:00").cast("timestamp"), "Europe/Berlin").cast("string").alias("z"), dates.is_dst(F.lit("2024-07-01").cast("timestamp"), "Europe/Berlin").alias("d"), dates.is_dst(F.lit("2024-01-05").cast("timestamp"), "Europe/Berlin").alias("e"),
        dates.auto_format(F.lit("2024-03-01").cast("timestamp")).alias("f"), dates.auto_format(F.lit("2024-01-01").cast("timestamp")).alias("g"),
    ).first()
    assert (row.p.protocol, row.p.user, row.p.host, row.p.port, row.p.path, row.p.query, row.p.fragment) == ("https", "u", "example.org", "81", "/a/b", "x=1&y=a%20b", "f")
    assert row.v and row.q == {"x": "2", "y": "a b", "z": ""} and row.b == "a=b+c&n=1"
    assert (row.z, row.d, row.e, row.f, row.g) == ("2024-07-01 14:00:00", True, False, "March", "2024")
