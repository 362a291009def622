"""Tables out of wiki pages: links, categories, headings, references, templates, text and more.

Each extractor takes pages (page_id, text) and gives a row a find, in Arrow batches of whole pages: the
markup nests, so this is a parser's work, but a page is all the parser ever sees."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.markup.tokens import REDIRECT, Token, plain_text, tokenize

CATEGORY = r"(?:category|kategorie|catégorie|categoría)"
FILE = r"(?:file|image|datei|fichier|archivo)"


def _table(pages: DataFrame, find: Callable[[str], Iterator[tuple]], schema: str, id_column: str, text_column: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, at, *r) for i, text in zip(batch[id_column], batch[text_column], strict=True) if isinstance(text, str) for at, r in enumerate(find(text))]
            yield pd.DataFrame(rows, columns=["page_id", "at", *names])

    return pages.select(id_column, text_column).mapInPandas(run, f"page_id {kind}, at int, {schema}")


def _walk(text: str) -> Iterator[tuple[Token, str]]:
    """All tokens with their text, those inside templates, tags and links too."""
    for t in tokenize(text):
        yield t, text
        inner: list[str] = []
        if t.kind == "template":
            inner = [v for _, v, _ in t.data["arguments"]]
        elif t.kind == "link":
            inner = t.data["content"]
        elif t.kind == "extension" and t.data["name"] in ("ref", "poem", "gallery", "indicator") and t.data["body"]:
            inner = [t.data["body"]]
        elif t.kind == "heading":
            inner = [t.data["content"]]
        for x in inner:
            yield from _walk(x)


def links(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, target, caption, fragment) of page links; categories and files only if a colon leads."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "link":
                target = t.data["target"]
                if re.match(rf"(?i)(?:{CATEGORY}|{FILE})\s*:", target):
                    continue
                target = target.lstrip(":").strip()
                name, _, fragment = target.partition("#")
                shown = plain_text(t.data["content"][-1]) if t.data["content"] else target
                yield name.strip().replace("_", " "), shown + t.data["trail"], fragment or None

    return _table(pages, find, "target string, caption string, fragment string", id_column, text_column)


def external_links(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, kind, target, caption): bracketed, bare, RFC, PMID and ISBN."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "extlink":
                yield "external", t.data["target"], plain_text(t.data["content"]) if t.data["content"] else None
            elif t.kind == "autolink":
                yield t.data["type"], t.data["target"], None

    return _table(pages, find, "kind string, target string, caption string", id_column, text_column)


def categories(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, category, sort_key), distinct by page."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "link" and (m := re.match(rf"(?i){CATEGORY}\s*:\s*(.+)$", t.data["target"])):
                name = re.sub(r"[ _]+", " ", m[1]).strip()
                yield name[:1].upper() + name[1:], t.data["content"][0].strip() if t.data["content"] else None

    found = _table(pages, find, "category string, sort_key string", id_column, text_column)
    return found.groupBy("page_id", "category").agg(F.max_by("sort_key", "at").alias("sort_key"))


def category_sizes(categories_: DataFrame) -> DataFrame:
    """How many pages each category has."""
    return categories_.groupBy("category").agg(F.count(F.lit(1)).alias("pages"))


def anchor(text: str) -> str:
    return re.sub(r"[\s_]+", "_", text.strip())


def headings(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, level, title, anchor)."""

    def find(text: str) -> Iterator[tuple]:
        for t in tokenize(text):
            if t.kind == "heading":
                shown = plain_text(t.data["content"]).strip()
                yield t.data["level"], shown, anchor(shown)

    return _table(pages, find, "level int, title string, anchor string", id_column, text_column)


def references(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, grp, number, name, text, uses): named references merge, numbered by first use in their group."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "extension" and t.data["name"] == "ref":
                a = t.data["attributes"]
                yield a.get("group", ""), a.get("name"), t.data["body"]

    found = _table(pages, find, "grp string, name string, text string", id_column, text_column)
    key = F.coalesce(F.concat(F.lit("n:"), "name"), F.concat(F.lit("a:"), F.col("at").cast("string")))
    found = found.withColumn("key", key).groupBy("page_id", "grp", "key").agg(F.min("at").alias("first"), F.first("name", ignorenulls=True).alias("name"), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("at"))).alias("text"), F.count(F.lit(1)).alias("uses"))
    return found.withColumn("number", F.row_number().over(W.partitionBy("page_id", "grp").orderBy("first"))).select("page_id", "grp", "number", "name", "text", "uses")


def reference_id(n: Column, style: str = "decimal") -> Column:
    """A reference's mark: decimal, lower-alpha, upper-alpha, lower-greek, lower-roman or upper-roman."""
    from millrace.functions.dates import roman

    if style == "decimal":
        return n.cast("string")
    if style.endswith("roman"):
        return F.lower(roman(n)) if style.startswith("lower") else roman(n)
    letters = "αβγδεζηθικλμνξοπρστυφχψω" if "greek" in style else "abcdefghijklmnopqrstuvwxyz"
    k = len(letters)
    alphabet = F.array(*[F.lit(c) for c in letters])
    one = F.element_at(alphabet, (F.pmod(n - 1, F.lit(k)) + 1).cast("int"))
    out = F.when(n <= k, one).otherwise(F.concat(F.element_at(alphabet, F.floor((n - 1) / k).cast("int")), one))
    return F.upper(out) if style.startswith("upper") else out


def templates(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, target, arguments) of transclusions, nested ones too; arguments map names to values."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "template":
                yield t.data["target"], {k: v for k, v, _ in t.data["arguments"]}

    return _table(pages, find, "target string, arguments map<string,string>", id_column, text_column)


def extensions(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, tag, attributes, body) of extension tags."""

    def find(text: str) -> Iterator[tuple]:
        for t, _ in _walk(text):
            if t.kind == "extension":
                yield t.data["name"], t.data["attributes"], t.data["body"]

    return _table(pages, find, "tag string, attributes map<string,string>, body string", id_column, text_column)


def sections(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, label, text) of labelled sections: from a begin tag to its end tag."""

    def find(text: str) -> Iterator[tuple]:
        for m in re.finditer(r'<section\s+begin\s*=\s*"?([^"/>]+?)"?\s*/>(.*?)<section\s+end\s*=\s*"?\1"?\s*/>', text, re.S):
            yield m[1].strip(), m[2]

    return _table(pages, find, "label string, text string", id_column, text_column)


def tokens(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, kind, start, stop, data): the flat token list, payloads as JSON."""

    def find(text: str) -> Iterator[tuple]:
        for t in tokenize(text):
            yield t.kind, t.start, t.end, json.dumps(t.data, ensure_ascii=False)

    return _table(pages, find, "kind string, start int, stop int, data string", id_column, text_column)


def table_cells(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, tbl, row, col, heading, text) of the cells of outermost and nested tables."""

    def find(text: str) -> Iterator[tuple]:
        stack: list[list] = []
        count = 0
        cell: list | None = None
        done: list[tuple] = []
        for t in tokenize(text):
            if t.kind == "table_start":
                stack.append([count, -1, -1])
                count += 1
            elif not stack:
                continue
            elif t.kind == "table_end":
                stack.pop()
                cell = None
            elif t.kind == "table_row":
                stack[-1][1] += 1
                stack[-1][2] = -1
                cell = None
            elif t.kind in ("table_cell", "table_heading"):
                if stack[-1][1] < 0:
                    stack[-1][1] = 0
                stack[-1][2] += 1
                cell = [*stack[-1], t.kind == "table_heading", ""]
                done.append(cell)
            elif t.kind == "table_caption":
                cell = None
            elif cell is not None:
                cell[4] += text[t.start : t.end]
        for c in done:
            yield c[0], c[1], c[2], c[3], plain_text(c[4]).strip()

    return _table(pages, find, "tbl int, row int, col int, heading boolean, text string", id_column, text_column)


def lists(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, at, markers, depth, text) of list items."""

    def find(text: str) -> Iterator[tuple]:
        for line in text.split("\n"):
            if m := re.match(r"([*#:;]+)\s*(.*)$", line):
                yield m[1], len(m[1]), plain_text(m[2]).strip()

    return _table(pages, find, "markers string, depth int, text string", id_column, text_column)


def text(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, text): plain text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(plain_text, na_action="ignore")

    return pages.select(F.col(id_column).alias("page_id"), run(F.col(text_column)).alias("text"))


def redirects(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, target) of redirects; a Column, as redirects are flat."""
    java = r"(?i)^" + REDIRECT.pattern.replace("(#[^\\]|]*)?", "(?:#[^\\]|]*)?")
    return pages.select(F.col(id_column).alias("page_id"), F.trim(F.regexp_extract(text_column, java, 1)).alias("target")).filter("target != ''")


def source_lines(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, line, start, text): line numbers from 1 and byte offsets."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.posexplode(F.split(text_column, "\n", -1)).alias("at", "text"))
    before = W.partitionBy("page_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("page_id", (F.col("at") + 1).alias("line"), F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long").alias("start"), "text")


# --- HTML pages: flat enough for Columns --------------------------------------------------------------


def html_links(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, at, href) of anchors."""
    found = F.regexp_extract_all(F.col(html_column), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(id_column).alias("page_id"), F.posexplode(found).alias("at", "href"))


def html_headings(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, at, level, title)."""
    whole = F.regexp_extract_all(F.col(html_column), F.lit(r"(?s)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = pages.select(F.col(id_column).alias("page_id"), F.posexplode(whole).alias("at", "h"))
    return rows.select("page_id", "at", F.regexp_extract("h", r"<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace("h", r"<[^>]*>", "")).alias("title"))


def html_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, text) without scripts, styles and tags; white space collapses."""
    body = F.regexp_replace(F.col(html_column), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    return pages.select(F.col(id_column).alias("page_id"), F.trim(F.regexp_replace(body, r"[ \t\n\r]+", " ")).alias("text"))
