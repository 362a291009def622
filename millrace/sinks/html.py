"""Pages as HTML: paragraphs, headings, lists, tables, links, styles and references of expanded markup."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import decode_entities
from millrace.markup.tokens import tokenize

_ITEM = {"*": ("ul", "li"), "#": ("ol", "li"), ":": ("dl", "dd"), ";": ("dl", "dt")}
_STYLE = {"italic": ("<i>", "</i>"), "bold": ("<b>", "</b>"), "bold italic": ("<b><i>", "</i></b>")}


def _href(target: str) -> str:
    return "/wiki/" + html.escape(re.sub(r"\s+", "_", target.lstrip(":").strip()), quote=True)


def inline(text: str, notes: list[str]) -> str:
    """Links, styles and references of a line; the notes of references are added to ``notes``."""
    out: list[str] = []
    open_: list[str] = []
    for t in tokenize(text):
        own = text[t.start : t.end]
        if t.kind == "style":
            style = t.data["style"]
            if style in open_:
                open_.remove(style)
                out.append(_STYLE[style][1])
            else:
                open_.append(style)
                out.append(_STYLE[style][0])
        elif t.kind == "link":
            target = t.data["target"]
            if re.match(r"(?i)(category|file|image)\s*:", target):
                continue
            shown = inline(t.data["content"][-1], notes) if t.data["content"] else html.escape(target.lstrip(":"), quote=False)
            out.append(f'<a href="{_href(target)}">{shown}{html.escape(t.data["trail"], quote=False)}</a>')
        elif t.kind == "extlink":
            shown = inline(t.data["content"], notes) if t.data["content"] else html.escape(t.data["target"], quote=False)
            out.append(f'<a href="{html.escape(t.data["target"])}">{shown}</a>')
        elif t.kind == "autolink" and t.data["type"] == "url":
            out.append(f'<a href="{html.escape(own)}">{html.escape(own, quote=False)}</a>')
        elif t.kind == "entity":
            out.append(html.escape(decode_entities(own), quote=False))
        elif t.kind == "extension":
            name, body = t.data["name"], t.data["body"] or ""
            if name == "ref":
                if body:
                    notes.append(inline(body, []))
                out.append(f"<sup>[{len(notes)}]</sup>")
            elif name in ("nowiki", "pre", "poem"):
                out.append(html.escape(body, quote=False))
        elif t.kind in ("text", "autolink", "newline"):
            out.append(html.escape(own, quote=False).replace("\n", " "))
    return "".join(out) + "".join(_STYLE[s][1] for s in reversed(open_))


def _list(lines: list[tuple[str, str]], depth: int, notes: list[str]) -> str:
    """Items by their markers from ``depth`` on; deeper ones go into the item before."""
    out, i = [], 0
    while i < len(lines):
        tag, item = _ITEM[lines[i][0][depth]]
        j = i + 1
        same = [i]
        while j < len(lines) and _ITEM[lines[j][0][depth]][0] == tag:
            if len(lines[j][0]) == depth + 1:
                same.append(j)
            j += 1
        bounds = [*same, j]
        items = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            first = len(lines[a][0]) == depth + 1
            inner = lines[a + first : b]
            items.append(f"<{_ITEM[lines[a][0][depth]][1]}>{inline(lines[a][1], notes) if first else ''}{_list(inner, depth + 1, notes) if inner else ''}</{_ITEM[lines[a][0][depth]][1]}>")
        out.append(f"<{tag}>{''.join(items)}</{tag}>")
        i = j
    return "".join(out)


def _table(lines: list[str], notes: list[str]) -> str:
    rows: list[list[str]] = [[]]
    caption = ""
    for line in lines[1:]:
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            caption = f"<caption>{inline(line[2:].strip(), notes)}</caption>"
        elif line[:1] in ("!", "|"):
            tag, cells = ("th", re.split(r"!!|\|\|", line[1:])) if line[0] == "!" else ("td", line[1:].split("||"))
            rows[-1] += [f"<{tag}>{inline(c.strip(), notes)}</{tag}>" for c in cells]
        elif rows[-1]:
            rows[-1][-1] = rows[-1][-1][:-5] + " " + inline(line, notes) + rows[-1][-1][-5:]
    return "<table>" + caption + "".join(f"<tr>{''.join(r)}</tr>" for r in rows if r) + "</table>"


def page(text: str) -> str:
    """The HTML of one page's expanded markup."""
    out: list[str] = []
    notes: list[str] = []
    paragraph: list[str] = []
    lines = text.split("\n")
    i = 0

    def flush() -> None:
        if shown := inline("\n".join(paragraph), notes).strip():
            out.append(f"<p>{shown}</p>")
        paragraph.clear()

    while i < len(lines):
        line = lines[i]
        if m := re.fullmatch(r"(={1,6})(.+?)\1\s*", line):
            flush()
            n = len(m[1])
            out.append(f"<h{n}>{inline(m[2].strip(), notes)}</h{n}>")
        elif re.match(r"-{4,}", line):
            flush()
            out.append("<hr />")
        elif line[:1] in _ITEM:
            flush()
            items = []
            while i < len(lines) and (m := re.match(r"([*#:;]+)\s*(.*)", lines[i])):
                items.append((m[1], m[2]))
                i += 1
            out.append(_list(items, 0, notes))
            continue
        elif line.startswith("{|"):
            flush()
            end = next((k for k in range(i, len(lines)) if lines[k].startswith("|}")), len(lines))
            out.append(_table(lines[i:end], notes))
            i = end
        elif not line.strip():
            flush()
        else:
            paragraph.append(line)
        i += 1
    flush()
    if notes:
        out.append("<ol>" + "".join(f"<li>{n}</li>" for n in notes) + "</ol>")
    return "".join(out)


def render(pages: DataFrame, id_column: str = "page_id", text_column: str = "text") -> DataFrame:
    """(page_id, html) of pages, in Arrow batches; null texts stay null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(page, na_action="ignore")

    return pages.select(F.col(id_column).alias("page_id"), run(F.col(text_column)).alias("html"))
