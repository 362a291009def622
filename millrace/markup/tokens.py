"""A hand-written tokenizer of wiki markup: one pass with a stack for the nested constructs.

Tokens are tuples (kind, start, end, payload) over the text; kinds: link, extlink, autolink, heading,
list, hr, table_start, table_row, table_cell, table_heading, table_caption, table_end, style, tag,
endtag, comment, entity, switch, extension, template, parameter, variant, include, text, newline,
redirect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

EXTENSIONS = ("chem", "gallery", "graph", "indicator", "mapframe", "maplink", "math", "nowiki", "poem", "pre", "ref", "references", "section", "source", "syntaxhighlight", "templatedata", "templatestyles", "timeline", "score", "hiero", "imagemap", "inputbox", "categorytree", "ce")
INCLUDES = ("noinclude", "includeonly", "onlyinclude")
PROTOCOLS = r"(?:https?|ftps?|ircs?|gopher|telnet|nntp|worldwind|svn|git|mms)://|mailto:|news:|tel:|sip:|magnet:|//"
_ATTR = re.compile(r"""([^\s=/>"'<]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_OPEN_EXT = re.compile(r"<(" + "|".join(EXTENSIONS) + r")((?:\s[^<>]*?)?)(/?)>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*?)?)(/?)>")
_INCLUDE = re.compile(r"<(/?)(noinclude|includeonly|onlyinclude)\s*(/?)>", re.I)
_AUTO = re.compile(r"(?<![\w/])(?:https?|ftps?|ircs?|gopher|telnet|nntp|svn|git|mms)://[^\s<>\[\]\"{}|]*[^\s<>\[\]\"{}|.,;:!?)'\\]")
_MAGIC = re.compile(r"\b(RFC|PMID)[ \t\xa0]+(\d+)\b|\bISBN[ \t\xa0]+((?:97[89][- \xa0]?)?(?:\d[- \xa0]?){9}[\dxX])\b")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_SWITCH = re.compile(r"__[A-Z]+__")
REDIRECT = re.compile(r"\s*#(?:redirect|weiterleitung|redirection|redirecci[oó]n)\s*:?\s*\[\[([^\]|#]+)(#[^\]|]*)?(?:\|[^\]]*)?\]\]", re.I)


@dataclass
class Token:
    kind: str
    start: int
    end: int
    data: dict = field(default_factory=dict)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(text or "")}


def closing(text: str, at: int, open_: str, close: str) -> int:
    """The end of a balanced pair that opens at ``at``; -1 if it isn't closed."""
    depth, i, n = 0, at, len(text)
    while i < n:
        if text.startswith("<!--", i):
            j = text.find("-->", i)
            i = n if j < 0 else j + 3
            continue
        if text.startswith("<nowiki>", i):
            j = text.find("</nowiki>", i)
            i = n if j < 0 else j + 9
            continue
        if text.startswith(open_, i):
            depth += 1
            i += len(open_)
        elif text.startswith(close, i):
            depth -= 1
            i += len(close)
            if depth == 0:
                return i
        else:
            i += 1
    return -1


def brace_spans(text: str) -> dict[int, tuple[int, int]]:
    """start -> (end, braces) of all balanced double and triple braces; runs are matched from the inside."""
    spans: dict[int, tuple[int, int]] = {}
    stack: list[list[int]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "<" and (text.startswith("<!--", i) or text.startswith("<nowiki>", i)):
            end = "-->" if text[i + 1] == "!" else "</nowiki>"
            j = text.find(end, i)
            i = n if j < 0 else j + len(end)
            continue
        if c not in "{}":
            i += 1
            continue
        k = 1
        while i + k < n and text[i + k] == c:
            k += 1
        if c == "{":
            if k > 1:
                stack.append([i, k])
            i += k
            continue
        while k >= 2 and stack:
            top = stack[-1]
            use = 3 if top[1] >= 3 and k >= 3 else 2
            spans[top[0] + top[1] - use] = (i + use, use)
            top[1] -= use
            i, k = i + use, k - use
            if top[1] < 2:
                stack.pop()
        i += k
    return spans


def split_top(text: str, by: str = "|") -> list[str]:
    """Parts between separators outside links, templates, tables and extension tags."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if text.startswith("<nowiki>", i):
            j = text.find("</nowiki>", i)
            i = len(text) if j < 0 else j + 9
            continue
        if two in ("[[", "{{", "{|"):
            depth += 1
            i += 2
        elif two in ("]]", "}}", "|}") and depth:
            depth -= 1
            i += 2
        elif depth == 0 and text.startswith(by, i):
            out.append(text[start:i])
            i += len(by)
            start = i
        else:
            i += 1
    out.append(text[start:])
    return out


def template_parts(body: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """(target, [(name, value, named)]) of the text between braces; positional names count from 1."""
    parts = split_top(body)
    out, n = [], 0
    for p in parts[1:]:
        key, eq, value = _named(p)
        if eq:
            out.append((key.strip(), value.strip(), True))
        else:
            n += 1
            out.append((str(n), p, False))
    return parts[0].strip(), out


def _named(text: str) -> tuple[str, str, str]:
    parts = split_top(text, "=")
    return (parts[0], "=", "=".join(parts[1:])) if len(parts) > 1 else (text, "", "")


def tokenize(text: str) -> list[Token]:
    """All tokens of a text, in order; text between them are text tokens."""
    out: list[Token] = []
    braces = brace_spans(text) if "{{" in text else {}
    plain, i, n = 0, 0, len(text)

    def add(kind: str, start: int, end: int, **data) -> int:
        nonlocal plain
        if start > plain:
            out.append(Token("text", plain, start))
        out.append(Token(kind, start, end, data))
        plain = end
        return end

    if m := REDIRECT.match(text):
        i = add("redirect", m.start(), m.end(), target=m[1].strip(), fragment=(m[2] or "")[1:])
    while i < n:
        c = text[i]
        line = i == 0 or text[i - 1] == "\n"
        if line:
            end = text.find("\n", i)
            end = n if end < 0 else end
            row = text[i:end]
            if c == "=" and (m := re.match(r"(={1,6})(.+?)\1\s*(?:<!--.*?-->\s*)*$", row)):
                add("heading", i, end, level=len(m[1]), content=m[2].strip())
                i = end
                continue
            if m := re.match(r"-{4,}", row):
                i = add("hr", i, i + m.end())
                continue
            if m := re.match(r"[*#:;]+", row):
                i = add("list", i, i + m.end(), markers=m[0])
                continue
            if m := re.match(r"\s*:*\s*\{\|(.*)$", row):
                i = add("table_start", i, end, attributes=attributes(m[1]))
                continue
            if m := re.match(r"\s*\|\}", row):
                i = add("table_end", i, i + m.end())
                continue
            if m := re.match(r"\s*\|\+(?:([^|\[\]{}]*)\|(?!\|))?", row):
                i = add("table_caption", i, i + m.end(), attributes=attributes(m[1] or ""))
                continue
            if m := re.match(r"\s*\|-+(.*)$", row):
                i = add("table_row", i, end, attributes=attributes(m[1]))
                continue
            if m := re.match(r"\s*([|!])(?:([^|\[\]{}\n]*)\|(?!\|))?", row):
                if _in_table(out):
                    i = add("table_heading" if m[1] == "!" else "table_cell", i, i + m.end(), attributes=attributes(m[2] or ""))
                    continue
        if c == "\n":
            i = add("newline", i, i + 1)
            continue
        if c == "|" and text.startswith("||", i) and _in_table(out):
            i = add("table_cell", i, i + 2, attributes={})
            continue
        if c == "!" and text.startswith("!!", i) and _in_table(out) and "table_heading" in _row_kinds(out):
            i = add("table_heading", i, i + 2, attributes={})
            continue
        if c == "<":
            if text.startswith("<!--", i):
                j = text.find("-->", i)
                i = add("comment", i, n if j < 0 else j + 3, content=text[i + 4 : n if j < 0 else j])
                continue
            if m := _OPEN_EXT.match(text, i):
                name = m[1].lower()
                if m[3]:
                    i = add("extension", i, m.end(), name=name, attributes=attributes(m[2]), body=None)
                    continue
                close = re.compile(rf"</{name}\s*>", re.I).search(text, m.end())
                if close:
                    i = add("extension", i, close.end(), name=name, attributes=attributes(m[2]), body=text[m.end() : close.start()])
                    continue
            if m := _INCLUDE.match(text, i):
                i = add("include", i, m.end(), name=m[2].lower(), closing=bool(m[1]))
                continue
            if m := _TAG.match(text, i):
                i = add("endtag" if m[1] else "tag", i, m.end(), name=m[2].lower(), attributes=attributes(m[3]), closed=bool(m[4]))
                continue
        if c == "{":
            if i in braces:
                j, use = braces[i]
                if use == 3:
                    parts = split_top(text[i + 3 : j - 3])
                    i = add("parameter", i, j, name=parts[0].strip(), default="|".join(parts[1:]) if len(parts) > 1 else None)
                else:
                    target, args = template_parts(text[i + 2 : j - 2])
                    i = add("template", i, j, target=target, arguments=args)
                continue
        if c == "-" and text.startswith("-{", i):
            j = closing(text, i, "-{", "}-")
            if j > 0:
                i = add("variant", i, j, content=text[i + 2 : j - 2])
                continue
        if c == "[":
            if text.startswith("[[", i):
                j = closing(text, i, "[[", "]]")
                if j > 0 and "\n" not in split_top(text[i + 2 : j - 2])[0]:
                    parts = split_top(text[i + 2 : j - 2])
                    trail = re.compile(r"[^\W\d_]*").match(text, j)
                    own = parts[0].strip()
                    kind = re.match(r"\s*([^:|\[\]]+?)\s*:", own)
                    special = bool(kind) and kind[1].lower() in ("category", "file", "image", "kategorie", "catégorie", "categoría", "datei", "fichier", "archivo")
                    end = j if special else trail.end()
                    i = add("link", i, end, target=own, content=parts[1:], trail="" if special else trail[0])
                    continue
            if m := re.compile(r"\[((?:" + PROTOCOLS + r")[^\s\]<>\"]*)(?:[ \t\xa0]+([^\]\n]*))?\]").match(text, i):
                i = add("extlink", i, m.end(), target=m[1], content=m[2])
                continue
        if c == "'" and (m := re.compile("'{2,}").match(text, i)):
            k = len(m[0])
            i = add("style", i, m.end(), style={2: "italic", 3: "bold"}.get(k, "bold italic"), count=k)
            continue
        if c == "&" and (m := _ENTITY.match(text, i)):
            i = add("entity", i, m.end(), value=m[0])
            continue
        if c == "_" and (m := _SWITCH.match(text, i)):
            i = add("switch", i, m.end(), name=m[0].strip("_"))
            continue
        if c in "hfigtnsm" and (m := _AUTO.match(text, i)):
            i = add("autolink", i, m.end(), target=m[0], type="url")
            continue
        if c in "RPI" and (m := _MAGIC.match(text, i)):
            kind = m[1] or "ISBN"
            i = add("autolink", i, m.end(), target=m[2] or re.sub(r"[^\dxX]", "", m[3]), type=kind)
            continue
        i += 1
    if plain < n:
        out.append(Token("text", plain, n))
    return out


def _in_table(out: list[Token]) -> bool:
    depth = 0
    for t in out:
        depth += (t.kind == "table_start") - (t.kind == "table_end")
    return depth > 0


def _row_kinds(out: list[Token]) -> set[str]:
    kinds = set()
    for t in reversed(out):
        if t.kind == "newline":
            break
        kinds.add(t.kind)
    return kinds


def included(text: str, transcluded: bool) -> str:
    """What inclusion control leaves of a page, read directly or transcluded."""
    if transcluded:
        only = re.findall(r"<onlyinclude\s*>(.*?)</onlyinclude\s*>", text, re.S | re.I)
        if only:
            return "".join(only)
        text = re.sub(r"<noinclude\s*>.*?(?:</noinclude\s*>|$)", "", text, flags=re.S | re.I)
        return re.sub(r"</?includeonly\s*/?>", "", text, flags=re.I)
    text = re.sub(r"<includeonly\s*>.*?(?:</includeonly\s*>|$)", "", text, flags=re.S | re.I)
    return re.sub(r"</?(?:noinclude|onlyinclude)\s*/?>", "", text, flags=re.I)


def plain_text(text: str) -> str:
    """Text, entities and link captions; markup, templates and tags go."""
    from millrace.functions.text import decode_entities

    out = []
    for t in tokenize(text):
        if t.kind == "text":
            out.append(text[t.start : t.end])
        elif t.kind == "newline":
            out.append("\n")
        elif t.kind == "entity":
            out.append(decode_entities(t.data["value"]))
        elif t.kind == "link":
            target = t.data["target"]
            if re.match(r"(?i)(category|file|image|kategorie|datei)\s*:", target):
                continue
            shown = t.data["content"][-1] if t.data["content"] else target.lstrip(":")
            out.append(plain_text(shown) + t.data["trail"])
        elif t.kind == "extlink":
            out.append(plain_text(t.data["content"] or ""))
        elif t.kind == "autolink":
            out.append(text[t.start : t.end])
        elif t.kind == "heading":
            out.append(plain_text(t.data["content"]))
        elif t.kind == "extension" and t.data["name"] in ("nowiki", "pre", "poem"):
            out.append(t.data["body"] or "")
        elif t.kind == "variant":
            out.append(plain_text(t.data["content"].split("|")[-1].split(";")[0].split(":")[-1]))
    return "".join(out)
