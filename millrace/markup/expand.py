"""Template expansion over tables: each level joins the calls still open with the pages they name.

A level finds the innermost calls (no call inside), looks them all up in one join, and puts their text in,
between two marks that name the template. So each call knows the calls it came from: one to a template among
them is a loop, more than 40 of them are too deep, and both become an error text. Arguments are expanded
before the call, so they don't count as its inside. A page may call itself once, as it is no template call.
Levels go on until no call is open. Each is written to the shared folder, so that the plan doesn't grow."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import WORDS, moment, parse_time
from millrace.functions.infix import InfixError, evaluate
from millrace.functions.titles import NAMESPACES
from millrace.markup.tokens import included, split_top, template_parts, tokenize
from millrace.scratch import written

DEPTH = 40
#: Marks around the text of a call, which never leave this module: begin, end of its name, end.
_BEGIN, _NAMED, _END = "\ue0f0", "\ue0f1", "\ue0f2"
_MARKS = re.compile(f"{_BEGIN}[^{_NAMED}]*{_NAMED}|{_END}")
_INNER = re.compile(r"\{\{(?!\{)((?:(?!\{\{|\}\}).)*)\}\}", re.S)


def _title(name: str) -> str:
    name = re.sub(r"[ _]+", " ", name).strip()
    if name.startswith(":"):
        name = name[1:].strip()
    elif ":" not in name:
        name = "Template:" + name[:1].upper() + name[1:]
    return name[:1].upper() + name[1:]


def bind(body: str, arguments: Mapping[str, str]) -> str:
    """Parameters replaced by arguments or their defaults; one without either stays."""
    out = []
    for t in tokenize(body):
        own = body[t.start : t.end]
        if t.kind == "parameter":
            name = t.data["name"]
            own = arguments[name] if name in arguments else bind(t.data["default"], arguments) if t.data["default"] is not None else own
        elif "{{{" in own and t.kind != "text":
            if t.kind == "template":
                parts = split_top(own[2:-2])
                own = "{{" + "|".join(bind(p, arguments) for p in parts) + "}}"
            elif t.kind == "link":
                inner = own[2 : own.rindex("]]")]
                own = "[[" + "|".join(bind(p, arguments) for p in split_top(inner)) + own[own.rindex("]]") :]
            else:
                own = re.sub(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}", lambda m: arguments.get(m[1].strip(), m[2] if m[2] is not None else m[0]), own)
        out.append(own)
    return "".join(out)


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def builtin(target: str, args: list[str], page: str, variables: Mapping[str, str]) -> str | None:
    """A parser function or variable; None if the call names a page."""
    name, colon, first = target.partition(":")
    low = name.strip().lower().lstrip("#")
    hashed = name.strip().startswith("#")
    rest = [a for a in args]
    arg = lambda i: rest[i].strip() if i < len(rest) else ""
    if not colon:
        text = target.strip()
        if text == "!":
            return "|"
        if text == "=":
            return "="
        if text in variables:
            return variables[text]
        return _word(text.lower(), page, variables) if text.upper() == text and text.lower() != text else None
    if hashed:
        if low == "if":
            return arg(0) if first.strip() else arg(1)
        if low == "ifeq":
            return arg(1) if _same(first.strip(), arg(0)) else arg(2)
        if low == "switch":
            return _switch(first.strip(), rest)
        if low in ("expr", "ifexpr"):
            try:
                v = evaluate(first)
            except InfixError as e:
                return f'<strong class="error">Expression error: {e}</strong>'
            if low == "expr":
                return "" if v is None else _number(v)
            return arg(0) if v else arg(1)
        if low == "iferror":
            bad = re.search(r'class="[^"]*\berror\b', first)
            return arg(0) if bad else (rest[1].strip() if len(rest) > 1 else first)
        if low == "time":
            now = _clock(variables)
            when = parse_time(arg(0), now) if arg(0) else now
            return moment(when, first.strip()) if when else '<strong class="error">Error: Invalid time.</strong>'
        if low == "titleparts":
            parts = first.strip().split("/")
            n = int(arg(0) or 0)
            start = max(int(arg(1) or 1), 1)
            return "/".join(parts[start - 1 :][:n] if n else parts[start - 1 :])
        if low == "tag":
            attrs = "".join(f' {k.strip()}="{v.strip()}"' for k, _, v in (a.partition("=") for a in rest[1:]))
            return f"<{first.strip()}{attrs}>{arg(0)}</{first.strip()}>"
        return None
    if low in ("lc", "uc", "lcfirst", "ucfirst"):
        t = first
        return {"lc": t.lower(), "uc": t.upper(), "lcfirst": t[:1].lower() + t[1:], "ucfirst": t[:1].upper() + t[1:]}[low]
    if low in ("padleft", "padright"):
        n, pad = int(arg(0) or 0), arg(1) or "0"
        fill = (pad * n)[: max(0, n - len(first))]
        return fill + first if low == "padleft" else first + fill
    if low == "formatnum":
        if arg(0).upper() == "R":
            return first.replace(",", "")
        m = re.fullmatch(r"([+-]?)(\d+)(\.\d+)?", first.strip())
        return f"{m[1]}{int(m[2]):,}{m[3] or ''}" if m else first
    if low == "plural":
        return arg(0) if first.strip() in ("1", "-1") else arg(1)
    if low == "urlencode":
        return quote_plus(first, safe="-_.")
    if low == "anchorencode":
        return re.sub(r"[\s_]+", "_", first.strip())
    if low in ("defaultsort", "displaytitle", "shortdesc"):
        return ""
    if name.strip().isupper() and (of := _word(low, first.strip(), variables)) is not None:
        return of
    if low in ("fullurl", "localurl"):
        local = "/wiki/" + quote(_title(":" + first.strip()).replace(" ", "_"), safe="/:;@$!*(),~") + (f"?{arg(0)}" if arg(0) else "")
        return variables.get("SERVER", "") + local if low == "fullurl" else local
    if low == "int":
        return variables.get("int:" + first.strip(), f"⧼{first.strip()}⧽")
    if low == "ns":
        x = first.strip()
        return NAMESPACES.get(int(x), "") if re.fullmatch(r"-?\d+", x) else next((n for n in NAMESPACES.values() if n.lower() == x.lower().replace("_", " ")), "")
    return None


def _clock(variables: Mapping[str, str]) -> dt.datetime:
    """The time of the pages: the variable ``clock``, in ISO form."""
    return dt.datetime.fromisoformat(variables["clock"]).replace(tzinfo=dt.timezone.utc)


def _word(word: str, page: str, variables: Mapping[str, str]) -> str | None:
    """The value of a page-name, namespace, time or site word; None if there is no such word."""
    of_time = re.fullmatch("(?:current|local)(.+)", word)
    if of_time and of_time[1] in WORDS:
        text = moment(_clock(variables), WORDS[of_time[1]])
        return text.lstrip("0") if of_time[1] == "week" else text
    space, colon, text = page.partition(":")
    number = next((i for i, n in NAMESPACES.items() if colon and n and n.lower() == space.strip().lower().replace("_", " ")), 0)
    if not number:
        space, text = "", page
    named = lambda i: NAMESPACES.get(i, "")
    full = lambda i: f"{named(i)}:{text}" if named(i) else text
    topic, talk = (number - number % 2, number | 1) if number >= 0 else (number, number)
    values = {
        "pagename": text, "fullpagename": full(number), "basepagename": text.rpartition("/")[0] or text, "subpagename": text.rpartition("/")[2], "rootpagename": text.partition("/")[0],
        "talkpagename": full(talk), "subjectpagename": full(topic), "articlepagename": full(topic), "namespace": named(number), "namespacenumber": str(number),
        "talkspace": named(talk) if number >= 0 else "", "subjectspace": named(topic), "articlespace": named(topic),
        "server": variables.get("SERVER", ""), "numberofpages": variables.get("NUMBEROFPAGES", "0"), "getshortdesc": variables.get("shortdesc", ""), "protectionexpiry": "infinity",
    }
    return values.get(word)


def _same(a: str, b: str) -> bool:
    number = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
    if number.fullmatch(a) and number.fullmatch(b):
        return float(a) == float(b)
    return a == b


def _switch(x: str, cases: list[str]) -> str:
    hit, default = False, ""
    for i, c in enumerate(cases):
        key, eq, value = c.partition("=")
        if not eq:
            if i == len(cases) - 1:
                return value or key.strip() if not hit else key.strip()
            hit = hit or _same(x, key.strip())
            continue
        if hit or _same(x, key.strip()):
            return value.strip()
        if key.strip() == "#default":
            default = value.strip()
    return default


def _exists(call: str) -> tuple[str, list[str]] | None:
    """The title that an existence test asks for, and its branches."""
    head, *rest = split_top(call)
    name, colon, title = head.partition(":")
    return (_title(":" + title.strip()), rest) if colon and name.strip().lower() == "#ifexist" else None


def _step(text: str, page: str, variables: Mapping[str, str]) -> tuple[str, list[str]]:
    """Innermost calls of functions done; the titles of the pages that innermost calls name."""
    wanted: list[str] = []

    def one(m: re.Match) -> str:
        if "{{{" in m[0]:
            return m[0]
        call = _MARKS.sub("", m[1])  # what was put in has no open call left, or this wouldn't be innermost
        if asked := _exists(call):
            wanted.append(asked[0])
            return m[0]
        parts = split_top(call)
        done = builtin(parts[0].strip(), parts[1:], page, variables)
        if done is not None:
            return done
        wanted.append(_title(template_parts(call)[0]))
        return m[0]

    return _INNER.sub(one, text), wanted


def _fill(text: str, bodies: Mapping[str, str], depth: int = DEPTH) -> str:
    """The innermost calls replaced by the texts of the pages they name, in marks."""
    path: list[str] = []
    seen = 0

    def one(m: re.Match) -> str:
        nonlocal seen
        for mark in _MARKS.finditer(text, seen, m.start()):
            if mark[0] == _END:
                path.pop()
            else:
                path.append(mark[0][1:-1])
        seen = m.end()  # marks within the call are of its arguments, and whole
        if "{{{" in m[0]:
            return m[0]
        call = _MARKS.sub("", m[1])
        if asked := _exists(call):
            branch = asked[1][0 if bodies.get(asked[0]) is not None else 1 :][:1]
            return branch[0].strip() if branch else ""
        target, args = template_parts(call)
        title = _title(target)
        if title in path:
            return f'<strong class="error">Template loop: [[{title}]]</strong>'
        if len(path) >= depth:
            return f'<strong class="error">Template too deep: [[{title}]]</strong>'
        if title not in bodies:
            return m[0]
        if bodies[title] is None:
            return f"[[:{title}]]"
        body = bind(included(bodies[title], True), {k: v for k, v, _ in args})
        line = _MARKS.sub("", text[max(0, m.start() - 200) : m.start()])[-1:]
        own = "\n" + body if re.match(r"\{\||[*#:;]", body) and line not in ("", "\n") else body
        return f"{_BEGIN}{title}{_NAMED}{own}{_END}"

    return _INNER.sub(one, text)


def expand(pages: DataFrame, library: DataFrame, variables: Mapping[str, str] | None = None, depth: int = DEPTH, clock: dt.datetime | None = None) -> DataFrame:
    """(title, text) of pages with calls expanded. ``library`` has title and text of the pages calls may name.

    ``variables`` are further words, with ``SERVER``, ``NUMBEROFPAGES`` and messages as ``int:name`` among them; ``clock`` is
    the time of the time words, now if it isn't given. A null text counts as empty."""
    from millrace.sources.search import resolve

    now = clock or dt.datetime.now(dt.timezone.utc)
    variables = {"clock": now.replace(tzinfo=None).isoformat()} | dict(variables or {})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for title, text, fresh in zip(b["title"], b["text"], b["fresh"], strict=True):
                text = bind(included(_MARKS.sub("", text or ""), False), {}) if fresh else text
                new, wanted = _step(text, title, variables)
                while new != text and not wanted:
                    text = new
                    new, wanted = _step(text, title, variables)
                rows.append((title, new, False, sorted(set(wanted))))
            yield pd.DataFrame(rows, columns=["title", "text", "fresh", "wanted"])

    redirect = library.select("title", F.trim(F.regexp_extract("text", r"(?i)^\s*#redirect\s*:?\s*\[\[([^\]|#]+)", 1)).alias("target")).filter("target != ''")
    texts = library.select(F.col("title").alias("resolved"), F.col("text").alias("body"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for title, text, fresh, own in zip(b["title"], b["text"], b["fresh"], b["bodies"], strict=True):
                known = {k: None if v == "\0" else v for k, v in (dict(own) if own is not None else {}).items()}
                rows.append((title, _fill(text, known, depth) if known else text, fresh))
            yield pd.DataFrame(rows, columns=["title", "text", "fresh"])

    work = pages.select("title", "text", F.lit(True).alias("fresh"))
    done = None
    while True:
        scanned = written(work.mapInPandas(scan, "title string, text string, fresh boolean, wanted array<string>"), "expanded")
        ready = scanned.filter(F.size("wanted") == 0).select("title", F.regexp_replace("text", _MARKS.pattern, "").alias("text"))
        done = ready if done is None else done.union(ready)
        open_ = scanned.filter(F.size("wanted") > 0)
        if not open_.limit(1).count():
            return done
        calls = open_.select("title", F.explode("wanted").alias("call")).distinct()
        found = resolve(calls.select("call").distinct(), redirect, "call").join(texts, "resolved", "left").select("call", F.coalesce("body", F.lit("\0")).alias("body"))
        found = found.dropDuplicates(["call"])
        bodies = calls.join(found, "call").groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("call", "body"))).alias("bodies"))
        work = open_.drop("wanted").join(bodies, "title", "left").mapInPandas(fill, "title string, text string, fresh boolean")
