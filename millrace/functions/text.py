"""Text functions as Columns; the irregular few in Arrow-batched UDFs."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_END = 1 << 20


def lc(x: Column) -> Column:
    return F.lower(x)


def uc(x: Column) -> Column:
    return F.upper(x)


def lcfirst(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, _END))


def ucfirst(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, _END))


def padleft(x: Column, width: int, pad: str = "0") -> Column:
    """Pads to a width in characters; text that is wide enough is never cut."""
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, pad or "0"))


def padright(x: Column, width: int, pad: str = "0") -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, pad or "0"))


def titleparts(title: Column, count: int = 0, first: int = 1) -> Column:
    """``count`` parts between slashes from part ``first``; 0 takes all, negative counts leave parts off the end."""
    parts = F.split(title, "/", -1)
    n = F.size(parts)
    begin = F.lit(max(first, 1)) if first >= 0 else F.greatest(n + first + 1, F.lit(1))
    left = F.greatest(n - begin + 1, F.lit(0))
    take = left if count == 0 else F.least(F.lit(count), left) if count > 0 else F.greatest(left + count, F.lit(0))
    return F.array_join(F.slice(parts, begin, take), "/")


#: Characters that stay as they are in each style of URL encoding, beside letters and digits.
SAFE = {"PATH": "-_.~", "QUERY": "-_.", "WIKI": "-_.~!*();:@$,/"}


def urlencode(x: Column, style: str = "QUERY") -> Column:
    """Percent-encodes UTF-8; QUERY writes spaces as '+', WIKI as '_', PATH as %20."""
    out = F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("+"), F.lit({"QUERY": "+", "WIKI": "_", "PATH": "%20"}[style]))
    for c in SAFE[style]:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    if "~" not in SAFE[style]:
        out = F.replace(out, F.lit("~"), F.lit("%7E"))
    return out


def urldecode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def anchorencode(x: Column) -> Column:
    """A heading's anchor: white space becomes '_', the rest stays."""
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"<[^>]*>", "")), r"[\s_]+", "_")


_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def decode_entities(text: str) -> str:
    """Entities with their semicolon; unknown ones stay."""

    def one(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16) if m[2] else None
        if n is None:
            return html.entities.html5.get(m[3] + ";", m[0])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def entities(x: Column) -> Column:
    """Decodes entities. Texts without '&' don't leave the JVM's fast path; the common five are replaced there."""
    @F.pandas_udf("string")
    def full(s: pd.Series) -> pd.Series:
        return s.map(decode_entities, na_action="ignore")

    plain = x
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    simple = ~x.rlike(r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)[A-Za-z#][A-Za-z0-9]*;") & ~x.rlike(r"&amp;[A-Za-z#]")
    return F.when(simple, plain).otherwise(full(F.when(~simple, x)))


def encode_entities(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strtr(x: Column, pairs: Mapping[str, str]) -> Column:
    """Replaces all at once, the longest first; one pair is a plain replacement, single characters a translation."""
    if len(pairs) == 1:
        ((a, b),) = pairs.items()
        return F.replace(x, F.lit(a), F.lit(b))
    if all(len(a) == 1 and len(b) == 1 for a, b in pairs.items()):
        return F.translate(x, "".join(pairs), "".join(pairs.values()))
    rule = re.compile("|".join(re.escape(k) for k in sorted(pairs, key=len, reverse=True)))

    @F.pandas_udf("string")
    def swap(s: pd.Series) -> pd.Series:
        return s.map(lambda t: rule.sub(lambda m: pairs[m[0]], t), na_action="ignore")

    return swap(x)


def switch(x: Column, cases: list[tuple[str, Column | None]], default: Column) -> Column:
    """The value of the first equal case; a case without value falls through to the next that has one."""
    from millrace.functions.numbers import loosely_equal

    out, waiting = None, []
    for key, value in cases:
        waiting.append(default if key == "#default" and value is None else key)
        if value is None:
            continue
        if key == "#default":
            default, waiting = value, []
            continue
        test = F.lit(False)
        for k in waiting:
            if isinstance(k, str):
                test = test | loosely_equal(x, F.lit(k))
        out = F.when(test, value) if out is None else out.when(test, value)
        waiting = []
    return default if out is None else out.otherwise(default)


def if_(x: Column, yes: Column, no: Column) -> Column:
    """Whether a text has anything but white space."""
    return F.when(F.trim(F.coalesce(x, F.lit(""))) != "", yes).otherwise(no)


def ifeq(a: Column, b: Column, yes: Column, no: Column) -> Column:
    from millrace.functions.numbers import loosely_equal

    return F.when(loosely_equal(F.trim(a), F.trim(b)), yes).otherwise(no)


def iferror(x: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(x.rlike(r'(?i)<(?:strong|span|p|div)\s[^>]*class="[^"]*\berror\b[^"]*"'), yes).otherwise(x if no is None else no)


def message(pattern: str, *arguments: Column) -> Column:
    """A message with $1, $2 ... filled in."""
    parts, at = [], 0
    for m in re.finditer(r"\$(\d)", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        i = int(m[1]) - 1
        parts.append(arguments[i].cast("string") if i < len(arguments) else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def truncate(x: Column, length: int, ellipsis: str = "…") -> Column:
    """To a length, at the end for positive ones and at the start for negative ones."""
    if length >= 0:
        return F.when(F.length(x) <= length, x).otherwise(F.concat(F.substring(x, 1, length), F.lit(ellipsis)))
    return F.when(F.length(x) <= -length, x).otherwise(F.concat(F.lit(ellipsis), F.right(x, F.lit(-length))))


def list_to_text(items: Column, separator: str = ", ", conjunction: str = " and ") -> Column:
    n = F.size(items)
    return F.when(n == 0, F.lit("")).when(n == 1, items[0]).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), separator), F.lit(conjunction), F.element_at(items, -1)))


def normalised(x: Column, form: str = "NFC") -> Column:
    """Unicode normal forms; ASCII text is its own and stays in the JVM."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    ascii_ = x.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, x).otherwise(run(F.when(~ascii_, x)))


#: Lua character classes as Java ones.
_LUA = {"a": r"\p{L}", "A": r"\P{L}", "d": r"\p{Nd}", "D": r"\P{Nd}", "l": r"\p{Ll}", "L": r"\P{Ll}", "s": r"\s", "S": r"\S", "u": r"\p{Lu}", "U": r"\P{Lu}", "w": r"[\p{L}\p{Nd}]", "W": r"[^\p{L}\p{Nd}]", "p": r"\p{P}", "P": r"\P{P}", "c": r"\p{Cc}", "C": r"\P{Cc}", "x": "[0-9A-Fa-f]", "X": "[^0-9A-Fa-f]", "z": r"\x00"}


def lua_pattern(pattern: str) -> str:
    """The Java regular expression of a Lua pattern; %b has no regular equivalent and is an error."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "%" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n == "b":
                raise ValueError("%b is not a regular expression")
            if n == "f":
                end = pattern.index("]", i + 1)
                cls = lua_pattern(pattern[i : end + 1])
                out.append(f"(?<!{cls})(?={cls})")
                i = end + 1
                continue
            own = _LUA.get(n) or (rf"\{n}" if n.isdigit() and n != "0" and not inside else re.escape(n))
            out.append(own[1:-1] if inside and own.startswith("[") and not own.startswith("[^") else own)
            continue
        if inside:
            out.append({"]": "]", "[": r"\[", "\\": r"\\", "&": r"\&"}.get(c, c))
            inside = c != "]"
        elif c == "[":
            inside = True
            out.append("[")
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif c == "-":
            out.append("*?")
        elif c in "*+?().":
            out.append("[\\s\\S]" if c == "." else c)
        elif (c == "^" and i == 0) or (c == "$" and i == len(pattern) - 1):
            out.append(c if c == "^" else r"\z")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def lua_find(x: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 without one."""
    return F.regexp_instr(x, F.lit(lua_pattern(pattern)))


def lua_match(x: Column, pattern: str) -> Column:
    """The first capture of the first match, or the match; null without one."""
    java = lua_pattern(pattern)
    group = 1 if "(" in re.sub(r"%.|\[[^\]]*\]", "", pattern) else 0
    return F.when(x.rlike(java), F.regexp_extract(x, java, group))


def lua_gsub(x: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; %1 names a capture, %0 the match."""
    java = replacement.replace("\\", "\\\\").replace("$", "\\$")
    java = re.sub(r"%(\d)", r"$\1", java).replace("%%", "%")
    return F.regexp_replace(x, lua_pattern(pattern), java)


def bit(op: str, a: Column, b: Column | int = 0) -> Column:
    """Unsigned 32-bit operations: band bor bxor bnot lshift rshift arshift lrotate rrotate."""
    mask = F.lit(0xFFFFFFFF)
    x = a.cast("long").bitwiseAND(mask)
    if op == "bnot":
        return F.bitwise_not(x).bitwiseAND(mask)
    if op in ("band", "bor", "bxor"):
        y = (F.lit(b) if isinstance(b, int) else b).cast("long").bitwiseAND(mask)
        return {"band": x.bitwiseAND, "bor": x.bitwiseOR, "bxor": x.bitwiseXOR}[op](y)
    n = int(b) & 31
    if op == "lshift":
        return F.shiftleft(x, n).bitwiseAND(mask)
    if op == "rshift":
        return F.shiftright(x, n)
    if op == "arshift":
        return F.shiftright(F.shiftleft(x, 32), 32 + n).bitwiseAND(mask)
    n = n if op == "lrotate" else -n & 31
    return F.shiftleft(x, n).bitwiseOR(F.shiftright(x, 32 - n)).bitwiseAND(mask)
