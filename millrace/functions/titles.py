"""Titles as Columns: normalising, parts, joins, and the page-name words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import entities, ucfirst, urlencode

#: The default namespaces; talk spaces are the odd numbers.
NAMESPACES = {-2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk", 8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk", 828: "Module", 829: "Module talk"}
ALIASES = {"image": 6, "image talk": 7, "wp": 4, "t": 10}
SUBPAGES = (1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 15, 828, 829)


def _names(namespaces: Mapping[int, str]) -> dict[str, int]:
    return {n.lower(): i for i, n in namespaces.items() if n} | {a: i for a, i in ALIASES.items() if i in namespaces}


def _map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def cleaned(x: Column) -> Column:
    """Entities decoded, marks of direction gone, runs of spaces and underscores one space."""
    x = F.regexp_replace(entities(x), "[‎‏‪-‮]", "")
    return F.trim(F.regexp_replace(x, "[ _  ᠎ -     　]+", " "))


def parse_title(x: Column, namespaces: Mapping[int, str] = NAMESPACES, interwiki: list[str] | None = None, default: int = 0, case_sensitive: tuple[int, ...] = ()) -> Column:
    """struct<interwiki, ns, namespace, text, fragment> of a title's text."""
    x = cleaned(x)
    fragment = F.when(F.instr(x, "#") > 0, F.regexp_extract(x, "#(.*)$", 1))
    body = F.trim(F.regexp_replace(x, "#.*$", ""))
    colon = body.startswith(":")
    body = F.when(colon, F.trim(F.substring(body, 2, 1 << 20))).otherwise(body)
    prefix = F.lower(F.trim(F.regexp_extract(body, "^([^:]*):", 1)))
    rest = F.trim(F.regexp_extract(body, "^[^:]*:(.*)$", 1))
    wiki = F.when(prefix.isin(interwiki) & (prefix != ""), prefix) if interwiki else F.lit(None).cast("string")
    body2 = F.when(wiki.isNotNull(), rest).otherwise(body)
    prefix2 = F.lower(F.trim(F.regexp_extract(body2, "^([^:]*):", 1)))
    known = F.try_element_at(_map(_names(namespaces)), prefix2)
    ns = F.coalesce(known, F.when(colon, F.lit(0)).otherwise(F.lit(default)))
    text = F.when(known.isNotNull(), F.trim(F.regexp_extract(body2, "^[^:]*:(.*)$", 1))).otherwise(body2)
    text = F.when(ns.isin(*case_sensitive) if case_sensitive else F.lit(False), text).otherwise(ucfirst(text))
    text = F.when(wiki.isNotNull(), body2).otherwise(text)
    return F.struct(wiki.alias("interwiki"), ns.alias("ns"), F.coalesce(F.try_element_at(_map(dict(namespaces)), ns), F.lit("")).alias("namespace"), text.alias("text"), fragment.alias("fragment"))


def prefixed(t: Column) -> Column:
    """Namespace, colon and text."""
    head = F.concat(F.coalesce(F.concat(t["interwiki"], F.lit(":")), F.lit("")), F.when(t["namespace"] != "", F.concat(t["namespace"], F.lit(":"))).otherwise(F.lit("")))
    return F.concat(head, t["text"])


def key(t: Column) -> Column:
    return F.replace(prefixed(t), F.lit(" "), F.lit("_"))


def base(t: Column) -> Column:
    """Without the last subpage, in namespaces that have subpages."""
    cut = F.regexp_replace(t["text"], "/[^/]*$", "")
    return F.when(t["ns"].isin(*SUBPAGES), cut).otherwise(t["text"])


def root(t: Column) -> Column:
    return F.when(t["ns"].isin(*SUBPAGES), F.substring_index(t["text"], "/", 1)).otherwise(t["text"])


def subpage(t: Column) -> Column:
    return F.when(t["ns"].isin(*SUBPAGES), F.substring_index(t["text"], "/", -1)).otherwise(t["text"])


def _space(ns: Column, namespaces: Mapping[int, str]) -> Column:
    return F.coalesce(F.try_element_at(_map(dict(namespaces)), ns), F.lit(""))


def with_space(t: Column, ns: Column, namespaces: Mapping[int, str] = NAMESPACES) -> Column:
    name = _space(ns, namespaces)
    return F.concat(F.when(name != "", F.concat(name, F.lit(":"))).otherwise(F.lit("")), t["text"])


def talk(t: Column, namespaces: Mapping[int, str] = NAMESPACES) -> Column:
    """The talk page's full name; special spaces have none."""
    return F.when(t["ns"] < 0, F.lit("")).otherwise(with_space(t, t["ns"].bitwiseOR(1), namespaces))


def subject(t: Column, namespaces: Mapping[int, str] = NAMESPACES) -> Column:
    return F.when(t["ns"] < 0, prefixed(t)).otherwise(with_space(t, t["ns"] - t["ns"] % 2, namespaces))


def joined(page: Column, link: Column) -> Column:
    """A relative title: /sub is below the page, ../ above it."""
    ups = (F.length(F.regexp_extract(link, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    rest = F.regexp_replace(link, r"^(?:\.\./)+", "")
    parts = F.split(page, "/", -1)
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    down = F.regexp_replace(F.substring(link, 2, 1 << 20), "/$", "")
    return F.when(link.startswith("/"), F.concat(page, F.lit("/"), down)).when(ups > 0, F.when(rest == "", above).otherwise(F.concat(above, F.lit("/"), rest))).otherwise(link)


def local_url(t: Column, query: str = "") -> Column:
    return F.concat(F.lit("/wiki/"), urlencode(key(t), "WIKI"), F.lit(f"?{query}" if query else ""))


def full_url(t: Column, server: str, query: str = "") -> Column:
    return F.concat(F.lit(server), local_url(t, query))


def words(name: str, t: Column, namespaces: Mapping[int, str] = NAMESPACES) -> Column:
    """The page-name and namespace words."""
    n = name.lower()
    encode = n.endswith("e") and n[:-1] in _WORDS and n not in _WORDS
    out = _WORDS[n[:-1] if encode else n](t, namespaces)
    return urlencode(F.replace(out, F.lit(" "), F.lit("_")), "WIKI") if encode else out


_WORDS = {
    "pagename": lambda t, n: t["text"], "fullpagename": lambda t, n: prefixed(t), "basepagename": lambda t, n: base(t), "rootpagename": lambda t, n: root(t), "subpagename": lambda t, n: subpage(t),
    "talkpagename": talk, "subjectpagename": subject, "articlepagename": subject,
    "namespace": lambda t, n: t["namespace"], "namespacenumber": lambda t, n: t["ns"].cast("string"), "talkspace": lambda t, n: F.when(t["ns"] < 0, F.lit("")).otherwise(_space(t["ns"].bitwiseOR(1), n)), "subjectspace": lambda t, n: F.when(t["ns"] < 0, t["namespace"]).otherwise(_space(t["ns"] - t["ns"] % 2, n)), "articlespace": lambda t, n: F.when(t["ns"] < 0, t["namespace"]).otherwise(_space(t["ns"] - t["ns"] % 2, n)),
}


def namespace_by(x: Column, namespaces: Mapping[int, str] = NAMESPACES) -> Column:
    """The name of a namespace given by number or name; null for none."""
    by_name = F.try_element_at(_map(_names(namespaces) | {"": 0}), F.lower(F.trim(x)))
    return F.try_element_at(_map(dict(namespaces)), F.coalesce(F.trim(x).try_cast("int"), by_name))
