"""URIs as Columns: parts, query strings, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import urldecode, urlencode

_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^/?#@]*)@)?([^/?#:]*|\[[^\]]*\])(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARTS = ("protocol", "user", "host", "port", "path", "query", "fragment")


def parts(uri: Column) -> Column:
    """struct of protocol, user, host, port, path, query and fragment; absent ones are null."""
    found = [F.nullif(F.regexp_extract(uri, _URI, i + 1), F.lit("")).alias(n) for i, n in enumerate(PARTS)]
    return F.struct(*found)


def valid(uri: Column) -> Column:
    """A host needs a slash or nothing before the path; without one the path can't begin with two slashes."""
    p = parts(uri)
    return uri.rlike(_URI) & F.when(p["host"].isNotNull(), p["path"].isNull() | p["path"].startswith("/")).otherwise(p["port"].isNull() & ~F.coalesce(p["path"].startswith("//"), F.lit(False)))


def query_map(query: Column) -> Column:
    """A query string as a map, values decoded; the last of equal keys counts."""
    pairs = F.filter(F.split(query, "&", -1), lambda x: x != "")
    key = lambda x: urldecode(F.substring_index(x, "=", 1))
    value = lambda x: F.when(F.instr(x, "=") > 0, urldecode(F.regexp_replace(x, "^[^=]*=", ""))).otherwise(F.lit(""))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: key(y) == key(x)))
    return F.map_from_arrays(F.transform(last, key), F.transform(last, value))


def build_query(fields: dict[str, Column]) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(k + "="), urlencode(v.cast("string"), "QUERY")) for k, v in fields.items()])
