"""Queries of the store: title search, existence, redirects, lookups by title."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000
PER_PAGE = 500


def search(titles: DataFrame, query: str, column: str = "title", page: int = 1, per_page: int = PER_PAGE, most: int = MOST) -> DataFrame:
    """A page of the titles that match a case-insensitive pattern (a bad one is literal).

    Plain text puts titles that start with it first; then by case-folded title. The cap of ``most``
    matches is the feature; it takes the first in that order, so results are the same each time."""
    try:
        re.compile(query)
    except re.error:
        query = re.escape(query)
    plain = re.fullmatch(r"[\w\s,;:'\"/&%-]*", query) is not None
    found = titles.filter(F.col(column).rlike(f"(?iu){query}"))
    low = F.lower(F.col(column))
    order = [F.when(low.startswith(query.lower()), 0).otherwise(1)] if plain else []
    return found.orderBy(*order, low, F.col(column)).limit(most).offset((page - 1) * per_page).limit(per_page)


def single(found: DataFrame, column: str = "title") -> str | None:
    """The title to go straight to: a sole hit, or two that differ by case only."""
    rows = [r[0] for r in found.select(column).limit(3).collect()]
    return rows[0] if len(rows) == 1 or (len(rows) == 2 and rows[0].lower() == rows[1].lower()) else None


def exists(links: DataFrame, titles: DataFrame, link: str = "target", title: str = "title", output: str = "exists") -> DataFrame:
    """Flags each link by whether its target is a title; one join for all of them."""
    known = titles.select(F.col(title).alias("__t")).distinct()
    return links.join(known, F.col(link) == F.col("__t"), "left").withColumn(output, F.col("__t").isNotNull()).drop("__t")


def missing(links: DataFrame, titles: DataFrame, link: str = "target", title: str = "title") -> DataFrame:
    """Links to nothing."""
    return links.join(titles.select(F.col(title).alias(link)), link, "left_anti")


def resolve(titles: DataFrame, redirects: DataFrame, column: str = "title", hops: int = 2, output: str = "resolved") -> DataFrame:
    """Follows redirects (title, target), at most ``hops`` of them."""
    pairs = redirects.select(F.col("title").alias("__from"), F.col("target").alias("__to"))
    out = titles.withColumn(output, F.col(column))
    for _ in range(hops):
        out = out.join(pairs, F.col(output) == F.col("__from"), "left").withColumn(output, F.coalesce("__to", output)).drop("__from", "__to")
    return out


def lookup(titles: DataFrame, articles: DataFrame, column: str = "title") -> DataFrame:
    """The articles of titles."""
    return articles.join(titles.select(F.col(column).alias("title")).distinct(), "title", "left_semi")
