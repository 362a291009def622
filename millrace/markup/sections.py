"""Labelled-section transclusion: parts of a page by label, without a label, or under a heading."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.markup.tokens import plain_text, tokenize


def _marks(label: str) -> re.Pattern:
    name = re.escape(label)
    return re.compile(rf'<section\s+begin\s*=\s*"?{name}"?\s*/>(.*?)(?:<section\s+end\s*=\s*"?{name}"?\s*/>|$)', re.S | re.I)


def labelled(text: str, label: str) -> str:
    """The text of all sections of a label; other section marks inside go."""
    found = "".join(m[1] for m in _marks(label).finditer(text))
    return re.sub(r"<section\s+(?:begin|end)\s*=[^>]*/>", "", found, flags=re.I)


def unlabelled(text: str, label: str, instead: str = "") -> str:
    """The page without the sections of a label."""
    out = _marks(label).sub(lambda m: instead, text)
    return re.sub(r"<section\s+(?:begin|end)\s*=[^>]*/>", "", out, flags=re.I)


def under_heading(text: str, heading: str, until: str | None = None) -> str:
    """From a heading's line to the next heading of its level or above, or to the heading ``until``."""
    want, level, start = heading.strip().lower(), 0, -1
    for t in tokenize(text):
        if t.kind != "heading":
            continue
        shown = plain_text(t.data["content"]).strip().lower()
        if start < 0:
            if shown == want:
                level, start = t.data["level"], t.end
        elif (until is not None and shown == until.strip().lower()) or (until is None and t.data["level"] <= level):
            return text[start : t.start].strip("\n")
    return text[start:].strip("\n") if start >= 0 else ""


def column(kind: str, text: Column, name: str, more: str | None = None) -> Column:
    """``labelled``, ``unlabelled`` or ``under_heading`` of a column of pages, in Arrow batches."""
    f = {"labelled": lambda t: labelled(t, name), "unlabelled": lambda t: unlabelled(t, name, more or ""), "under_heading": lambda t: under_heading(t, name, more)}[kind]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run(text)
