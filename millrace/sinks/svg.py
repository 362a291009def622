"""Marks as SVG: an element a datum, a path a group of points, and a document of a chart's elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import encode_entities

#: The SVG names of a mark's visual properties.
STYLE = {"fill": "fill", "fillOpacity": "fill-opacity", "stroke": "stroke", "strokeWidth": "stroke-width", "strokeOpacity": "stroke-opacity", "opacity": "opacity", "font": "font-family", "fontSize": "font-size", "fontWeight": "font-weight"}


def number(x: Column) -> Column:
    """Up to three decimals, without needless zeros."""
    text = F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def _attributes(df: DataFrame, places: dict[str, Column]) -> Column:
    style = {svg: encode_entities(F.col(name).cast("string")) for name, svg in STYLE.items() if name in df.columns}
    own = {n: number(c) for n, c in places.items()} | style
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f' {n}="'), c, F.lit('"'))).otherwise(F.lit("")) for n, c in own.items()]
    return F.concat(*parts) if parts else F.lit("")


def _at(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def elements(df: DataFrame, kind: str, output: str = "svg") -> DataFrame:
    """Adds the element of each row's mark: rect, symbol (a circle of ``size`` square pixels), rule, path, text or image."""
    x, y = _at(df, "x"), _at(df, "y")
    if kind in ("rect", "image"):
        w, h = _at(df, "width"), _at(df, "height")
        top = F.least(y, _at(df, "y2")) if "y2" in df.columns else y
        left = F.least(x, _at(df, "x2")) if "x2" in df.columns else x
        link = F.concat(F.lit(' href="'), encode_entities(F.col("url")), F.lit('"')) if kind == "image" else F.lit("")
        body = F.concat(F.lit(f"<{kind}"), link, _attributes(df, {"x": left, "y": top, "width": w, "height": h}), F.lit(" />"))
    elif kind == "symbol":
        body = F.concat(F.lit("<circle"), _attributes(df, {"cx": x, "cy": y, "r": F.sqrt(_at(df, "size", 100.0) / F.lit(3.141592653589793))}), F.lit(" />"))
    elif kind == "rule":
        body = F.concat(F.lit("<line"), _attributes(df, {"x1": x, "y1": y, "x2": F.coalesce(F.col("x2"), x) if "x2" in df.columns else x, "y2": F.coalesce(F.col("y2"), y) if "y2" in df.columns else y}), F.lit(" />"))
    elif kind == "path":
        body = F.concat(F.lit('<path d="'), F.col("path"), F.lit('"'), _attributes(df, {}), F.lit(" />"))
    elif kind == "text":
        body = F.concat(F.lit("<text"), _attributes(df, {"x": x, "y": y}), F.lit(">"), encode_entities(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit("</text>"))
    else:
        raise ValueError(f"{kind!r} isn't a mark of single rows")
    return df.withColumn(output, body)


def paths(df: DataFrame, by: Sequence[str], order: str, kind: str = "line", output: str = "svg") -> DataFrame:
    """A path a group through its points in order; an area goes back along ``y2``. A path is as long as its group."""
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), number(F.col("x")).alias("x"), number(F.col("y")).alias("y"), *([number(F.col("y2")).alias("z")] if kind == "area" else []))))
    style = [F.first(s, ignorenulls=True).alias(s) for s in STYLE if s in df.columns and s not in by]
    rows = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*by).agg(points.alias("__p"), *style)
    there = F.array_join(F.transform("__p", lambda p: F.concat(p["x"], F.lit(","), p["y"])), "L")
    back = F.concat(F.lit("L"), F.array_join(F.transform(F.reverse("__p"), lambda p: F.concat(p["x"], F.lit(","), p["z"])), "L"), F.lit("Z")) if kind == "area" else F.lit("")
    rows = rows.withColumn("path", F.concat(F.lit("M"), there, back)).drop("__p")
    if kind == "line" and "fill" not in rows.columns:
        rows = rows.withColumn("fill", F.lit("none"))
    return elements(rows, "path", output)


def document(rows: DataFrame, order: str, width: float, height: float, column: str = "svg", by: Sequence[str] = ()) -> DataFrame:
    """One SVG text of the elements in order, or one a chart of ``by``."""
    head = F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">')
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("s")))), lambda e: e["s"])
    return rows.groupBy(*by).agg(F.concat(head, F.array_join(body, ""), F.lit("</svg>")).alias(column))
