"""Paths between two points as SVG text: eight closed forms, all Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = ("line", "curve", "diagonal", "diagonalX", "diagonalY", "cornerX", "cornerY", "cornerR", "diagonalR")


def _text(*parts: str | Column) -> Column:
    from millrace.plans.expressions import number_text

    return F.concat(*[F.lit(p) if isinstance(p, str) else number_text(F.round(p, 6)) for p in parts])


def linkpath(df: DataFrame, sourceX: str = "_source.layout_x", sourceY: str = "_source.layout_y", targetX: str = "_target.layout_x", targetY: str = "_target.layout_y", shape: str = "line", tension: float = 0.2, output: dict[str, str] | None = None, **_) -> DataFrame:
    """Adds layout_path. cornerR and diagonalR read x as an angle and y as a radius."""
    sx, sy, tx, ty = (F.col(c).cast("double") for c in (sourceX, sourceY, targetX, targetY))
    if shape == "line":
        path = _text("M", sx, ",", sy, "L", tx, ",", ty)
    elif shape == "curve":
        dx, dy = tx - sx, ty - sy
        ix, iy = (dx + dy) * tension, (dy - dx) * tension
        path = _text("M", sx, ",", sy, "C", sx + ix, ",", sy + iy, " ", tx + iy, ",", ty - ix, " ", tx, ",", ty)
    elif shape in ("diagonal", "diagonalX"):
        m = (sx + tx) / 2
        path = _text("M", sx, ",", sy, "C", m, ",", sy, " ", m, ",", ty, " ", tx, ",", ty)
    elif shape == "diagonalY":
        m = (sy + ty) / 2
        path = _text("M", sx, ",", sy, "C", sx, ",", m, " ", tx, ",", m, " ", tx, ",", ty)
    elif shape == "cornerX":
        path = _text("M", sx, ",", sy, "V", ty, "H", tx)
    elif shape == "cornerY":
        path = _text("M", sx, ",", sy, "H", tx, "V", ty)
    elif shape == "cornerR":
        sc, ss, tc, ts = F.cos(sx), F.sin(sx), F.cos(tx), F.sin(tx)
        sweep = F.when(F.abs(tx - sx) > 3.141592653589793, tx <= sx).otherwise(tx > sx).cast("int").cast("string")
        path = F.concat(_text("M", sy * sc, ",", sy * ss, "A", sy, ",", sy, " 0 0,"), sweep, _text(" ", sy * tc, ",", sy * ts, "L", ty * tc, ",", ty * ts))
    elif shape == "diagonalR":
        sc, ss, tc, ts, m = F.cos(sx), F.sin(sx), F.cos(tx), F.sin(tx), (sy + ty) / 2
        path = _text("M", sy * sc, ",", sy * ss, "C", m * sc, ",", m * ss, " ", m * tc, ",", m * ts, " ", ty * tc, ",", ty * ts)
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return df.withColumn((output or {}).get("path", "layout_path"), path)
