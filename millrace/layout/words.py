"""Word clouds: font sizes as Columns, then greedy placement on a spiral, one cloud a task."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place(words: list[tuple[str, float, float]], size: tuple[float, float], padding: float = 1.0, spiral: str = "archimedean") -> list[tuple[float, float] | None]:
    """Centres of (text, font size, rotation), the largest first; None where no room is left.

    A word's box is estimated from its length, as no font is drawn here."""
    taken: list[tuple[float, float, float, float]] = []
    out: list[tuple[float, float] | None] = [None] * len(words)
    for i in sorted(range(len(words)), key=lambda k: (-words[k][1], k)):
        text, font, turn = words[i]
        w, h = 0.6 * font * len(text) + 2 * padding, font + 2 * padding
        c, s = abs(math.cos(math.radians(turn))), abs(math.sin(math.radians(turn)))
        w, h = w * c + h * s, w * s + h * c
        for k in range(3000):
            t = 0.1 * k
            if spiral == "rectangular":
                x, y = 4 * t * math.copysign(min(1, abs(math.cos(t)) * 1.4), math.cos(t)), 4 * t * math.copysign(min(1, abs(math.sin(t)) * 1.4), math.sin(t))
            else:
                x, y = t * math.cos(t) * size[0] / size[1], t * math.sin(t)
            box = (x - w / 2, y - h / 2, x + w / 2, y + h / 2)
            if box[0] < -size[0] / 2 or box[1] < -size[1] / 2 or box[2] > size[0] / 2 or box[3] > size[1] / 2:
                if t > max(size):
                    break
                continue
            if not any(box[0] < b[2] and b[0] < box[2] and box[1] < b[3] and b[1] < box[3] for b in taken):
                taken.append(box)
                out[i] = (size[0] / 2 + x, size[1] / 2 + y)
                break
    return out


def wordcloud(df: DataFrame, text: str = "text", fontSize: str | float = "count", fontScale=(10, 50), rotate: str | float = 0.0, size=(900, 500), padding: float = 1.0, spiral: str = "archimedean", groupby=(), output: dict[str, str] | None = None, **_) -> DataFrame:
    """Adds layout_x, layout_y, layout_fontSize and layout_rotate; words without room have null places."""
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("x", "y", "fontSize", "rotate")}
    raw = F.col(fontSize).cast("double") if isinstance(fontSize, str) else F.lit(float(fontSize))
    if isinstance(fontSize, str) and fontScale:
        extent = df.agg(F.min(F.sqrt(raw)).alias("lo"), F.max(F.sqrt(raw)).alias("hi")).first()
        lo, hi = extent.lo or 0.0, extent.hi or 0.0
        raw = F.lit(fontScale[0]) + (F.sqrt(raw) - lo) / (hi - lo) * (fontScale[1] - fontScale[0]) if hi > lo else F.lit(float(fontScale[1]))
    turn = F.col(rotate).cast("double") if isinstance(rotate, str) else F.lit(float(rotate))
    sized, by = tuple(size), list(groupby)
    rows = df.withColumn("__f", F.floor(raw).cast("double")).withColumn("__r", turn).withColumn("__t", F.col(text).cast("string"))
    keys = [F.col(b) for b in by] or [F.lit(0).alias("__one")]
    kinds = "".join(f", `{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["__f", "__t"], ascending=[False, True]).reset_index(drop=True)
        at = place(list(zip(p["__t"], p["__f"], p["__r"], strict=True)), sized, padding, spiral)
        out = p[["__t", *by]].copy()
        out["x"], out["y"] = [a and a[0] for a in at], [a and a[1] for a in at]
        return out

    done = rows.select(*by, "__t", "__f", "__r").groupBy(*keys).applyInPandas(run, "__t string" + kinds + ", x double, y double")
    out = rows.join(done.select(*by, "__t", F.col("x").alias(names["x"]), F.col("y").alias(names["y"])), [*by, "__t"])
    return out.withColumnsRenamed({"__f": names["fontSize"], "__r": names["rotate"]}).drop("__t")
