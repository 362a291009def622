"""Treemaps: sums up the tree, then squarified rectangles, one tree a task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import ORDER

GOLDEN = (1 + math.sqrt(5)) / 2


def squarify(values: Sequence[float], x: float, y: float, w: float, h: float, ratio: float = GOLDEN) -> list[tuple[float, float, float, float]]:
    """(x, y, dx, dy) of each value, in order: rows along the short side as long as the worst ratio improves."""
    total = sum(values)
    if total <= 0 or w <= 0 or h <= 0:
        return [(x, y, 0.0, 0.0) for _ in values]
    scale = w * h / total
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(values):
        side = min(w, h)
        row: list[float] = []
        worst = math.inf
        j = i
        while j < len(values):
            area = values[j] * scale
            if area > 0 or not row:
                new = [*row, area]
                s = sum(new)
                lo, hi = min(a for a in new if a > 0) if any(new) else 0, max(new)
                bad = max(side * side * hi * ratio / (s * s), s * s / (side * side * lo * ratio)) if s > 0 and lo > 0 else math.inf
                if row and bad > worst:
                    break
                worst = bad
            row.append(area)
            j += 1
        s = sum(row)
        thick = s / side if side else 0.0
        at = 0.0
        for a in row:
            length = a / thick if thick else 0.0
            out.append((x + at, y, length, thick) if w <= h else (x, y + at, thick, length))
            at += length
        if w <= h:
            y, h = y + thick, h - thick
        else:
            x, w = x + thick, w - thick
        i = j
    return out


def _split(mode: str, values: list[float], x: float, y: float, w: float, h: float, depth: int, ratio: float) -> list[tuple[float, float, float, float]]:
    if mode == "squarify":
        return squarify(values, x, y, w, h, ratio)
    across = mode == "dice" or (mode == "slice-dice" and depth % 2 == 0)
    total = sum(values) or 1.0
    out, at = [], 0.0
    for v in values:
        share = v / total
        out.append((x + at * w, y, share * w, h) if across else (x, y + at * h, w, share * h))
        at += share
    return out


def layout(rows: pd.DataFrame, value: str, parent: str, size: tuple[float, float], ratio: float, round_: bool, padding: float, mode: str, sort: bool, key: str) -> pd.DataFrame:
    """One tree of rows, parents by row number."""
    rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
    at = {int(k): i for i, k in enumerate(rows[key])}
    kids: dict[int, list[int]] = {}
    roots = []
    for i, p in enumerate(rows[parent]):
        if pd.isna(p):
            roots.append(i)
        else:
            kids.setdefault(at[int(p)], []).append(i)
    own = rows[value].fillna(0).astype(float).tolist()
    order, depth = [], {}
    stack = [(r, 0) for r in reversed(roots)]
    while stack:
        i, d = stack.pop()
        order.append(i)
        depth[i] = d
        stack += [(k, d + 1) for k in reversed(kids.get(i, []))]
    total = list(own)
    for i in reversed(order):
        if i in kids:
            total[i] = sum(total[k] for k in kids[i])
    box = {r: (0.0, 0.0, float(size[0]), float(size[1])) for r in roots}
    for i in order:
        x, y, w, h = box[i]
        if i in kids:
            some = sorted(kids[i], key=lambda k: -total[k]) if sort else kids[i]
            inner = (x + padding, y + padding, max(w - 2 * padding, 0.0), max(h - 2 * padding, 0.0))
            for k, b in zip(some, _split(mode, [total[k] for k in some], *inner, depth[i], ratio), strict=True):
                box[k] = tuple(float(round(a)) for a in (b[0], b[1])) + tuple(float(round(b[j] + b[j + 2]) - round(b[j])) for j in (0, 1)) if round_ else b
    frame = pd.DataFrame([box[i] for i in range(len(rows))], columns=["x", "y", "dx", "dy"])
    frame["depth"] = [depth[i] for i in range(len(rows))]
    frame["value"] = total
    frame[key] = rows[key].to_numpy()
    return frame


def treemap(df: DataFrame, field: str = "value", parent: str = "parent", size: Sequence[float] = (500, 500), ratio: float = GOLDEN, round: bool = True, padding: float = 0.0, mode: str = "squarify", sort=("-value",), groupby: Sequence[str] = (), output: dict[str, str] | None = None, **_) -> DataFrame:
    """Adds layout_x, layout_y, layout_width, layout_height and layout_depth to the rows of trees.

    Rows have their number in the order column and their parent's in ``parent``. A tree is laid out
    in one task; ``groupby`` names the trees, which spread over tasks."""
    groups = list(groupby)
    sized = tuple(size)
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("x", "y", "width", "height", "depth")}
    narrow = df.select(*groups, F.col(ORDER).cast("long").alias("__k"), F.col(parent).cast("double").alias("__p"), F.col(field).cast("double").alias("__v"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = layout(rows, "__v", "__p", sized, ratio, round, padding, mode, bool(sort), "__k")
        for g in groups:
            out[g] = rows[g].iloc[0]
        return out

    kinds = "".join(f", `{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    done = narrow.groupBy(*groups).applyInPandas(run, "x double, y double, dx double, dy double, depth int, value double, __k long" + kinds)
    done = done.select(*groups, "__k", F.col("x").alias(names["x"]), F.col("y").alias(names["y"]), F.col("dx").alias(names["width"]), F.col("dy").alias(names["height"]), F.col("depth").alias(names["depth"]))
    return df.withColumn("__k", F.col(ORDER).cast("long")).join(done, [*groups, "__k"]).drop("__k")
