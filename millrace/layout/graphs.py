"""Force-directed layout of a graph: nodes and links tables, one graph a task."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import ORDER


class _Quad:
    """A Barnes-Hut quadtree over points: total charge and its centre by cell."""

    __slots__ = ("x0", "y0", "x1", "kids", "point", "charge", "cx", "cy", "n")

    def __init__(self, x0: float, y0: float, x1: float) -> None:
        self.x0, self.y0, self.x1, self.kids, self.point, self.n = x0, y0, x1, None, None, 0
        self.charge = self.cx = self.cy = 0.0

    def add(self, i: int, x: float, y: float, depth: int = 0) -> None:
        self.cx, self.cy, self.n = self.cx + x, self.cy + y, self.n + 1
        if self.kids is None:
            if self.point is None or depth > 40:
                self.point = [*(self.point or []), (i, x, y)]
                return
            held, self.point, self.kids = self.point, None, [None] * 4
            for p in held:
                self._down(*p, depth)
        self._down(i, x, y, depth)

    def _down(self, i: int, x: float, y: float, depth: int) -> None:
        half = (self.x1 - self.x0) / 2
        right, low = x >= self.x0 + half, y >= self.y0 + half
        k = right + 2 * low
        if self.kids[k] is None:
            a, b = self.x0 + half * right, self.y0 + half * low
            self.kids[k] = _Quad(a, b, a + half)
        self.kids[k].add(i, x, y, depth + 1)


def simulate(n: int, links: list[tuple[int, int]], size: tuple[float, float] = (500, 500), alpha: float = 0.1, charge: float = -30.0, friction: float = 0.9, gravity: float = 0.1, iterations: int = 500, theta: float = 0.8, link_distance: float = 20.0, link_strength: float = 1.0, start: np.ndarray | None = None, fixed: list[bool] | None = None, seed: int = 0) -> np.ndarray:
    """Positions after Verlet steps; stops when alpha falls under 0.005."""
    rnd = random.Random(seed)
    pos = np.array([[rnd.random() * size[0], rnd.random() * size[1]] for _ in range(n)]) if start is None else start.astype(float).copy()
    if not n:
        return pos
    old = pos.copy()
    weight = np.zeros(n)
    for a, b in links:
        weight[a] += 1
        weight[b] += 1
    held = np.array(fixed) if fixed is not None else np.zeros(n, bool)
    for _ in range(iterations):
        alpha *= 0.99
        if alpha < 0.005:
            break
        for a, b in links:
            d = pos[b] - pos[a]
            dist = math.hypot(*d)
            if dist:
                d = d * (alpha * link_strength * (dist - link_distance) / dist)
                share = weight[a] / (weight[a] + weight[b])
                pos[b] -= d * share
                pos[a] += d * (1 - share)
        if gravity:
            pos += (np.array(size) / 2 - pos) * (alpha * gravity)
        if charge:
            if n <= 1500:
                # Every pair at once: exact, and quicker than a tree at this size.
                d = pos[None] - pos[:, None]
                r2 = (d**2).sum(2)
                np.fill_diagonal(r2, 1.0)
                k = charge * alpha / np.maximum(r2, 1e-6)
                np.fill_diagonal(k, 0.0)
                old -= (d * k[:, :, None]).sum(1)
            else:
                _repel(pos, old, charge * alpha, theta)
        now = pos.copy()
        pos = np.where(held[:, None], old, pos - (old - pos) * friction)
        old = np.where(held[:, None], old, now)
    return pos


def _repel(pos: np.ndarray, old: np.ndarray, k: float, theta: float) -> None:
    lo = pos.min(0)
    side = float((pos.max(0) - lo).max()) + 1e-9
    root = _Quad(float(lo[0]), float(lo[1]), float(lo[0]) + side)
    for i, (x, y) in enumerate(pos):
        root.add(i, float(x), float(y))
    for i, (x, y) in enumerate(pos):
        stack = [root]
        while stack:
            q = stack.pop()
            dx, dy = q.cx / q.n - x, q.cy / q.n - y
            r2 = dx * dx + dy * dy
            width = q.x1 - q.x0
            if q.kids is not None and width * width >= theta * theta * r2:
                stack += [c for c in q.kids if c is not None]
                continue
            if q.kids is None:
                for j, px, py in q.point:
                    if j != i:
                        dx, dy = px - x, py - y
                        f = k / max(dx * dx + dy * dy, 1e-6)
                        old[i, 0] -= dx * f
                        old[i, 1] -= dy * f
            else:
                f = k * q.n / max(r2, 1e-6)
                old[i, 0] -= dx * f
                old[i, 1] -= dy * f


def force(nodes: DataFrame, links: DataFrame, size=(500, 500), groupby=(), source: str = "source", target: str = "target", output: dict[str, str] | None = None, linkDistance: float = 20.0, linkStrength: float = 1.0, **options) -> DataFrame:
    """Adds layout_x and layout_y to nodes; links name rows by number. ``groupby`` names graphs, which spread over tasks."""
    groups = list(groupby)
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("x", "y")}
    sized = tuple(size)
    own = {k: v for k, v in options.items() if k in ("alpha", "charge", "friction", "gravity", "iterations", "theta")}
    by = groups or ["__one"]
    left = nodes.select(*groups, F.col(ORDER).cast("long").alias("__k")).withColumn("__one", F.lit(0))
    right = links.select(*groups, F.col(source).cast("long").alias("s"), F.col(target).cast("long").alias("t")).withColumn("__one", F.lit(0))
    kinds = "".join(f", `{g}` {nodes.schema[g].dataType.simpleString()}" for g in groups)

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("__k").reset_index(drop=True)
        place = {k: i for i, k in enumerate(a["__k"])}
        pairs = [(place[s], place[t]) for s, t in sorted(zip(b["s"], b["t"], strict=True)) if s in place and t in place]
        p = simulate(len(a), pairs, sized, link_distance=linkDistance, link_strength=linkStrength, **own)
        out = pd.DataFrame({"__k": a["__k"], "x": p[:, 0], "y": p[:, 1]})
        for g, v in zip(groups, key, strict=False):
            out[g] = v
        return out

    done = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, "__k long, x double, y double" + kinds)
    done = done.select(*groups, "__k", F.col("x").alias(names["x"]), F.col("y").alias(names["y"]))
    return nodes.withColumn("__k", F.col(ORDER).cast("long")).join(done, [*groups, "__k"]).drop("__k")
