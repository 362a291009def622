"""Cartographic projections of points and GeoJSON paths.

A projection is one formula over a small set of functions that exist for Columns and for numpy alike.
Closed forms are evaluated as Columns; iterative ones in Arrow batches. x follows longitude and y
latitude, in radians, before scale and translation."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PI = math.pi
HALF = PI / 2
EPS = 1e-9


class _Numpy:
    sin, cos, tan, asin, acos, atan, atan2, sqrt, abs, exp, log, sign = (staticmethod(f) for f in (np.sin, np.cos, np.tan, np.arcsin, np.arccos, np.arctan, np.arctan2, np.sqrt, np.abs, np.exp, np.log, np.sign))

    @staticmethod
    def where(test, a, b):
        return np.where(test, a, b)

    @staticmethod
    def clip(x, lo, hi):
        return np.clip(x, lo, hi)


class _Columns:
    sin, cos, tan, asin, acos, atan, atan2, sqrt, abs, exp, log, sign = (staticmethod(f) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2, F.sqrt, F.abs, F.exp, F.log, F.signum))

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def clip(x, lo, hi):
        return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


Raw = Callable
CLOSED: dict[str, Raw] = {}
ITERATIVE: dict[str, Raw] = {}


def _closed(*names: str):
    def add(f: Raw) -> Raw:
        for n in names:
            CLOSED[n] = f
        return f

    return add


def _iterative(*names: str):
    def add(f: Raw) -> Raw:
        for n in names:
            ITERATIVE[n] = f
        return f

    return add


# --- cylindrical and pseudocylindrical ------------------------------------------------------------


@_closed("equirectangular")
def _equirectangular(m, l, p, o):
    return l, p


@_closed("mercator")
def _mercator(m, l, p, o):
    return l, m.log(m.tan((HALF + m.clip(p, -HALF + 1e-6, HALF - 1e-6)) / 2))


@_closed("transverseMercator")
def _transverse_mercator(m, l, p, o):
    return m.log(m.tan((HALF + m.clip(m.asin(m.clip(m.cos(p) * m.sin(l), -1.0, 1.0)), -HALF + 1e-6, HALF - 1e-6)) / 2)), m.atan2(m.sin(p), m.cos(p) * m.cos(l))


@_closed("miller")
def _miller(m, l, p, o):
    return l, 1.25 * m.log(m.tan(PI / 4 + 0.4 * p))


@_closed("cylindricalEqualArea")
def _cylindrical_equal_area(m, l, p, o):
    c = math.cos(o.get("parallel", 38.58) * PI / 180)
    return l * c, m.sin(p) / c


@_closed("cylindricalStereographic")
def _cylindrical_stereographic(m, l, p, o):
    c = math.cos(o.get("parallel", 0.0) * PI / 180)
    return l * c, (1 + c) * m.tan(p / 2)


@_closed("sinusoidal")
def _sinusoidal(m, l, p, o):
    return l * m.cos(p), p


@_closed("patterson")
def _patterson(m, l, p, o):
    q = p * p
    return l, p * (1.0148 + q * q * (0.23185 + q * (-0.14499 + q * 0.02406)))


@_closed("naturalEarth")
def _natural_earth(m, l, p, o):
    q = p * p
    r = q * q
    return l * (0.8707 - 0.131979 * q + r * (-0.013791 + r * (0.003971 * q - 0.001529 * r))), p * (1.007226 + q * (0.015085 + r * (-0.044475 + 0.028874 * q - 0.005916 * r)))


@_closed("collignon")
def _collignon(m, l, p, o):
    a = m.sqrt(m.clip(1 - m.sin(p), 0.0, 2.0))
    return 2 / math.sqrt(PI) * l * a, math.sqrt(PI) * (1 - a)


@_closed("craster")
def _craster(m, l, p, o):
    r = math.sqrt(3)
    return r * l * (2 * m.cos(2 * p / 3) - 1) / math.sqrt(PI), r * math.sqrt(PI) * m.sin(p / 3)


@_closed("eckert1")
def _eckert1(m, l, p, o):
    a = math.sqrt(8 / (3 * PI))
    return a * l * (1 - m.abs(p) / PI), a * p


@_closed("eckert2")
def _eckert2(m, l, p, o):
    a = m.sqrt(4 - 3 * m.sin(m.abs(p)))
    return 2 / math.sqrt(6 * PI) * l * a, m.sign(p) * math.sqrt(2 * PI / 3) * (2 - a)


@_closed("eckert3")
def _eckert3(m, l, p, o):
    k = math.sqrt(PI * (4 + PI))
    return 2 / k * l * (1 + m.sqrt(m.clip(1 - 4 * p * p / (PI * PI), 0.0, 1.0))), 4 / k * p


@_closed("eckert5")
def _eckert5(m, l, p, o):
    k = math.sqrt(2 + PI)
    return l * (1 + m.cos(p)) / k, 2 * p / k


@_closed("fahey")
def _fahey(m, l, p, o):
    t = m.tan(p / 2)
    return l * math.cos(35 * PI / 180) * m.sqrt(m.clip(1 - t * t, 0.0, 1.0)), (1 + math.cos(35 * PI / 180)) * t


@_closed("foucaut")
def _foucaut(m, l, p, o):
    k = p / 2
    c = m.cos(k)
    return 2 * l / math.sqrt(PI) * m.cos(p) * c * c, math.sqrt(PI) * m.tan(k)


@_closed("kavrayskiy7")
def _kavrayskiy7(m, l, p, o):
    return 3 * l / (2 * PI) * m.sqrt(m.clip(PI * PI / 3 - p * p, 0.0, 10.0)), p


@_closed("wagner6")
def _wagner6(m, l, p, o):
    return l * m.sqrt(m.clip(1 - 3 * p * p / (PI * PI), 0.0, 1.0)), p


@_closed("wagner7")
def _wagner7(m, l, p, o):
    s = 0.90631 * m.sin(p)
    c0 = m.sqrt(1 - s * s)
    t = l / 3
    c1 = m.sqrt(2 / (1 + c0 * m.cos(t)))
    return 2.66723 * c0 * c1 * m.sin(t), 1.24104 * s * c1


@_closed("times")
def _times(m, l, p, o):
    t = m.tan(p / 2)
    s = m.sin(PI / 4 * t)
    return l * (0.74482 - 0.34588 * s * s), 1.70711 * t


@_closed("laskowski")
def _laskowski(m, l, p, o):
    a, b = l * l, p * p
    return l * (0.975534 + b * (-0.119161 + a * -0.0143059 + b * -0.0547009)), p * (1.00384 + a * (0.0802894 + b * -0.02855 + a * 0.000199025) + b * (0.0998909 + b * -0.0491032))


@_closed("loximuthal")
def _loximuthal(m, l, p, o):
    p0 = o.get("parallel", 40.0) * PI / 180
    y = p - p0
    d = m.log(m.tan(PI / 4 + m.clip(p, -HALF + 1e-6, HALF - 1e-6) / 2) / math.tan(PI / 4 + p0 / 2))
    near = m.abs(y) < EPS
    return m.where(near, l * math.cos(p0), l * y / m.where(m.abs(d) < 1e-12, d * 0 + 1.0, d)), y


@_closed("larrivee")
def _larrivee(m, l, p, o):
    return l * (1 + m.sqrt(m.cos(p))) / 2, p / (m.cos(p / 2) * m.cos(l / 6))


@_closed("craig")
def _craig(m, l, p, o):
    p0 = o.get("parallel", 0.0) * PI / 180
    s = m.sin(l)
    k = m.where(m.abs(s) < EPS, s * 0 + 1.0, l / m.where(m.abs(s) < EPS, s * 0 + 1.0, s))
    return l, k * (m.sin(p) * m.cos(l) - math.tan(p0) * m.cos(p))


@_closed("ginzburg4")
def _ginzburg4(m, l, p, o):
    return _ginzburg_polynomial(m, l, p, 2.8284, -1.6988, 0.75432, -0.18071, 1.76003, -0.38914, 0.042555)


def _ginzburg_polynomial(m, l, p, a, b, c, d, e, f, g):
    q = p * p
    return l * (a + q * (b + q * (c + q * d))), p * (e + q * (f + q * g))


@_closed("ginzburg5")
def _ginzburg5(m, l, p, o):
    return _ginzburg_polynomial(m, l, p, 2.583819, -0.835827, 0.170354, -0.038094, 1.543313, -0.411435, 0.082742)


@_closed("ginzburg6")
def _ginzburg6(m, l, p, o):
    return _ginzburg_polynomial(m, l, p, 5 / 6 * PI, -0.62636, -0.0344, 0.0, 1.3493, -0.05524, 0.0)


@_closed("ginzburg8")
def _ginzburg8(m, l, p, o):
    a, b = l * l, p * p
    return l * (1 - 0.162388 * b) * (0.87 - 0.000952426 * a * a), p * (1 + b / 12)


@_closed("ginzburg9")
def _ginzburg9(m, l, p, o):
    return _ginzburg_polynomial(m, l, p, 2.6516, -0.76534, 0.19123, -0.047094, 1.36289, -0.13965, 0.031762)


# --- azimuthal --------------------------------------------------------------------------------------


def _over(m, a: float, b):
    """a / b, infinite where b is 0: Spark's own division fails there or gives null."""
    zero = b == 0
    return m.where(zero, math.inf, a / m.where(zero, 1.0, b))


def _azimuthal(scale):
    """The point opposite the centre isn't moved: its scale is infinite, but for the equidistant map's."""

    def raw(m, l, p, o):
        k = scale(m, m.cos(l) * m.cos(p))
        return k * m.cos(p) * m.sin(l), k * m.sin(p)

    return raw


CLOSED["azimuthalEqualArea"] = _azimuthal(lambda m, c: m.sqrt(_over(m, 2.0, 1 + c)))
CLOSED["azimuthalEquidistant"] = _azimuthal(lambda m, c: m.where(m.acos(c) < EPS, c * 0 + 1.0, m.acos(c) / m.sin(m.where(m.acos(c) < EPS, c * 0 + 1.0, m.acos(c)))))
CLOSED["gnomonic"] = _azimuthal(lambda m, c: 1 / c)
CLOSED["orthographic"] = _azimuthal(lambda m, c: c * 0 + 1.0)
CLOSED["stereographic"] = _azimuthal(lambda m, c: _over(m, 1.0, 1 + c))


@_closed("satellite")
def _satellite(m, l, p, o):
    d = o.get("distance", 2.0)
    k = (d - 1) / (d - m.cos(l) * m.cos(p))
    return k * m.cos(p) * m.sin(l), k * m.sin(p)


@_closed("aitoff")
def _aitoff(m, l, p, o):
    c = m.cos(p)
    a = m.acos(m.clip(c * m.cos(l / 2), -1.0, 1.0))
    k = m.where(a < EPS, a * 0 + 1.0, a / m.sin(m.where(a < EPS, a * 0 + 1.0, a)))
    return 2 * c * m.sin(l / 2) * k, m.sin(p) * k


@_closed("winkel3")
def _winkel3(m, l, p, o):
    x, y = _aitoff(m, l, p, o)
    return (x + l / HALF) / 2, (y + p) / 2


@_closed("hammer")
def _hammer(m, l, p, o):
    b = o.get("coefficient", 2.0)
    x, y = CLOSED["azimuthalEqualArea"](m, l / b, p, o)
    return x * b, y


@_closed("wiechel")
def _wiechel(m, l, p, o):
    c, s = m.cos(l), m.cos(p) * m.sin(l)
    z = m.cos(l) * m.cos(p)
    k = m.sqrt(2 / (1 + m.clip(z, -1 + 1e-12, 1.0)))
    x, y = k * s, k * m.sin(p)
    h = m.sqrt(x * x + y * y) / 2
    h = m.clip(h, 0.0, 1.0)
    q = m.sqrt(1 - h * h)
    return x * q + y * h, y * q - x * h


@_closed("august")
def _august(m, l, p, o):
    t = m.tan(p / 2)
    k = m.sqrt(m.clip(1 - t * t, 0.0, 1.0))
    c = 1 + k * m.cos(l / 2)
    x, y = m.sin(l / 2) * k / c, t / c
    return 4 / 3 * x * (3 + x * x - 3 * y * y), 4 / 3 * y * (3 + 3 * x * x - y * y)


@_closed("baker")
def _baker(m, l, p, o):
    q = m.abs(p)
    low = m.log(m.tan(PI / 4 + m.clip(q, 0.0, HALF - 1e-6) / 2))
    high_x = l * m.cos(q) * (2 * math.sqrt(2) - 1 / m.where(m.sin(q) < 1e-6, q * 0 + 1.0, m.sin(q)))
    high_y = m.sign(p) * (2 * math.sqrt(2) * (q - PI / 4) - m.log(m.tan(m.clip(q, 1e-6, PI) / 2)))
    return m.where(q < PI / 4, l, high_x), m.where(q < PI / 4, m.sign(p) * low, high_y)


@_closed("littrow")
def _littrow(m, l, p, o):
    return m.sin(l) / m.cos(p), m.tan(p) * m.cos(l)


@_closed("lagrange")
def _lagrange(m, l, p, o):
    n = o.get("spacing", 0.5)
    q = m.clip(p, -HALF + 1e-9, HALF - 1e-9)
    a = (1 + m.sin(q)) / (1 - m.sin(q))
    v = m.exp(m.log(a) * (n / 2))
    c = (v + 1 / v) / 2 + m.cos(l * n)
    return 2 * m.sin(l * n) / c, (v - 1 / v) / c


@_closed("bonne")
def _bonne(m, l, p, o):
    p0 = o.get("parallel", 45.0) * PI / 180
    cot = 1 / math.tan(p0)
    r = cot + p0 - p
    e = m.where(m.abs(r) < EPS, r * 0, l * m.cos(p) / m.where(m.abs(r) < EPS, r * 0 + 1.0, r))
    return r * m.sin(e), cot - r * m.cos(e)


@_closed("polyconic")
def _polyconic(m, l, p, o):
    near = m.abs(p) < EPS
    q = m.where(near, p * 0 + 1.0, p)
    t, k = m.tan(q), l * m.sin(q)
    return m.where(near, l, m.sin(k) / t), m.where(near, p, q + (1 - m.cos(k)) / t)


@_closed("rectangularPolyconic")
def _rectangular_polyconic(m, l, p, o):
    p0 = o.get("parallel", 0.0) * PI / 180
    s = math.sin(p0)
    a = m.tan(l / 2 * s) / s if abs(s) > EPS else l / 2
    near = m.abs(p) < EPS
    q = m.where(near, p * 0 + 1.0, p)
    e = 2 * m.atan(a * m.sin(q))
    t = 1 / m.tan(q)
    return m.where(near, 2 * a, m.sin(e) * t), m.where(near, p - p0, q + (1 - m.cos(e)) * t - p0)


@_closed("hammerRetroazimuthal")
def _hammer_retroazimuthal(m, l, p, o):
    p0 = o.get("parallel", 45.0) * PI / 180
    s0, c0 = math.sin(p0), math.cos(p0)
    z = m.acos(m.clip(s0 * m.sin(p) + c0 * m.cos(p) * m.cos(l), -1.0, 1.0))
    k = m.where(z < EPS, z * 0 + 1.0, z / m.sin(m.where(z < EPS, z * 0 + 1.0, z)))
    return k * c0 * m.sin(l), k * (s0 * m.cos(p) - c0 * m.sin(p) * m.cos(l))


@_closed("gilbert")
def _gilbert(m, l, p, o):
    return CLOSED["orthographic"](m, l / 2, m.asin(m.clip(m.tan(p / 2), -1.0, 1.0)), o)


# --- conic ----------------------------------------------------------------------------------------------


def _parallels(o):
    a, b = o.get("parallels", [29.5, 45.5])
    return a * PI / 180, b * PI / 180


@_closed("conicEqualArea", "albers")
def _conic_equal_area(m, l, p, o):
    a, b = _parallels(o)
    n = (math.sin(a) + math.sin(b)) / 2
    if abs(n) < EPS:
        c = math.cos(a)
        return l * c, m.sin(p) / c
    c = 1 + math.sin(a) * (2 * n - math.sin(a))
    r0 = math.sqrt(c) / n
    r = m.sqrt(m.clip(c - 2 * n * m.sin(p), 0.0, 1e9)) / n
    return r * m.sin(l * n), r0 - r * m.cos(l * n)


@_closed("conicConformal")
def _conic_conformal(m, l, p, o):
    a, b = _parallels(o)
    t = lambda x: math.tan((HALF + x) / 2)
    n = math.sin(a) if a == b else math.log(math.cos(a) / math.cos(b)) / math.log(t(b) / t(a))
    if abs(n) < EPS:
        return _mercator(m, l, p, o)
    f = math.cos(a) * t(a) ** n / n
    q = m.clip(p, -HALF + 1e-6, HALF - 1e-6)
    r = f / m.exp(n * m.log(m.tan((HALF + q) / 2)))
    return r * m.sin(n * l), f - r * m.cos(n * l)


@_closed("conicEquidistant")
def _conic_equidistant(m, l, p, o):
    a, b = _parallels(o)
    n = math.sin(a) if a == b else (math.cos(a) - math.cos(b)) / (b - a)
    if abs(n) < EPS:
        return l, p
    g = math.cos(a) / n + a
    return (g - p) * m.sin(n * l), g - (g - p) * m.cos(n * l)


# --- Van der Grinten's four -----------------------------------------------------------------------------


@_closed("vanDerGrinten")
def _van_der_grinten(m, l, p, o):
    s = m.clip(m.abs(p / HALF), 0.0, 1.0)
    t = m.asin(s)
    edge = (m.abs(l) < EPS) | (m.abs(m.abs(p) - HALF) < EPS)
    equator = m.abs(p) < EPS
    safe_l = m.where(m.abs(l) < EPS, l * 0 + 1.0, l)
    st, ct = m.sin(t), m.cos(t)
    a = m.abs(PI / safe_l - safe_l / PI) / 2
    a2 = a * a
    den = m.where(m.abs(st + ct - 1) < EPS, s * 0 + 1.0, st + ct - 1)
    g = ct / den
    q = g * (2 / m.where(st < EPS, s * 0 + 1.0, st) - 1)
    q2, g2 = q * q, g * g
    pg = g - q2
    r = q2 + a2
    v = a2 + g
    x = PI * (a * pg + m.sqrt(m.clip(a2 * pg * pg - r * (g2 - q2), 0.0, 1e18))) / r
    y = PI * (q * v - a * m.sqrt(m.clip((a2 + 1) * r - v * v, 0.0, 1e18))) / r
    return m.where(equator, l, m.where(edge, l * 0, m.sign(l) * x)), m.where(equator, p * 0, m.where(edge, m.sign(p) * PI * m.tan(t / 2), m.sign(p) * y))


@_closed("vanDerGrinten2")
def _van_der_grinten2(m, l, p, o):
    s = m.clip(m.abs(p / HALF), 0.0, 1.0)
    t = m.asin(s)
    c = m.cos(t)
    flat = m.abs(l) < EPS
    q = m.where(flat, l * 0 + 1.0, l)
    a = m.abs(PI / q - q / PI) / 2
    x = m.sign(l) * PI * c * (m.sqrt(1 + a * a) - a * c) / (1 + a * a * s * s)
    y = m.sign(p) * m.sqrt(m.clip(PI * PI - x * x - 2 * PI * a * m.abs(x), 0.0, 100.0))
    return m.where(flat, l * 0, x), m.where(flat, m.sign(p) * PI * m.tan(t / 2), y)


@_closed("vanDerGrinten3")
def _van_der_grinten3(m, l, p, o):
    s = p / HALF
    t = m.asin(m.clip(s, -1.0, 1.0))
    flat = m.abs(l) < EPS
    q = m.where(flat, l * 0 + 1.0, l)
    a = (PI / q - q / PI) / 2
    y = m.tan(t / 2)
    return m.where(flat, l * 0, PI * (m.sign(l) * m.sqrt(m.clip(a * a + 1 - y * y, 0.0, 1e18)) - a)), PI * y


@_closed("vanDerGrinten4")
def _van_der_grinten4(m, l, p, o):
    edge = (m.abs(l) < EPS) | (m.abs(m.abs(p) - HALF) < EPS)
    equator = m.abs(p) < EPS
    k = m.where(equator, p * 0 + 0.5, m.abs(p / HALF))
    k2 = k * k
    den = m.where(m.abs(2 * k2 * (k - 1)) < 1e-12, k * 0 - 1.0, 2 * k2 * (k - 1))
    a = (8 * k - k2 * (k2 + 2) - 5) / den
    a2 = a * a
    ka = k * a
    b = k2 + a2 + 2 * ka
    c = k + 3 * a
    d = m.where(m.abs(l) < EPS, l * 0 + 1.0, l) / HALF
    e = d + 1 / d
    g = m.sign(m.abs(l) - HALF) * m.sqrt(m.clip(e * e - 4, 0.0, 1e18))
    g2 = g * g
    h = b * (k2 + a2 * g2 - 1) + (1 - k2) * (k2 * (c * c + 4 * a2) + 12 * ka * a2 + 4 * a2 * a2)
    x = (g * (b + a2 - 1) + 2 * m.sqrt(m.clip(h, 0.0, 1e18))) / (4 * b + g2)
    y = m.sqrt(m.clip(1 + g * m.abs(x) - x * x, 0.0, 1e18))
    return m.where(equator, l, m.where(edge, l * 0, m.sign(l) * HALF * x)), m.where(equator, p * 0, m.where(edge, p, m.sign(p) * HALF * y))


# --- iterative: numpy only ------------------------------------------------------------------------------


def _newton(f, d, x, steps: int = 25):
    for _ in range(steps):
        slope = d(x)
        x = x - f(x) / np.where(np.abs(slope) < 1e-12, 1e-12, slope)
    return x


def _mollweide_like(cx: float, cy: float, cp: float):
    def raw(m, l, p, o):
        want = cp * np.sin(p)
        t = _newton(lambda x: x + np.sin(x) - want, lambda x: 1 + np.cos(x), np.asarray(p) * 1.0)
        t = np.where(np.abs(np.abs(p) - HALF) < 1e-6, np.sign(p) * PI if cp == PI else t, t)
        return cx * l * np.cos(t / 2), cy * np.sin(t / 2)

    return raw


def _mollweide_constants(radius: float) -> tuple[float, float, float]:
    """For a bounding parallel: the pseudocylindrical equal-area constants of Wagner IV and its kin."""
    s = math.sin(radius)
    c = 2 * radius + math.sin(2 * radius)
    k = math.sqrt(2 * PI * s / c)
    return 2 * k / PI, k / s, c


ITERATIVE["mollweide"] = _mollweide_like(math.sqrt(2) / HALF, math.sqrt(2), PI)
ITERATIVE["wagner4"] = _mollweide_like(*_mollweide_constants(PI / 3))
ITERATIVE["bromley"] = _mollweide_like(1.0, 4 / PI, PI)


@_iterative("eckert4")
def _eckert4(m, l, p, o):
    want = (2 + HALF) * np.sin(p)
    t = _newton(lambda x: x + np.sin(x) * (np.cos(x) + 2) - want, lambda x: 1 + np.cos(x) * (np.cos(x) + 2) - np.sin(x) ** 2, np.asarray(p) / 2)
    return 2 / math.sqrt(PI * (4 + PI)) * l * (1 + np.cos(t)), 2 * math.sqrt(PI / (4 + PI)) * np.sin(t)


@_iterative("eckert6")
def _eckert6(m, l, p, o):
    want = (1 + HALF) * np.sin(p)
    t = _newton(lambda x: x + np.sin(x) - want, lambda x: 1 + np.cos(x), np.asarray(p) * 1.0)
    k = math.sqrt(2 + PI)
    return l * (1 + np.cos(t)) / k, 2 * t / k


@_iterative("boggs")
def _boggs(m, l, p, o):
    want = PI * np.sin(p)
    t = _newton(lambda x: x + np.sin(x) - want, lambda x: 1 + np.cos(x), np.asarray(p) * 1.0) / 2
    t = np.where(np.abs(np.abs(p) - HALF) < 1e-6, np.sign(p) * HALF, t)
    c = np.maximum(np.cos(p), 1e-12)
    return 2.00276 * l / (1 / c + 1.11072 / np.maximum(np.cos(t), 1e-12)), (p + math.sqrt(2) * np.sin(t)) / 2.00276


@_iterative("hatano")
def _hatano(m, l, p, o):
    p = np.asarray(p) * 1.0
    want = np.sin(p) * np.where(p < 0, 2.43763, 2.67595)
    t = _newton(lambda x: x + np.sin(x) - want, lambda x: 1 + np.cos(x), p, 40) / 2
    return 0.85 * l * np.cos(t), np.sin(t) * np.where(p < 0, 1.93052, 1.75859)


@_iterative("nellHammer")
def _nell_hammer(m, l, p, o):
    return l * (1 + np.cos(p)) / 2, 2 * (p - np.tan(p / 2))


@_iterative("homolosine")
def _homolosine(m, l, p, o):
    cut = 41.737 * PI / 180
    x, y = ITERATIVE["mollweide"](m, l, p, o)
    return np.where(np.abs(p) < cut, l * np.cos(p), x), np.where(np.abs(p) < cut, p, y - np.sign(p) * 0.0528035274542)


@_iterative("sinuMollweide")
def _sinu_mollweide(m, l, p, o):
    x, y = ITERATIVE["mollweide"](m, l, p, o)
    return np.where(p > -0.7109889596207567, x, l * np.cos(p)), np.where(p > -0.7109889596207567, y + 0.0528035274542, p)


@_iterative("mtFlatPolarParabolic")
def _mt_parabolic(m, l, p, o):
    r7 = math.sqrt(7)
    t = np.arcsin(np.clip(7 * np.sin(p) / (3 * math.sqrt(6)), -1, 1))
    return math.sqrt(6) / r7 * l * (2 * np.cos(2 * t / 3) - 1), 9 * np.sin(t / 3) / r7


@_iterative("mtFlatPolarQuartic")
def _mt_quartic(m, l, p, o):
    k = (1 + math.sqrt(0.5)) * np.sin(p)
    t = _newton(lambda x: np.sin(x / 2) + np.sin(x) - k, lambda x: 0.5 * np.cos(x / 2) + np.cos(x), np.asarray(p) * 1.0)
    return l * (1 + 2 * np.cos(t) / np.cos(t / 2)) / (3 * math.sqrt(2)), 2 * math.sqrt(3) * np.sin(t / 2) / math.sqrt(2 + math.sqrt(2))


@_iterative("mtFlatPolarSinusoidal")
def _mt_sinusoidal(m, l, p, o):
    a = math.sqrt(6 / (4 + PI))
    k = (1 + PI / 4) * np.sin(p)
    t = _newton(lambda x: x / 2 + np.sin(x) - k, lambda x: 0.5 + np.cos(x), np.asarray(p) / 2)
    return a * (0.5 + np.cos(t)) * l / 1.5, a * t


@_iterative("airy")
def _airy(m, l, p, o):
    r = o.get("radius", 90.0) * PI / 180
    t = math.tan(r / 2)
    b = 2 * math.log(math.cos(r / 2)) / (t * t)
    c = np.cos(p) * np.cos(l)
    z = 1 - c
    near = np.abs(z) < 1e-9
    k = np.where(near, 0.5, -(np.log(np.maximum((1 + c) / 2, 1e-300)) / np.where(near, 1, z) + b / np.maximum(1 + c, 1e-12)))
    return k * np.cos(p) * np.sin(l), k * np.sin(p)


#: Robinson's table, length and distance of parallels every five degrees.
_ROBINSON = [(1, 0), (0.9986, 0.062), (0.9954, 0.124), (0.99, 0.186), (0.9822, 0.248), (0.973, 0.31), (0.96, 0.372), (0.9427, 0.434), (0.9216, 0.4958), (0.8962, 0.5571), (0.8679, 0.6176), (0.835, 0.6769), (0.7986, 0.7346), (0.7597, 0.7903), (0.7186, 0.8435), (0.6732, 0.8936), (0.6213, 0.9394), (0.5722, 0.9761), (0.5322, 1)]


@_iterative("robinson")
def _robinson(m, l, p, o):
    table = np.array([(0.9986, -0.062), *_ROBINSON, (0.5322, 1.0)])
    i = np.minimum(18, np.abs(p) * 36 / PI)
    k = np.floor(i).astype(int)
    d = i - k
    k = np.minimum(k, 18)
    a, b, c = table[k], table[k + 1], table[np.minimum(k + 2, 20)]
    two = lambda j: b[..., j] + d * (c[..., j] - a[..., j]) / 2 + d * d * (c[..., j] - 2 * b[..., j] + a[..., j]) / 2
    return l * two(0), np.sign(p) * HALF * two(1)


@_iterative("bottomley")
def _bottomley(m, l, p, o):
    s = math.sin(o.get("fraction", 0.5))
    r = HALF - p
    e = np.where(np.abs(r) < EPS, 0.0, l * s * np.sin(r) / np.where(np.abs(r) < EPS, 1.0, r))
    return r * np.sin(e) / s, HALF - r * np.cos(e)


@_iterative("armadillo")
def _armadillo(m, l, p, o):
    p0 = o.get("parallel", 20.0) * PI / 180
    s, c, t = math.sin(p0), math.cos(p0), math.tan(p0)
    k = (1 + s - c) / 2
    low = -np.arctan(np.cos(l / 2) / t)
    q = np.maximum(p, low)
    return (1 + np.cos(q)) * np.sin(l / 2), k + np.sin(q) * c - (1 + np.cos(q)) * s * np.cos(l / 2)


@_iterative("twoPointEquidistant")
def _two_point_equidistant(m, l, p, o):
    a, b = (np.radians(x) for x in o.get("points", [(-158.0, 21.5), (-77.0, 39.0)]))
    dist = lambda u: np.arccos(np.clip(np.sin(u[1]) * np.sin(p) + np.cos(u[1]) * np.cos(p) * np.cos(l - u[0]), -1, 1))
    base = math.acos(math.sin(a[1]) * math.sin(b[1]) + math.cos(a[1]) * math.cos(b[1]) * math.cos(a[0] - b[0]))
    za, zb = dist(a), dist(b)
    x = (za * za - zb * zb) / (2 * base)
    y2 = za * za - (x + base / 2) ** 2
    side = math.sin(b[0] - a[0]) if b[0] != a[0] else 1.0
    up = np.sin(p) * side * math.cos(a[1]) * math.cos(b[1]) - np.cos(p) * (math.sin(a[1]) * math.cos(b[1]) * np.sin(b[0] - l) + math.cos(a[1]) * math.sin(b[1]) * np.sin(l - a[0]))
    return x, np.sign(up) * np.sqrt(np.maximum(y2, 0))


@_iterative("twoPointAzimuthal")
def _two_point_azimuthal(m, l, p, o):
    d = o.get("angle", 30.0) * PI / 180
    x, y = CLOSED["gnomonic"](_Numpy, l, p, o)
    return x * math.cos(d), y


@_iterative("albersUsa")
def _albers_usa(m, l, p, o):
    """The lower 48 states, Alaska and Hawaii, each by its own conic, placed as insets; elsewhere nothing."""
    deg = 180 / PI

    def part(centre, parallels, scale, shift):
        x, y = _conic_equal_area(_Numpy, l - centre[0] / deg, p, {"parallels": parallels})
        x0, y0 = _conic_equal_area(_Numpy, np.zeros(1), np.full(1, centre[1] / deg), {"parallels": parallels})
        return (x - x0) * scale + shift[0], (y - y0) * scale + shift[1]

    lon, lat = l * deg, p * deg
    alaska = (lat > 50) & (lon < -128)
    hawaii = (lat < 29) & (lon < -140)
    lower = (lat > 23) & (lat < 50.5) & (lon > -126) & (lon < -65)
    xs = [part((-96, 38.7), (29.5, 45.5), 1.0, (0, 0)), part((-154, 58.5), (55, 65), 0.35, (-0.307, -0.201)), part((-157, 19.9), (8, 18), 1.0, (-0.205, -0.212))]
    pick = lambda j: np.select([alaska, hawaii, lower], [xs[1][j], xs[2][j], xs[0][j]], np.nan)
    return pick(0), pick(1)


@_iterative("eisenlohr")
def _eisenlohr(m, l, p, o):
    """As published in Snyder and Voxland's album of map projections."""
    south_north, root = np.cos(p / 2), np.sqrt(np.maximum(np.cos(p), 0) / 2)
    east, west = south_north + root * (np.cos(l / 2) + np.sin(l / 2)), south_north + root * (np.cos(l / 2) - np.sin(l / 2))
    tangent = np.sin(p / 2) / (south_north + 2 * root * np.cos(l / 2))
    secant = math.sqrt(2) / np.hypot(1, tangent)
    ratio = np.sqrt(east / west)
    x = secant * (ratio - 1 / ratio) - np.log(east / west)
    y = secant * tangent * (ratio + 1 / ratio) - 2 * np.arctan(tangent)
    return (3 + math.sqrt(8)) * x, (3 + math.sqrt(8)) * y


NAMES = sorted({*CLOSED, *ITERATIVE})


def _rotation(m, l, p, rotate):
    """Rotates the sphere by degrees about three axes."""
    a, b, g = ([*rotate, 0, 0, 0][:3] if rotate else (0, 0, 0))
    a, b, g = (x * PI / 180 for x in (a, b, g))
    l = l + a
    l = m.where(l > PI, l - 2 * PI, m.where(l < -PI, l + 2 * PI, l))
    if not (b or g):
        return l, p
    cp = m.cos(p)
    x, y, z = m.cos(l) * cp, m.sin(l) * cp, m.sin(p)
    k = z * math.cos(b) + x * math.sin(b)
    return m.atan2(y * math.cos(g) - k * math.sin(g), x * math.cos(b) - z * math.sin(b)), m.asin(m.clip(k * math.cos(g) + y * math.sin(g), -1.0, 1.0))


def project(m, raw: Raw, lon, lat, options: dict):
    """Degrees to pixels: rotate, project, scale, translate; y grows downwards."""
    l, p = _rotation(m, lon * (PI / 180), lat * (PI / 180), options.get("rotate"))
    k = options.get("scale", 150.0)
    tx, ty = options.get("translate", [480.0, 250.0])
    cx = cy = 0.0
    if options.get("center"):
        a, b = (np.array([math.radians(c)]) for c in options["center"])
        ox, oy = raw(_Numpy, a, b, options)
        cx, cy = float(ox[0]), float(oy[0])
    x, y = raw(m, l, p, options)
    return (x - cx) * k + tx, ty - (y - cy) * k


def geo(df: DataFrame, lat: str = "lat", lon: str = "lon", projection: str = "mercator", output: dict[str, str] | None = None, **options) -> DataFrame:
    """Adds layout_x and layout_y of points in degrees; infinite or NaN for a point that the map doesn't show."""
    names = {k: (output or {}).get(k, f"layout_{k}") for k in ("x", "y")}
    lo, la = F.col(lon).cast("double"), F.col(lat).cast("double")
    if projection in CLOSED:
        x, y = project(_Columns, CLOSED[projection], lo, la, options)
        return df.withColumns({names["x"]: x, names["y"]: y})
    raw = ITERATIVE[projection]

    @F.pandas_udf("x double, y double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            x, y = project(_Numpy, raw, a.to_numpy(float), b.to_numpy(float), options)
        return pd.DataFrame({"x": x, "y": y})

    out = df.withColumn("__xy", run(lo, la))
    return out.withColumns({names["x"]: F.col("__xy.x"), names["y"]: F.col("__xy.y")}).drop("__xy")


def _resampled(points: list, step: float = 2.0) -> list:
    """More points on long edges, along the great circle, so that curves stay curves."""
    out = points[:1]
    for (a, b), (c, d) in zip(points, points[1:], strict=False):
        gap = max(abs(c - a), abs(d - b))
        n = min(64, int(gap // step))
        if n and abs(c - a) < 180:
            u, v = (np.array([math.cos(math.radians(q)) * math.cos(math.radians(w)), math.cos(math.radians(q)) * math.sin(math.radians(w)), math.sin(math.radians(q))]) for w, q in ((a, b), (c, d)))
            angle = math.acos(max(-1.0, min(1.0, float(u @ v))))
            for i in range(1, n + 1):
                t = i / (n + 1)
                p = (math.sin((1 - t) * angle) * u + math.sin(t * angle) * v) / math.sin(angle) if angle > 1e-9 else u
                out.append([math.degrees(math.atan2(p[1], p[0])), math.degrees(math.asin(max(-1.0, min(1.0, float(p[2])))))])
        out.append([c, d])
    return out


def path(geometry: dict, projection: str, options: dict, radius: float = 4.5) -> str:
    """The SVG path of a GeoJSON object; lines are cut where they cross the antimeridian."""
    raw = CLOSED.get(projection) or ITERATIVE[projection]
    parts: list[str] = []
    number = lambda x: f"{x:.3f}".rstrip("0").rstrip(".")

    def line(points: list, close: bool) -> None:
        runs: list[list] = [[]]
        shift = (options.get("rotate") or [0])[0]
        for q in _resampled([p[:2] for p in points]):
            if runs[-1] and abs((q[0] + shift + 180) % 360 - (runs[-1][-1][0] + shift + 180) % 360) > 180:
                runs.append([])
            runs[-1].append(q)
        for r in runs:
            if not r:
                continue
            a = np.array(r, float)
            with np.errstate(all="ignore"):
                x, y = project(_Numpy, raw, a[:, 0], a[:, 1], options)
            good = [(u, v) for u, v in zip(x, y, strict=True) if math.isfinite(u) and math.isfinite(v)]
            if good:
                parts.append("M" + "L".join(f"{number(u)},{number(v)}" for u, v in good) + ("Z" if close else ""))

    def walk(g: dict | None) -> None:
        if not g:
            return
        kind, c = g.get("type"), g.get("coordinates")
        if kind == "FeatureCollection":
            for f in g["features"]:
                walk(f)
        elif kind == "Feature":
            walk(g.get("geometry"))
        elif kind == "GeometryCollection":
            for x in g["geometries"]:
                walk(x)
        elif kind in ("Point", "MultiPoint"):
            for q in [c] if kind == "Point" else c:
                with np.errstate(all="ignore"):
                    x, y = project(_Numpy, raw, np.array([q[0]], float), np.array([q[1]], float), options)
                if math.isfinite(x[0]) and math.isfinite(y[0]):
                    parts.append(f"M{number(x[0])},{number(y[0])}m0,{number(radius)}a{number(radius)},{number(radius)} 0 1,1 0,{number(-2 * radius)}a{number(radius)},{number(radius)} 0 1,1 0,{number(2 * radius)}z")
        elif kind == "LineString":
            line(c, False)
        elif kind == "MultiLineString":
            for x in c:
                line(x, False)
        elif kind in ("Polygon", "MultiPolygon"):
            for ring in c if kind == "Polygon" else [r for p in c for r in p]:
                line(ring[:-1], True)
        elif kind == "Sphere":
            line([[-180, y] for y in range(-90, 91, 2)], False)
            line([[180, y] for y in range(90, -91, -2)], False)

    walk(geometry)
    return "".join(parts)


def geopath(df: DataFrame, field: str | None = None, projection: str = "mercator", output: dict[str, str] | None = None, **options) -> DataFrame:
    """Adds layout_path: the SVG path of a GeoJSON text or struct column, in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: path(json.loads(t), projection, options), na_action="ignore")

    c: Column = F.col(field) if field else F.struct(*[F.col(x) for x in df.columns])
    kind = df.select(c.alias("c")).schema[0].dataType.typeName()
    return df.withColumn((output or {}).get("path", "layout_path"), run(c if kind == "string" else F.to_json(c)))
