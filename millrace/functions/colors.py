"""Colours given as RGB, HSL, CIE LAB or HCL numbers, as Columns of '#rrggbb' texts.

RGB parts run from 0 to 255, hues are degrees, saturation and HSL lightness run from 0 to 1, LAB and HCL
lightness from 0 to 100. A missing part is the middle grey's. What a screen can't show is clipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white point of daylight (D65), and XYZ to linear RGB.
WHITE = (0.95047, 1.0, 1.08883)
LINEAR = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def _or(x: Column | float | None, default: float) -> Column:
    return F.lit(default) if x is None else F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("double"), F.lit(default))


def _hex(*parts: Column) -> Column:
    """Of three parts from 0 to 1."""
    two = lambda c: F.lpad(F.lower(F.hex(F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), *map(two, parts))


def rgb(r: Column | float | None, g: Column | float | None, b: Column | float | None) -> Column:
    return _hex(*[_or(x, 128.0) / 255 for x in (r, g, b)])


def hsl(h: Column | float | None, s: Column | float | None, l: Column | float | None) -> Column:  # noqa: E741
    hue, light = F.pmod(_or(h, 0.0), F.lit(360.0)) / 30, _or(l, 0.5)
    reach = _or(s, 0.0) * F.least(light, 1 - light)

    def part(n: int) -> Column:
        k = F.pmod(hue + n, F.lit(12.0))
        return light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return _hex(part(0), part(8), part(4))


def lab(l: Column | float | None, a: Column | float | None, b: Column | float | None) -> Column:  # noqa: E741
    fy = (_or(l, 50.0) + 16) / 116
    fs = (fy + _or(a, 0.0) / 500, fy, fy - _or(b, 0.0) / 200)
    xyz = [F.when(f > 6 / 29, f * f * f).otherwise(3 * (6 / 29) ** 2 * (f - 4 / 29)) * w for f, w in zip(fs, WHITE, strict=True)]
    linear = [sum((x * k for x, k in zip(xyz[1:], row[1:], strict=True)), xyz[0] * row[0]) for row in LINEAR]
    return _hex(*[F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) * 1.055 - 0.055) for c in linear])


def hcl(h: Column | float | None, c: Column | float | None, l: Column | float | None) -> Column:  # noqa: E741
    angle, chroma = F.radians(_or(h, 0.0)), _or(c, 0.0)
    return lab(l, chroma * F.cos(angle), chroma * F.sin(angle))


def of(value: dict[str, Column | float | None]) -> Column:
    """The colour of a mark's property: {r, g, b}, {h, s, l}, {l, a, b} or {h, c, l}."""
    kinds = {frozenset("rgb"): (rgb, "rgb"), frozenset("hsl"): (hsl, "hsl"), frozenset("lab"): (lab, "lab"), frozenset("hcl"): (hcl, "hcl")}
    if frozenset(value) not in kinds:
        raise ValueError(f"no colour has the parts {sorted(value)}")
    make, parts = kinds[frozenset(value)]
    return make(*[value[p] for p in parts])
