"""Projections of the suppliers' points against their published closed forms, and paths of shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.layout import geo as g
from millrace.queries import query, table
from millrace.queries.layouts import _LAT, _LON, _points

_C = "cos(l) * cos(p)"
#: x and y on the unit sphere, of longitude l and latitude p in radians.
FORMS = {
    "equirectangular": ("l", "p"),
    "mercator": ("l", "ln(tan(pi() / 4 + p / 2))"),
    "miller": ("l", "1.25 * ln(tan(pi() / 4 + 0.4 * p))"),
    "cylindricalEqualArea": ("l * cos(radians(38.58))", "sin(p) / cos(radians(38.58))"),
    "cylindricalStereographic": ("l", "2 * tan(p / 2)"),
    "sinusoidal": ("l * cos(p)", "p"),
    "patterson": ("l", "p * (1.0148 + pow(p, 4) * (0.23185 + p * p * (-0.14499 + 0.02406 * p * p)))"),
    "naturalEarth": ("l * (0.8707 - 0.131979 * p * p + pow(p, 4) * (-0.013791 + pow(p, 4) * (0.003971 * p * p - 0.001529 * pow(p, 4))))", "p * (1.007226 + p * p * (0.015085 + pow(p, 4) * (-0.044475 + 0.028874 * p * p - 0.005916 * pow(p, 4))))"),
    "collignon": ("2 / sqrt(pi()) * l * sqrt(1 - sin(p))", "sqrt(pi()) * (1 - sqrt(1 - sin(p)))"),
    "craster": ("sqrt(3 / pi()) * l * (2 * cos(2 * p / 3) - 1)", "sqrt(3 * pi()) * sin(p / 3)"),
    "eckert1": ("sqrt(8 / (3 * pi())) * l * (1 - abs(p) / pi())", "sqrt(8 / (3 * pi())) * p"),
    "eckert2": ("2 * l * sqrt((4 - 3 * sin(abs(p))) / (6 * pi()))", "sign(p) * sqrt(2 * pi() / 3) * (2 - sqrt(4 - 3 * sin(abs(p))))"),
    "eckert3": ("2 * l * (1 + sqrt(1 - 4 * p * p / (pi() * pi()))) / sqrt(pi() * (4 + pi()))", "4 * p / sqrt(pi() * (4 + pi()))"),
    "eckert5": ("l * (1 + cos(p)) / sqrt(2 + pi())", "2 * p / sqrt(2 + pi())"),
    "fahey": ("l * cos(radians(35)) * sqrt(1 - pow(tan(p / 2), 2))", "(1 + cos(radians(35))) * tan(p / 2)"),
    "foucaut": ("2 * l / sqrt(pi()) * cos(p) * pow(cos(p / 2), 2)", "sqrt(pi()) * tan(p / 2)"),
    "kavrayskiy7": ("3 * l / (2 * pi()) * sqrt(pi() * pi() / 3 - p * p)", "p"),
    "wagner6": ("l * sqrt(1 - 3 * p * p / (pi() * pi()))", "p"),
    "loximuthal": ("CASE WHEN abs(p - radians(40)) < 1e-9 THEN l * cos(radians(40)) ELSE l * (p - radians(40)) / (ln(tan(pi() / 4 + p / 2)) - ln(tan(pi() / 4 + radians(20)))) END", "p - radians(40)"),
    "larrivee": ("l * (1 + sqrt(cos(p))) / 2", "p / (cos(p / 2) * cos(l / 6))"),
    "laskowski": ("l * (0.975534 + p * p * (-0.119161 - 0.0143059 * l * l - 0.0547009 * p * p))", "p * (1.00384 + l * l * (0.0802894 - 0.02855 * p * p + 0.000199025 * l * l) + p * p * (0.0998909 - 0.0491032 * p * p))"),
    "azimuthalEqualArea": (f"sqrt(2 / (1 + {_C})) * cos(p) * sin(l)", f"sqrt(2 / (1 + {_C})) * sin(p)"),
    "azimuthalEquidistant": (f"acos({_C}) / sin(acos({_C})) * cos(p) * sin(l)", f"acos({_C}) / sin(acos({_C})) * sin(p)"),
    "orthographic": ("cos(p) * sin(l)", "sin(p)"),
    "stereographic": (f"cos(p) * sin(l) / (1 + {_C})", f"sin(p) / (1 + {_C})"),
    "satellite": (f"cos(p) * sin(l) / (2 - {_C})", f"sin(p) / (2 - {_C})"),
    "aitoff": ("2 * cos(p) * sin(l / 2) * a / sin(a)", "sin(p) * a / sin(a)"),
    "winkel3": ("cos(p) * sin(l / 2) * a / sin(a) + l / pi()", "(sin(p) * a / sin(a) + p) / 2"),
    "hammer": ("2 * sqrt(2 / (1 + cos(p) * cos(l / 2))) * cos(p) * sin(l / 2)", "sqrt(2 / (1 + cos(p) * cos(l / 2))) * sin(p)"),
    "littrow": ("sin(l) / cos(p)", "tan(p) * cos(l)"),
    "polyconic": ("CASE WHEN abs(p) < 1e-9 THEN l ELSE sin(l * sin(p)) / tan(p) END", "CASE WHEN abs(p) < 1e-9 THEN 0 ELSE p + (1 - cos(l * sin(p))) / tan(p) END"),
}
_SQL = f"WITH q AS (SELECT s_suppkey, radians({_LON}) AS l, radians({_LAT}) AS p FROM supplier WHERE NOT ({_LON} = 0 AND {_LAT} = 0)), s AS (SELECT *, acos(cos(p) * cos(l / 2)) AS a FROM q)\n" + "\nUNION ALL ".join(
    f"SELECT s_suppkey, '{name}' AS projection, round({x}, 7) + 0.0 AS x, round({y}, 7) + 0.0 AS y FROM s" for name, (x, y) in FORMS.items()
)


@query(_SQL)
def geo_closed_forms(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers' points, but for the very centre, where some forms are limits, by each of the projections."""
    points = _points(spark, sf).filter("NOT (lon = 0 AND lat = 0)").withColumn("projection", F.explode(F.array(*map(F.lit, FORMS))))
    out = None
    for name in FORMS:
        own = g.geo(points.filter(F.col("projection") == name), projection=name, scale=1.0, translate=[0.0, 0.0])
        own = own.select("s_suppkey", "projection", (F.round("layout_x", 7) + 0.0).alias("x"), (F.round(-F.col("layout_y"), 7) + 0.0).alias("y"))
        out = own if out is None else out.union(own)
    return out


#: Of projections without a closed form, what their definition says of a point: an equation in its latitude p, its x and y.
EQUATIONS = {
    "mollweide": ("2 * asin(y / sqrt(2)) + sin(2 * asin(y / sqrt(2)))", "pi() * sin(p)"),
    "eckert4": ("t + sin(t) * cos(t) + 2 * sin(t)", "(2 + pi() / 2) * sin(p)", "asin(y / (2 * sqrt(pi() / (4 + pi()))))"),
    "eckert6": ("t + sin(t)", "(1 + pi() / 2) * sin(p)", "y * sqrt(2 + pi()) / 2"),
    "wagner4": ("2 * t + sin(2 * t)", "(4 * pi() + 3 * sqrt(3)) / 6 * sin(p)", "asin(y / 1.56548)"),
    "mtFlatPolarSinusoidal": ("t / 2 + sin(t)", "(1 + pi() / 4) * sin(p)", "y / sqrt(6 / (4 + pi()))"),
}


@query("SELECT s_suppkey, unnest([" + ", ".join(f"'{n}'" for n in EQUATIONS) + "]) AS projection, true AS holds FROM supplier")
def geo_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Iterated projections satisfy the equations that define them, within a ten-thousandth."""
    out = None
    for name, (left, right, *more) in EQUATIONS.items():
        own = g.geo(_points(spark, sf), projection=name, scale=1.0, translate=[0.0, 0.0])
        own = own.select("s_suppkey", F.radians("lat").alias("p"), F.col("layout_x").alias("x"), (-F.col("layout_y")).alias("y"))
        own = own.withColumn("t", F.expr(more[0])) if more else own
        own = own.select("s_suppkey", F.lit(name).alias("projection"), (F.abs(F.expr(left) - F.expr(right)) < 1e-4).alias("holds"))
        out = own if out is None else out.union(own)
    return out


@query("""
SELECT s_suppkey, 'M' || (k + 10) || ',' || (100 - 2) || 'L' || (k + 11) || ',' || (100 - 2) || 'L' || (k + 11) || ',' || (100 - 3) || 'Z' AS shape, 'M' || (k + 10) || ',90L' || (k + 11) || ',89' AS line
FROM (SELECT s_suppkey, s_suppkey % 100 AS k FROM supplier)
""")
def geo_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A triangle and a line a supplier, a degree wide, on a plane with a pixel a degree."""
    k = (F.col("s_suppkey") % 100).cast("string")
    at = lambda x, y: F.concat(F.lit("["), F.expr(f"cast(s_suppkey % 100 + {x} as string)"), F.lit(f", {y}]"))
    ring = F.concat(F.lit('{"type": "Polygon", "coordinates": [['), F.concat_ws(", ", at(0, 2), at(1, 2), at(1, 3), at(0, 2)), F.lit("]]}"))
    line = F.concat(F.lit('{"type": "LineString", "coordinates": ['), F.concat_ws(", ", at(0, 10), at(1, 11)), F.lit("]}"))
    rows = table(spark, sf, "supplier").select("s_suppkey", k.alias("k"), ring.alias("ring"), line.alias("way"))
    plane = {"scale": 180 / 3.141592653589793, "translate": [10.0, 100.0]}
    rows = g.geopath(rows, "ring", "equirectangular", {"path": "shape"}, **plane)
    return g.geopath(rows, "way", "equirectangular", {"path": "line"}, **plane).select("s_suppkey", "shape", "line")
