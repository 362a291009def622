"""Sources: files in each format, inline values, declared field types, and topologies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch
from millrace.operators.aggregates import ORDER
from millrace.queries import query, table
from millrace.sources import dump, formats, topology


def _file(df: DataFrame, kind: str, **options) -> str:
    path = f"{scratch.folder(df.sparkSession)}/millrace/file-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


_PARTS = "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size::DOUBLE AS p_size, p_retailprice FROM part"


def _read(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    if kind == "json":
        path = _file(parts.select(F.to_json(F.struct(F.lit("parts").alias("kind"), F.array(F.struct("*")).alias("rows")))), "text")
    else:
        path = _file(parts, "csv", header=True, sep="," if kind == "csv" else "\t")
    return formats.read(spark, path, kind, {"p_partkey": "number", "p_size": "integer", "p_retailprice": "number", "p_name": "string"}, "rows" if kind == "json" else None)


@query(_PARTS)
def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "csv")


@query(_PARTS)
def source_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "tsv")


@query("SELECT n_name AS name, n_nationkey::DOUBLE AS key, n_regionkey::DOUBLE AS region, n_nationkey % 2 = 0 AS even, n_nationkey::BIGINT AS at FROM nation")
def source_inline(spark: SparkSession, sf: str) -> DataFrame:
    """The nations as the literal values of a specification, whose rows keep their order."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    return formats.inline(spark, [{"name": r.n_name, "key": r.n_nationkey, "region": r.n_regionkey, "even": r.n_nationkey % 2 == 0} for r in rows]).withColumnRenamed(ORDER, "at")


@query("""
SELECT o_orderkey, epoch_ms(o_orderdate)::DOUBLE AS date, epoch_ms(o_orderdate)::DOUBLE AS formatted, 'nan'::DOUBLE AS unreadable, o_totalprice AS price, CASE WHEN o_custkey % 2 = 0 THEN true WHEN o_custkey % 3 = 0 THEN false END AS flag, o_custkey::VARCHAR AS label FROM orders
""")
def field_types(spark: SparkSession, sf: str) -> DataFrame:
    """Texts read by declared types; what can't be read is null, or not a number for a date."""
    k = F.col("o_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("formatted"), F.col("o_orderpriority").alias("unreadable"), F.col("o_totalprice").cast("string").alias("price"), F.when(k % 2 == 0, "true").when(k % 3 == 0, "false").otherwise("maybe").alias("flag"), k.alias("label"))
    return formats.typed_fields(o, {"date": "date", "formatted": "date:'dd/MM/yyyy'", "unreadable": "date", "price": "number", "flag": "boolean", "label": "string"})


def _topology(spark: SparkSession, sf: str) -> dict:
    """A square a nation, of which neighbours in a row share a side: arcs of quantised steps, a row a region."""
    nations = [(r.n_nationkey, r.n_regionkey) for r in table(spark, sf, "nation").orderBy("n_regionkey", "n_nationkey").collect()]
    arcs, shapes, before = [], [], {}
    for key, region in nations:
        column = sum(1 for k, q in nations if q == region and k < key)
        if region not in before:
            before[region] = len(arcs)
            arcs.append([[0, 4 * region], [0, 2]])  # the left side of the row, upwards
        left, right = before[region], len(arcs)
        arcs.append([[2 * column + 2, 4 * region], [0, 2]])
        arcs.append([[2 * column, 4 * region], [2, 0]])
        arcs.append([[2 * column + 2, 4 * region + 2], [-2, 0]])
        shapes.append({"type": "Polygon", "id": key, "arcs": [[right + 1, right, right + 2, ~left]], "properties": {"region": region}})
        before[region] = right
    return {"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [10, 20]}, "arcs": arcs, "objects": {"nations": {"type": "GeometryCollection", "geometries": shapes}}}


@query("""
SELECT n_nationkey::VARCHAR AS id, 'Polygon' AS type, n_regionkey::BIGINT AS region, 5::BIGINT AS points, (9 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::DOUBLE AS x, (20 + 2 * n_regionkey)::DOUBLE AS y, 1::DOUBLE AS area FROM nation
""")
def topology_features(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes put together from arcs, one of them backwards: their first corner and area."""
    f = topology.features(spark, _topology(spark, sf), "nations")
    ring = F.from_json(F.get_json_object("geometry", "$.coordinates[0]"), "array<array<double>>")
    f = f.select("id", "type", F.get_json_object("properties", "$.region").cast("long").alias("region"), ring.alias("ring"))
    twice = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 2), F.lit(0.0), lambda a, i: a + F.get("ring", i)[0] * F.get("ring", i + 1)[1] - F.get("ring", i + 1)[0] * F.get("ring", i)[1])
    return f.select("id", "type", "region", F.size("ring").cast("long").alias("points"), F.get("ring", F.lit(0))[0].alias("x"), F.get("ring", F.lit(0))[1].alias("y"), F.abs(twice / 2).alias("area"))


@query("SELECT count(*) * 3 + (SELECT count(DISTINCT n_regionkey) FROM nation) AS segments FROM nation")
def topology_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """The borders, each once: three sides a nation and one more a row."""
    lines = topology.mesh(_topology(spark, sf), "nations")["coordinates"]
    return spark.createDataFrame([(sum(len(x) - 1 for x in lines),)], "segments long")


@query("SELECT (100 + 2 * r_regionkey)::INTEGER AS id, r_name AS name, 'first-letter' AS \"case\" FROM region UNION ALL SELECT 0, '', 'case-sensitive'")
def dump_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """The namespaces of a dump's header, one a region."""
    import bz2
    import os

    spaces = "".join(f'<namespace key="{100 + 2 * r.r_regionkey}" case="first-letter">{r.r_name}</namespace>' for r in table(spark, sf, "region").collect())
    where = f"{scratch.folder(spark).removeprefix('file://').removeprefix('file:')}/millrace/dump-{uuid.uuid4().hex}"
    os.makedirs(where)
    with open(f"{where}/20240102-multistream.xml.bz2", "wb") as f:
        f.write(bz2.compress(f'<mediawiki><siteinfo><sitename>Parts</sitename><namespaces><namespace key="0" case="case-sensitive" />{spaces}</namespaces></siteinfo>'.encode()))
    return dump.namespaces(spark, f"{where}/20240102-multistream.xml.bz2")
