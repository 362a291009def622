"""Every registered query of the library runs; those with SQL agree with it."""

import pytest
from compare import assert_same

from millrace import queries

REGISTRY = queries.load()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(name, spark, sf, duck):
    run, sql = REGISTRY[name]
    df = run(spark, sf)
    if sql is None:
        assert df.columns and df.collect() is not None
    else:
        assert_same(df, duck.sql(sql))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert set(REGISTRY) <= names


def test_whole_tables(spark, sf):
    """SI formats, removal and imputation over all rows of a table, against plain Python."""
    from decimal import ROUND_HALF_UP, Decimal

    def si(x):
        d = Decimal(repr(x))
        d = d.quantize(Decimal(1).scaleb(d.adjusted() - 2), ROUND_HALF_UP)
        e = d.adjusted() // 3 * 3
        return f"{d.scaleb(-e):.{2 - (d.adjusted() - e)}f}" + {0: "", 3: "k", 6: "M"}[e]

    run = lambda name: REGISTRY[name][0](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").collect()
    assert {(r.o_orderkey, r.si, r.si_tens) for r in run("number_si_orders").collect()} == {(o.o_orderkey, si(o.o_totalprice), si(o.o_totalprice * 10)) for o in orders}
    documents, labels = ({r.doc_id for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id").collect()} for name in ("documents", "labels"))
    assert documents - labels and documents & labels
    assert {r.doc_id for r in run("modify_remove_labelled").collect()} == documents - labels
    seen = {(o.o_custkey, o.o_orderpriority) for o in orders}
    got = {(r.o_custkey, r.o_orderpriority): r.total for r in run("impute_orders").collect()}
    assert len(got) == len({c for c, _ in seen}) * len({p for _, p in seen}) > len(seen)
    assert {k for k, v in got.items() if v} == seen


def test_closed_forms_opposite_the_centre(spark, tmp_path):
    """Supplier 720 lies at 180 degrees west on the equator, where azimuthal maps have an infinite scale (F1)."""
    import duckdb

    from millrace.layout import geo

    at = str(tmp_path / "supplier.parquet")
    own = duckdb.connect()
    own.execute(f"COPY (SELECT unnest([719, 720, 721, 2160, NULL])::BIGINT AS s_suppkey) TO '{at}' (FORMAT parquet)")
    own.execute(f"CREATE VIEW supplier AS SELECT * FROM '{at}'")
    run, sql = REGISTRY["geo_closed_forms"]
    assert_same(run(spark, str(tmp_path)), own.sql(sql))
    point = {"type": "Point", "coordinates": [-180, 0]}
    plane = {"scale": 1.0, "translate": [0.0, 0.0]}
    assert geo.path(point, "azimuthalEquidistant", plane).startswith("M-3.142,0m")
    assert geo.path(point, "azimuthalEqualArea", plane) == geo.path(point, "stereographic", plane) == ""
    assert geo.path({"type": "LineString", "coordinates": [[-170, 0], [-180, 0]]}, "azimuthalEquidistant", plane).endswith("L-3.142,0")
