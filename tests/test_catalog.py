"""Every registered raster query against its DuckDB equivalent, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(columns).collect())))
    assert got
    if name in catalog.ORACLE_SQL:
        r = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(repr, duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall()))


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_average_needs_one_shuffle(spark):
    """The block average is partial before its only exchange."""
    plan = catalog.QUERIES["downsample_avg_2"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_avg" in plan


def test_rpc_inverse_covers_the_raster(spark):
    """Every pixel is there, and the model takes its coordinates back to it."""
    import numpy as np

    from gridloom.functions import geo
    from gridloom.sources import rasters

    got = catalog.QUERIES["rpc_inverse"](spark, DATA).toPandas()
    assert len(got) == rasters.vectors(spark, DATA).count() > 1200
    line, samp = geo.Rpc(catalog.rpc_example()).forward(got["y"].to_numpy(), got["x"].to_numpy(), np.full(len(got), 200.0))
    np.testing.assert_allclose(line, got["row"] * 10.0, atol=0.02)
    np.testing.assert_allclose(samp, got["col"] * 10.0, atol=0.02)


def test_utm_far_beyond_its_zone(spark, tmp_path):
    """Growing keys take x out of every zone, where orders of the series differ and then diverge; zeros keep their sign, and NaN is not null."""
    c = duckdb.connect()
    keys = "SELECT * FROM range(0, 900000, 997) UNION ALL SELECT unnest([55379, 65705, 74408, 284155, 288481, 899999])"
    c.sql(f"CREATE TABLE customer AS SELECT k AS c_custkey, (k * 7919 % 1099965) / 100.0::DOUBLE - 999.85 AS c_acctbal FROM ({keys}) AS t(k)")
    c.sql("INSERT INTO customer VALUES (NULL, 1.5), (7, NULL), (8, 'nan'), (9, 'inf'), (5600000, 1), (6000000, 2)")
    c.sql(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    columns = ["c_custkey", "x", "y", "lon", "lat", "known"]
    got = sorted(map(repr, map(tuple, catalog.QUERIES["utm_to_wgs84"](spark, str(tmp_path)).select(columns).collect())))
    assert got == sorted(map(repr, c.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL['utm_to_wgs84']})").fetchall()))
    assert any("-0.0" in r for r in got) and any("nan" in r for r in got) and any("None" in r for r in got)
