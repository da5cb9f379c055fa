"""Every registered query against its SQL on the smallest tables, and the operators that SQL can't express."""

import duckdb
import pytest
from pyspark.sql import functions as F

from canopy.operators import quality
from canopy.operators.histogram import fixed_histogram
from canopy.plans.forest_queries import ORACLES, QUERIES
from canopy.schema import Property, output_schema
from canopy.streaming import running_histogram

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "orders lineitem embeddings".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(v, 5) + 0.0 if isinstance(v, float) and v == v else (-1e99 if v != v else v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-5)
    else:
        assert len(got)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,), (2.0,), (2.1,), (-0.1,), (None,)], "x double")
    assert [r.n for r in fixed_histogram(df, F.col("x"), 0.0, 2.0, 2).orderBy("bin").collect()] == [2, 3]
    assert [r.n for r in fixed_histogram(df.limit(0), F.col("x"), 0.0, 2.0, 2).orderBy("bin").collect()] == [0, 0]


def test_quality_counts(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0, 3.0]), (float("nan"), [0.0, 99.0, 1.0]), (-1.0, [float("inf"), 1.0, 1.0])], "a double, v array<double>")
    got = {r["column"]: tuple(r)[1:] for r in quality.profile(df, {"a": Property("a", "double", valid=(0, 10), sentinels=(-1.0,)), "v": Property("v", "vec3", valid=(0, 50))}).collect()}
    assert got == {"a": (1, 0, 0, 0), "v[0]": (0, 1, 1, 1), "v[1]": (0, 0, 0, 1), "v[2]": (0, 0, 0, 0)}


def test_output_schema_has_its_46_fields():
    assert len(output_schema().fields) == 46


def test_running_histogram_of_a_stream(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("snap"), (F.col("id") / 10).alias("x")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("snap long, x double").parquet(str(tmp_path / "in"))
    q = running_histogram(stream, F.col("x"), 0.0, 1.0, 2, ["snap"]).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("hist").collect()) == [(0, 0, 3), (0, 1, 2), (1, 0, 2), (1, 1, 3)]
