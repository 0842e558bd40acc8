"""Every registered query beside its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphmatch import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(catalog.ORACLE_SQL[name])
    order = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((plain(tuple(r[k] for k in order)) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    """Distances are plain expressions, so they work on streams."""
    from glyphmatch.functions.metrics import text_distance

    spark.createDataFrame([("abc", "abd"), ("a", "b")], "a string, b string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in")).select(text_distance("a", "b", "osa").alias("d"))
    query = stream.writeStream.format("memory").queryName("distances").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.d for r in spark.table("distances").collect()) == [1, 1]


def test_matches_of_a_stream(spark, tmp_path):
    from glyphmatch.streaming import match_stream

    spark.createDataFrame([(1, "fu"), (2, "barz"), (3, None)], "id long, x string").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([(1, "foo"), (2, "bar")], "pos long, t string")
    stream = spark.readStream.schema("id long, x string").parquet(str(tmp_path / "in"))
    query = match_stream(stream, table, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), max_dist=1, method="lv").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.id, r.match) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, None), (2, 2), (3, None)]
