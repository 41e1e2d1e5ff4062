"""Every query against its SQL, on the smallest tables, and the parts without SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from blockloom.streaming.rolling import rolling_rollup

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_like_its_sql(spark, sf, duck, name):
    mine = entry.queries()[name](spark, sf)
    other = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert sorted(columns) == sorted(mine.columns)
    want = sorted((tuple(plain(v) for v in r) for r in other.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in mine.collect()), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_like_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rolling_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 3)) for r in df.collect())
    assert key(spark.table("rolled")) == key(rolling_rollup(events).withColumn("total", F.col("total")))
