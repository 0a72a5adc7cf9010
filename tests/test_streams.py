"""Streams over tables of several files whose times overlap."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barframe.queries import ORACLE_SQL, QUERIES
from barframe.streaming.bars import _partial_bars

from .test_entry import FOLDER, rows


@pytest.mark.parametrize("name", ["stream_bars", "stream_average"])
def test_streams_of_overlapping_files_equal_their_sql(spark, name, tmp_path):
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want, got = rows(db.execute(ORACLE_SQL[name]).df()), rows(QUERIES[name](spark, str(tmp_path)).toPandas())
    assert len(want) == len(got) > 0
    assert all(x == y or isinstance(x, float) and abs(x - y) < 2e-6 for a, b in zip(want, got) for x, y in zip(a, b))


def test_ticks_are_combined_into_bars_before_the_state(spark):
    rng = random.Random(2)
    ticks = [("hot", k % 7, rng.randrange(1000), k, float(k)) for k in range(60_000)]
    table = spark.createDataFrame(ticks, "symbol string, bar long, at long, tie long, price double").repartition(3).withColumn("ticks", F.lit(1).cast("long"))
    got = table.mapInArrow(_partial_bars, table.schema)
    assert got.count() == 21
    newest = got.groupBy("bar").agg(F.max_by("price", F.struct("at", "tie")).alias("price"), F.sum("ticks").alias("n")).collect()
    assert {r.bar: r.price for r in newest} == {b: max((t for t in ticks if t[1] == b), key=lambda t: t[2:4])[4] for b in range(7)}
    assert sum(r.n for r in newest) == 60_000
