"""The upsert against cases stated by hand, as a batch and as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lettings.streaming import upsert as U

OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
BODY = "size_sqft int, bedrooms int, bathrooms int, postcode string, address string, latitude double, longitude double, property_type string, agent_name string, price_pcm int, price_period string, summary string, added_date string"
LISTING = f"id long, source string, property_id string, {BODY}, is_active int, first_seen timestamp, last_seen timestamp"
BATCH = f"source string, property_id string, {BODY}, arrival int"


def body(address, price, sqft=700, beds=2):
    return (sqft, beds, 1, "SW3 5TR", address, 51.5, -0.1, "flat", "a", price, "pcm", "s", None)


@pytest.fixture
def tables(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    old = [(1, "savills", "a", *body("1 Kings Road", 3000), 0, OLD, OLD), (2, "savills", "b", *body("2 Kings Road", 4000, beds=3), 1, OLD, OLD), (3, "foxtons", "c", *body("3 Kings Road", 5000, 900), 1, OLD, OLD)]
    history = spark.createDataFrame([(1, 3000, OLD), (2, 4000, OLD), (3, 5000, OLD)], "listing_id long, price_pcm int, recorded_at timestamp")
    return spark.createDataFrame(old, LISTING), history


ROWS = [
    ("savills", "a", *body("1 Kings Road", 3200, None), 1),  # known by id; size is kept, price change recorded
    ("savills", "a", *body("1 Kings Road", 9999), 2),  # repeat within the batch
    ("savills", "new-b", *body("2 Kings Road", 4020, beds=3), 3),  # known by place; change too small
    ("foxtons", "new-c", *body("9 Other Street", 5000, 900), 4),  # known by price, size, bedrooms, district
    ("savills", "d", *body("4 Kings Road", 8000, 1500, 4), 5),  # new
]


def checked(listings, added):
    rows = {r["property_id"]: r for r in listings.collect()}
    assert sorted(rows) == ["a", "d", "new-b", "new-c"]
    assert [rows[k]["id"] for k in ("a", "new-b", "new-c")] == [1, 2, 3] and rows["d"]["id"] > 3
    assert (rows["a"]["price_pcm"], rows["a"]["size_sqft"], rows["a"]["is_active"], rows["a"]["first_seen"], rows["a"]["last_seen"]) == (3200, 700, 1, OLD, NOW)
    assert rows["new-b"]["price_pcm"] == 4020 and rows["d"]["first_seen"] == NOW
    assert sorted((r["listing_id"], r["price_pcm"]) for r in added.collect()) == [(1, 3200), (rows["d"]["id"], 8000)]


def test_batch(spark, tables):
    checked(*U.upsert(*tables, spark.createDataFrame(ROWS, BATCH), F.lit(NOW).cast("timestamp")))


def test_empty_batch(spark, tables):
    listings, added = U.upsert(*tables, spark.createDataFrame([], BATCH), F.lit(NOW).cast("timestamp"))
    assert sorted(map(tuple, listings.select(*tables[0].columns).collect())) == sorted(map(tuple, tables[0].collect())) and added.isEmpty()


def test_stream(spark, tables, tmp_path):
    tables[0].write.parquet(f"{tmp_path}/base/listings")
    tables[1].write.parquet(f"{tmp_path}/base/history")
    spark.createDataFrame(ROWS, BATCH).withColumn("at", F.lit(NOW).cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{BATCH}, at timestamp").parquet(f"{tmp_path}/in")
    query = U.start(stream, f"{tmp_path}/base", f"{tmp_path}/out", f"{tmp_path}/cp")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    checked(spark.read.parquet(f"{tmp_path}/out/listings/v=0"), spark.read.parquet(f"{tmp_path}/out/history/v=0"))
