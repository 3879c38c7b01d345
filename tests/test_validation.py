"""Rules of a listing, by literal cases."""

from pyspark.sql import functions as F

from lettings.functions import listing as X
from lettings.plans.catalogue import QUERIES, Tables

GOOD = {"source": "savills", "property_id": "p", "price_pcm": 3000, "address": "1 Kings Road", "url": "https://x.example/1", "bedrooms": 2, "size_sqft": 700}
CASES = [
    ({}, [], True),
    ({"source": None}, ["missing source"], False),
    ({"property_id": ""}, ["missing property_id"], False),
    ({"price_pcm": None}, ["missing/invalid price_pcm"], True),
    ({"price_pcm": -5}, ["missing/invalid price_pcm"], True),
    ({"price_pcm": 99}, ["price_pcm too low (99)"], True),
    ({"price_pcm": 100}, [], True),
    ({"price_pcm": 500_001}, ["price_pcm suspiciously high (500001)"], True),
    ({"address": "1 Ki"}, ["missing/invalid address"], True),
    ({"url": None}, ["missing url"], False),
    ({"url": "ftp://a.very.long.address.example.com/x"}, ["invalid url format (ftp://a.very.long.address.exam...)"], True),
    ({"bedrooms": 21}, ["invalid bedrooms (21)"], True),
    ({"bedrooms": -1}, ["invalid bedrooms (-1)"], True),
    ({"bedrooms": None, "size_sqft": None}, [], True),
    ({"size_sqft": 49}, ["sqft too small (49)"], True),
    ({"size_sqft": 50_001}, ["sqft too large (50001)"], True),
    ({"source": "", "property_id": None, "price_pcm": 0, "address": None, "url": "", "bedrooms": 30, "size_sqft": 1}, ["missing source", "missing property_id", "missing/invalid price_pcm", "missing/invalid address", "missing url", "invalid bedrooms (30)", "sqft too small (1)"], False),
]


def test_issues(spark):
    rows = [(i, *(GOOD | c).values()) for i, (c, _, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "i int, source string, property_id string, price_pcm int, address string, url string, bedrooms int, size_sqft int")
    found = X.issues({c: F.col(c) for c in table.columns})
    got = {r["i"]: (r["f"], r["k"], r["v"]) for r in table.select("i", found.alias("f"), X.acceptable(found).alias("k"), X.acceptable(found, True).alias("v")).collect()}
    assert got == {i: (issues, kept, not issues) for i, (_, issues, kept) in enumerate(CASES)}


def test_days_on_market_are_of_the_rows(spark, monkeypatch):
    table = spark.sql("select * from values (1, timestamp'2024-01-01', timestamp'2024-01-03 23:00:00'), (2, timestamp'2024-01-01', timestamp'2024-01-11'), (3, timestamp'2024-01-01', null) as t(id, first_seen, last_seen)")
    monkeypatch.setattr(Tables, "listings", property(lambda self: table))
    assert {r["days"]: r["cumulative"] for r in QUERIES["agg_cdf"](spark, "").collect()} == {2: 50.0, 10: 100.0}
