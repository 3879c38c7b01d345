"""The rent model's rows, places, trees; the nearest point against all distances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lettings.functions import places
from lettings.functions.floors import floor_flags
from lettings.operators.nearest import nearest
from lettings.plans.catalogue import QUERIES, Tables, rent_model

DATA = "/root/testdata/sf0.01"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 12742 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("spread", [0.02, 3, 160])
def test_nearest_equals_all_distances(spark, spread):
    rng = random.Random(61)
    at = lambda: (rng.uniform(-spread / 2, spread / 2) * 0.9 + 0.001, rng.uniform(-spread, spread))
    points = [(i, *at()) for i in range(200)] + [(900, 0.0, 1.0), (901, None, 1.0), (902, float("nan"), 1.0)]
    points.append((903, *points[0][1:]))
    targets = [(f"t{i}", *at()) for i in range(40)]
    targets += [("a", *targets[0][1:]), ("null", None, 2.0), (None, 0.0, 0.0)]
    got = {r["id"]: (r["name"], r["km"]) for r in nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(targets, "name string, lat double, lon double")).collect()}
    want = {i: min((km(y, x, a, b), n) for n, a, b in targets if a) for i, y, x in points if y and not math.isnan(y)}
    assert got.keys() == want.keys() and all(got[i][0] == n and got[i][1] == pytest.approx(d, abs=1e-6) for i, (d, n) in want.items())


def test_nearest_without_rows(spark):
    some = spark.createDataFrame([(1, 5.0, 5.0)], "id long, lat double, lon double")
    none = spark.createDataFrame([], "name string, lat double, lon double")
    assert nearest(some, none).collect() == [] and nearest(some.limit(0), none).collect() == []


def test_centres_of_districts(spark):
    cases = [(51.5, -0.1, "SW3", 51.5, -0.1), (0.0, -0.1, "SW3", 51.49, -0.168), (None, None, "SW10", 51.483, -0.182), (None, None, "SW1X", 51.497, -0.14), (None, None, "W1K", 51.515, -0.145), (None, None, "XX1", None, None), (0.0, 0.0, None, 0.0, 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lat double, lon double, d string, y double, x double")
    y, x = places.filled(F.col("lat"), F.col("lon"), F.col("d"))
    assert rows.where(~(y.eqNullSafe(F.col("y")) & x.eqNullSafe(F.col("x")))).isEmpty()


def test_floors_of_texts(spark):
    cases = {"Ground and first floor flat": (0, 0, 1), "Lower ground floor with basement": (1, 0, 0), "ground floor and basement, 1st floor": (1, 1, 1), None: (0, 0, 0), "": (0, 0, 0)}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", *[c.alias(n) for n, c in floor_flags(F.col("t")).items()])
    assert {r["t"]: (r["has_basement"], r["has_ground"], r["has_first_floor"]) for r in rows.collect()} == cases


def listing(i, source="savills", price=3000, size=700, beds=2, postcode="SW3 5TR", active=1, period="pcm", summary="Long let"):
    return (i, source, price, size, beds, postcode, active, period, summary)


def test_loaded_rows_by_literal_cases(spark, monkeypatch):
    rows = [
        listing(1, "foxtons"), listing(2, "chestertons"), listing(3, "knightfrank"),  # one home: the third source of the order wins
        listing(4, price=3001, source="unheard"), listing(5, price=3001, source="rightmove"), listing(6, price=3001, source="rightmove"),
        listing(7, price=3002, postcode=""), listing(8, price=3002, postcode=None),  # no district is one district
        listing(9, price=3003, active=0), listing(10, price=3004, period="pw"), listing(11, price=3005, period=None), listing(12, price=3006, period=""),
        listing(13, price=3007, summary="A SHORT LET"), listing(14, price=3008, summary="short-let"), listing(15, price=3009, summary=None),
        listing(16, price=499), listing(17, size=139), listing(18, price=100001, size=9000), listing(19, price=2099), listing(20, price=2100), listing(21, beds=11), listing(22, beds=10, price=3010), listing(23, beds=0, size=160, price=3011), listing(24, beds=None, price=3012), listing(25, size=None, price=3013),
    ]
    table = spark.createDataFrame(rows, "id long, source string, price_pcm int, size_sqft int, bedrooms int, postcode string, is_active int, price_period string, summary string")
    monkeypatch.setattr(Tables, "listings", property(lambda self: table))
    assert sorted(r["id"] for r in rent_model.loaded(Tables(spark, "")).collect()) == [3, 5, 7, 11, 12, 15, 20, 22, 23]


def test_names_that_tell_of_the_target():
    assert rent_model.leaky(["size_sqft", "ppsf_mean", "district_encoded", "is_luxury", "old_price"]) == ["ppsf_mean", "district_encoded", "is_luxury", "old_price"]
    assert rent_model.leaky(list(rent_model.NAMES)) == ["luxury_amenity_score"]


@pytest.fixture(scope="module")
def market(spark):
    """Listings whose rent follows size, bedrooms and district, but for noise."""
    rng = random.Random(62)
    rows = []
    for i in range(900):
        size, beds, (postcode, rate) = rng.randrange(300, 2500), rng.randrange(4), rng.choice([("SW3 5TR", 9), ("W8 4AA", 8), ("E14 9AB", 4), ("NW1 2QG", 5)])
        rows.append((i, "savills", int(size * rate * math.exp(rng.gauss(0, 0.1))), size, beds, postcode, 1, "pcm", "Long let", 51.5, -0.1, "flat", "Savills", 1))
    table = spark.createDataFrame(rows, "id long, source string, price_pcm int, size_sqft int, bedrooms int, postcode string, is_active int, price_period string, summary string, latitude double, longitude double, property_type string, agent_name string, bathrooms int")
    return type("Made", (Tables,), {"listings": property(lambda self: table)})(spark, "")


@pytest.fixture(scope="module")
def predicted(market):
    return rent_model.lasting(rent_model.pooled(market, folds=3, model=rent_model.trees(iterations=8)))


def test_every_loaded_row_is_predicted_once_and_better_than_by_its_district(market, predicted):
    loaded = {r["id"]: r for r in rent_model.loaded(market).collect()}
    rows = predicted.collect()
    assert sorted(r["id"] for r in rows) == sorted(loaded) and {r["fold"] for r in rows} == set(range(3))
    error = means = 0
    for r in rows:
        others = [x["price_pcm"] for x in rows if x["fold"] != r["fold"] and loaded[x["id"]]["district"] == loaded[r["id"]]["district"]]
        error += abs(r["predicted"] - r["price_pcm"])
        means += abs(sum(others) / len(others) - r["price_pcm"])
    assert error < means / 2


def test_errors_are_those_of_plain_loops(predicted):
    rows = [(r["predicted"], r["price_pcm"]) for r in predicted.collect()]
    got = predicted.agg(*rent_model.errors(predicted)).first().asDict()
    gaps, n, mean = [abs(p - y) for p, y in rows], len(rows), sum(y for _, y in rows) / len(rows)
    shares = sorted(g / y for g, (_, y) in zip(gaps, rows, strict=True))
    want = {"n": n, "mae": sum(gaps) / n, "rmse": math.sqrt(sum(g * g for g in gaps) / n), "r2": 1 - sum(g * g for g in gaps) / sum((y - mean) ** 2 for _, y in rows), "mape": 100 * sum(shares) / n, "median_ape": 50 * (shares[(n - 1) // 2] + shares[n // 2])}
    assert got == pytest.approx(want)


def test_trees_are_repeatable(market, predicted):
    again = rent_model.pooled(market, folds=3, model=rent_model.trees(iterations=8))
    assert {r["id"]: r["predicted"] for r in again.collect()} == pytest.approx({r["id"]: r["predicted"] for r in predicted.collect()})


def test_importances(spark, monkeypatch):
    monkeypatch.setattr(rent_model, "trees", lambda f=rent_model.trees: f(iterations=3))
    rows = QUERIES["ml_importance"](spark, DATA).collect()
    assert len(rows) == 25 and [r["rank"] for r in rows] == list(range(1, 26)) and all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:]))
