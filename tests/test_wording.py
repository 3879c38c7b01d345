"""What texts of listings say, as literal cases."""

import pytest
from pyspark.sql import functions as F

from lettings.functions import wording as W


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("said", "floor", "furnished"), [
    ("A 3rd floor flat, part furnished", 3, "furnished"), ("Ground floor and basement, UNFURNISHED", 0, "unfurnished"), ("lower ground floor", 0, None), ("Lower  ground level", -1, None),
    ("Penthouse, furnished", 99, "furnished"), ("21st floor, top floor", 21, None), ("", None, None), (None, None, None),
])
def test_floor_and_furnishing(spark, said, floor, furnished):
    assert (value(spark, W.floor_level(text(said))), value(spark, W.furnished(text(said)))) == (floor, furnished)


@pytest.mark.parametrize(("said", "there"), [
    ("Roof  terrace with air-con and 24 hour porterage", {"has_roof_terrace", "has_terrace", "has_outdoor_space", "has_porter"}), ("two balconies, a/c, luxurious", {"has_balcony", "has_outdoor_space", "has_ac", "is_luxury"}),
    ("period features, floor to ceiling windows", {"is_period", "has_floor_to_ceiling"}), ("gardens and terraces", set()), (None, set()),
])
def test_amenities(spark, said, there):
    row = spark.range(1).select(*[c.alias(n) for n, c in W.amenities(text(said)).items()]).first().asDict()
    assert {n for n, v in row.items() if v} == there and None not in row.values()


@pytest.mark.parametrize(("agent", "agency", "competitor", "brand"), [
    ("Draker KFH, Chelsea", "KFH", "KFH", "KFH"), ("marsh and parsons", "Marsh & Parsons", "Other", "marsh and parsons"), ("A small firm, Fulham", "A small firm", "Other", "A small firm"),
    ("An agency with a name of over thirty letters", "An agency with a name of over ", "Other", "An agency with a name of over thirty letters"), ("", "Unknown", "Other", "unknown"), (None, "Unknown", "Other", "unknown"),
])
def test_agents(spark, agent, agency, competitor, brand):
    a = text(agent)
    assert tuple(spark.range(1).select(W.agency(a), W.competitor(a), W.brand(a)).first()) == (agency, competitor, brand)


@pytest.mark.parametrize(("said", "amount", "period", "sqft"), [
    ("£2,500 pcm, 1,020 sq. ft", 2500, "pcm", 1020), ("now £ 600 Per Week / 800 square feet", 600, "pw", 800), ("£1950, 75 sqm", 1950, "pcm", None), ("POA", None, None, None), ("£, sq ft", None, None, None), (None, None, None, None),
])
def test_price_and_size(spark, said, amount, period, sqft):
    found = W.price_in_text(text(said))
    assert tuple(spark.range(1).select(found["amount"], found["period"], W.sqft_in_text(text(said))).first()) == (amount, period, sqft)


@pytest.mark.parametrize(("kind", "standard"), [(" Apartment", "flat"), ("Mews", "house"), ("duplex", "maisonette"), ("Serviced Apartments", "serviced"), ("house boat", "other"), ("castle", "other"), ("Short let", "flat"), ("", "flat"), (None, "flat")])
def test_types(spark, kind, standard):
    assert value(spark, W.standard_type(text(kind))) == standard


def test_area_and_id(spark):
    assert value(spark, W.district_of_area(F.lit("Chelsea"))) == "SW3" and value(spark, W.district_of_area(F.lit("Leeds"))) is None
    assert value(spark, W.id_by_hash("x_", F.lit("a"))) == "x_ca978112ca1bbdca"
