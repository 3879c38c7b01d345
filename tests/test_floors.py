"""Floors told by texts, case by case; the regression against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettings.functions.floors import floor_info
from lettings.plans.catalogue import QUERIES, Tables, floors

DATA = "/root/testdata/sf0.001"
# level, category, several, span, lift, confidence
CASES = {
    "Penthouse with lift": (None, "penthouse", False, 1, True, "high"),
    "basement flat": (-1.0, "basement", False, 1, None, "high"),
    "basement of a penthouse": (-1.0, "basement", False, 1, None, "high"),
    "lower ground floor": (0.0, "ground", False, 1, None, "high"),  # it has the words "ground floor" too
    "lower ground and basement": (-0.5, "lower_ground", False, 1, None, "high"),
    "Ground floor, no lift": (0.0, "ground", False, 1, True, "high"),  # "no lift" has the word lift
    "walk-up": (None, None, False, 1, False, "none"),
    "top floor": (None, "top_floor", False, 1, None, "medium"),
    "top floor, fifth floor": (5.0, "top_floor", False, 1, None, "high"),
    "penthouse on the 9th floor": (9.0, "penthouse", False, 1, None, "high"),
    "ground floor and first floor": (1.0, "ground", False, 1, None, "high"),  # the word overrides the level, not the category
    "ground floor, 3rd floor": (0.0, "ground", False, 1, None, "high"),  # nothing is open
    "second floor": (2.0, "lower", False, 1, None, "high"),
    "third floor, 7th floor": (7.0, "high", False, 1, None, "high"),  # the category was open
    "floor 4": (4.0, "mid", False, 1, None, "high"),
    "6 floor": (6.0, "high", False, 1, None, "high"),
    "2 floors": (None, None, True, 2, None, "none"),
    "arranged over three floors, a duplex": (None, None, True, 3, None, "none"),
    "maisonette": (None, None, True, 2, None, "none"),
    "triplex over 2 floors": (None, None, True, 3, None, "none"),
    "twelfth floor and second floor": (2.0, "lower", False, 1, None, "high"),  # the first word of the list counts
    "": (None, None, False, 1, None, "none"),
    None: (None, None, False, 1, None, "none"),
}


def test_precedence_case_by_case(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").withColumns(floor_info(F.col("t")))
    assert {r["t"]: (r["floor_level"], r["floor_category"], r["is_multi_floor"], r["num_floors_span"], r["has_lift"], r["floor_confidence"]) for r in rows.collect()} == CASES


def numpy_fit(rows):
    x, y = rows[:, :-1], rows[:, -1]
    a = np.column_stack([x - x.mean(0)])
    b = np.linalg.lstsq(a, y - y.mean(), rcond=None)[0]
    return b, y.mean() - x.mean(0) @ b, 1 - ((y - y.mean() - a @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(81)
    x = np.column_stack([rng.normal(7, 0.5, 400), rng.integers(0, 6, 400), rng.integers(0, 300, 400), rng.integers(0, 2, 400), np.zeros(400)])
    y = 3 + x @ [0.8, 0.1, -0.002, 0.05, 0] + rng.normal(0, 0.2, 400)
    data = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, e double, y double")
    got, intercept, r2, n = floors.least_squares(data, list("abcde"), "y")
    b, c, r = numpy_fit(np.column_stack([x, y]))
    assert np.allclose(list(got.values()), b, rtol=1e-9, atol=1e-12) and intercept == pytest.approx(c, rel=1e-9) and r2 == pytest.approx(r, rel=1e-9) and n == 400
    assert floors.least_squares(data.limit(0), list("abcde"), "y") == (dict.fromkeys("abcde", 0.0), 0.0, 0.0, 0)


def test_regression_of_the_tables(spark):
    rows = np.array([tuple(r)[1:] for r in floors.regression_rows(Tables(spark, DATA)).collect()], float)
    used = rows[:, rows.std(0) > 0]
    b, c, r = numpy_fit(used)
    got = {x["name"]: x for x in QUERIES["r_floor_regression"](spark, DATA).collect()}
    coefficients = np.array([got[n]["coefficient"] for n in floors.REGRESSORS])
    fitted = rows[:, :-1] @ coefficients + got["intercept"]["coefficient"]
    assert np.allclose(fitted, used[:, :-1] @ b + c, rtol=1e-9) and got["intercept"]["r2"] == pytest.approx(r, rel=1e-9) and got["has_lift"]["percent"] == pytest.approx(100 * (np.exp(got["has_lift"]["coefficient"]) - 1))
