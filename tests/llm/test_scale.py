"""Nearest vectors of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettings.llm import neighbours


def found(spark, vectors):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(rows, F.col("vec_id") % 10 == 0).collect()}


def test_lengths_make_no_difference(spark):
    rng = np.random.default_rng(101)
    plain = rng.normal(size=(120, 16))
    want = found(spark, plain)
    # Powers of two leave every bit of a cosine as it is.
    assert found(spark, plain * 2.0 ** rng.integers(-900, 900, (120, 1))) == want
    other = found(spark, plain * 10.0 ** rng.integers(-290, 290, (120, 1)))
    assert {k: v[0] for k, v in other.items()} == {k: v[0] for k, v in want.items()}
    assert all(other[k][1] == pytest.approx(v[1], abs=1e-12) for k, v in want.items())
