"""Two samples by ranks against plain loops; invariants on rows that break them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lettings.plans.catalogue import QUERIES, Tables, quality


def plain(x, y):
    u = sum((a > b) + (a == b) / 2 for a in x for b in y)
    n, counts = len(x) + len(y), {}
    for v in x + y:
        counts[v] = counts.get(v, 0) + 1
    s = math.sqrt(len(x) * len(y) / 12 * (n + 1 - sum(c**3 - c for c in counts.values()) / (n * (n - 1))))
    z = (max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / s
    return u, z, min(1.0, math.erfc(z / math.sqrt(2)))


@pytest.mark.parametrize("most", [5, 1000])
def test_ranks_equal_loops(spark, most):
    rng = random.Random(99)
    rows = [(rng.randrange(most), rng.random() < 0.4) for _ in range(250)] + [(None, True)]
    got = quality.mann_whitney(spark.createDataFrame(rows, "v int, first boolean"), "v", "first").withColumn("p", F.arrow_udf(quality.two_sided, "double")(F.col("z"))).first()
    x, y = ([v for v, f in rows if v is not None and f == k] for k in (True, False))
    assert (got["n_first"], got["n_second"]) == (len(x), len(y)) and (got["u"], got["z"], got["p"]) == pytest.approx(plain(x, y))


def test_samples_without_spread(spark):
    for rows in ([], [(1, True)], [(1, True), (1, False)]):
        got = quality.mann_whitney(spark.createDataFrame(rows, "v int, first boolean"), "v", "first").first()
        assert got["z"] is None and (got["n_first"], got["n_second"]) == (sum(f for _, f in rows), sum(not f for _, f in rows))


def test_invariants(spark, monkeypatch):
    rows = spark.sql("""select * from values (1, 'a', 'x', 100, 500, timestamp'2024-01-02', timestamp'2024-01-01'), (2, 'a', 'x', 0, 50, timestamp'2024-01-01', timestamp'2024-01-01'), (3, null, 'y', 600000, null, null, null), (4, 'b', null, null, 0, null, null), (5, 'b', null, 5, 60000, null, null)
      as t(id, source, property_id, price_pcm, size_sqft, first_seen, last_seen)""").withColumns({"address": F.lit("1 Road"), "postcode": F.lit("SW3 5TR")})
    monkeypatch.setattr(Tables, "listings", property(lambda self: rows))
    got = {r["rule"]: (r["violations"], r["ok"]) for r in QUERIES["dq_integrity"](spark, "").collect()}
    assert got == {"missing source": (1, False), "missing property_id": (2, False), "repeated key": (2, False), "invalid price": (2, False), "suspicious sqft": (2, True), "fingerprint length": (0, True), "seen order": (1, False)}
