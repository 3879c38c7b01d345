"""Pairs of prices and places against a plain loop."""

import random

from lettings.plans import joins


def test_addresses_that_hold_a_place_are_those_of_a_loop(spark):
    rng = random.Random(12)
    parts = ["Flat 1", "1 Kings Road", "11 Kings Road", "1 Kings", "Road", "", "The Long Lodge", "Lodge", "é Kings Road"]
    rows = list(enumerate(sorted({(rng.choice("PQ"), ", ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for _ in range(120)})))
    rows = [(i, code, address, address.split(", ")[-1]) for i, (code, address) in rows]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (b[3] in a[2] or a[3] in b[2])}
    got = joins.holding(spark.createDataFrame(rows, "at long, postcode string, address string, place string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
