"""Matching of listings against plain loops over a few rows, and literal addresses."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lettings.operators import matching as M
from lettings.plans import duplicates as D

SCHEMA = "id long, source string, district string, normal string, latitude double, longitude double, price_pcm int, bedrooms int"


def some_rows(seed, n=70):
    r = random.Random(seed)
    street = lambda: f"{r.randint(1, 12)} {r.choice(('kings rd', 'kings road', 'sloane st', 'sloane sq', ''))}".strip()
    return [
        (i, r.choice("abc"), r.choice(("SW1", "SW3", None)), r.choice((street(), street(), "")), r.choice((51.5, 51.50005, 51.5002, 0.0, None)), -0.1 + r.choice((0, 0.0001, 0.001)), r.choice((1000, 1020, 1050, 1060, 2000, 0, None)), r.choice((1, 2, 0, None)))
        for i in range(n)
    ]


def close(p, q):
    return bool(p and q) and abs(p - q) / max(p, q) <= 0.05


def reason(a, b):
    if a[4] and b[4] and a[7] == b[7] and close(a[6], b[6]):
        h = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
        if 2 * 6371000 * math.atan2(h**0.5, (1 - h) ** 0.5) <= 15:
            return "coords"
    if a[6] == b[6] and a[7] == b[7] and len(a[3]) >= 10 and a[3][:25] == b[3][:25]:
        return "exact"
    if a[7] == b[7] and close(a[6], b[6]) and a[3] and b[3] and SequenceMatcher(None, a[3], b[3]).ratio() >= 0.85:
        return "fuzzy"
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_groups(spark, seed):
    rows = some_rows(seed)
    want, taken = set(), set()
    ordered = sorted(rows, key=lambda x: (x[6] is not None, x[6] or 0, x[0]))
    for i, a in enumerate(ordered):
        if a[0] in taken:
            continue
        for b in ordered[i + 1 :]:
            if b[0] not in taken and a[2] == b[2] and (why := reason(a, b)):
                want.add((a[0], b[0], why))
                taken.add(b[0])
    df = spark.createDataFrame(rows, SCHEMA)
    groups = M.greedy_groups(M.matches(df, "district"))
    assert {tuple(r) for r in groups.select("leader", "member", "reason").collect()} == want
    assert {r["leader"] for r in M.group_reasons(groups).collect()} == {x[0] for x in want}
    assert M.greedy_groups(M.matches(df.limit(0), "district")).isEmpty()


@pytest.mark.parametrize("seed", [3, 4])
def test_cross_pairs_and_components(spark, seed):
    rows = [(*r[:2], r[2] or "UNKNOWN", *r[3:]) for r in some_rows(seed, 60)]
    want = {}
    for a in rows:
        for b in rows:
            p, q = a[3], b[3]
            if a[1] < b[1] and a[2] == b[2] and p and q and not (a[6] and b[6] and not close(a[6], b[6])) and not (a[7] and b[7] and a[7] != b[7]):
                s = 1.0 if p == q else 0.9 if p in q or q in p else SequenceMatcher(None, p, q).ratio()
                if s >= 0.85:
                    want[a[0], b[0]] = round(s, 9)
    pairs = M.cross_pairs(spark.createDataFrame(rows, SCHEMA))
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in pairs.collect()} == want
    root = {i: i for pair in want for i in pair}
    while any(root[a] != root[b] for a, b in want):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["root"] for r in M.components(pairs).collect()} == root


def test_components_of_a_path(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in M.components(path).collect()} == {(i, 0) for i in range(41)}
    assert M.components(path.limit(0)).isEmpty()


@pytest.mark.parametrize(("address", "a", "b"), [
    ("Flat 2, 14 Kings Road, London", "flat 2 14 kings road", "14 kings rd"), ("14-16  Sloane Street, SW1", "14 16 sloane street", "14-16 sloane st"), ("The Lodge apartment 3", "the lodge apartment 3", "the lodge"), ("", "", ""), (None, "", ""),
])
def test_normal_addresses(spark, address, a, b):
    text = F.lit(address).cast("string")
    assert tuple(spark.range(1).select(D.normal_a(text), D.normal_b(text)).first()) == (a, b)


@pytest.mark.parametrize("bands", [0, 1, 1000])
def test_texts_meet_by_block_or_by_band_alike(spark, monkeypatch, bands):
    """However many texts count as wide, the pairs are the same; rows meet by text, so that no district is left in the plan of the last join."""
    rows = spark.createDataFrame([(*r[:2], r[2] or "UNKNOWN", *r[3:]) for r in some_rows(5, 80)], SCHEMA)
    want = {tuple(r) for r in M.cross_pairs(rows).collect()}, {tuple(r) for r in M.fuzzy_pairs(rows, "district").collect()}
    monkeypatch.setattr(M, "BANDS", bands)
    pairs = M.cross_pairs(rows)
    assert ({tuple(r) for r in pairs.collect()}, {tuple(r) for r in M.fuzzy_pairs(rows, "district").collect()}) == want and all(want)
    plan = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")
    assert "district" not in plan and "text_b" in plan


def test_the_bound_leaves_no_ratio_out(spark):
    r = random.Random(6)
    texts = ["", "a", "12 kings rd", "flat 1 12 kings road", "é" * 5, "Ā" * 5] + ["".join(r.choice("abcé1 ") for _ in range(r.randrange(12))) for _ in range(40)]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for row in rows.select("x", "y", M.sequence_ratio(F.col("x"), F.col("y"), 0.6).alias("r")).collect():
        want = SequenceMatcher(None, row["x"], row["y"]).ratio() if row["x"] and row["y"] else 0.0
        assert row["r"] == (want if want >= 0.6 else 0.0)


@pytest.mark.parametrize("lot", [3, 50, 10_000])
def test_a_forest_connects_what_the_pairs_connect(spark, monkeypatch, lot):
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", lot)
    r = random.Random(lot)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1000 + j) for i in range(40) for j in range(i)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(2)
    root = {i: i for a, b in pairs if a != b for i in (a, b)}
    while any(root[a] != root[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {x["id"]: x["root"] for x in M.components(df).collect()} == root
    made = M.forest(df.where("a <> b").coalesce(1)).collect()
    assert len(made) < len(root) if lot == 10_000 else {i for p in made for i in p} == set(root)


def test_counts_and_sizes_are_taken_without_looking_pairs_up(spark):
    """Pairs carry what is counted and chosen; the figures are those of the pairs."""
    rows = spark.createDataFrame([(*r[:2], r[2] or "UNKNOWN", *r[3:], 500 + r[0] if r[0] % 3 else None) for r in some_rows(7, 80)], SCHEMA + ", size int")
    rows = rows.withColumn("sized", F.col("size").isNotNull())
    told = {r["id"]: (r["source"], r["size"]) for r in rows.collect()}
    pairs = {(r["a"], r["b"]) for r in M.cross_pairs(rows).collect()}
    got = M.cross_matches(rows, "size", unlike="sized").select("id_a", "id_b", "source_a", "size_b").collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == {(a, b) for a, b in pairs if (told[a][1] is None) != (told[b][1] is None)} and got
    assert all(told[r["id_a"]][0] == r["source_a"] and told[r["id_b"]][1] == r["size_b"] for r in got)
