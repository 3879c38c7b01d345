"""Texts of floorplans: cases by hand, and plain loops over generated texts."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lettings.functions import floorplan as P

AREAS = {
    "Main Area = 2038 sq ft\nGarage = 129 sq ft\nTotal = 201 sq m / 2167 sq ft": (2167, 201),
    "Approximate Gross Internal Area = 4627 sq ft": (4627, None),
    "Total Area 1,234.9 sqft (114.7 sqm)": (1234, 114),
    "First floor 800 sq ft total\nSecond floor 700 sq ft total": (800, None),
    "Total 90 sq ft": (None, None),  # too little for a total, and for any number
    "Kitchen 150 sq ft\nHouse 1540 square feet": (1540, None),
    "Kitchen 150 sq ft": (None, None),
    "Total = 20 sq m / 99 sq ft, 300 sq ft": (300, 20),
    "143 sq m": (None, None),
    "": (None, None),
    None: (None, None),
}
FLOORS = {
    "Basement\nGround Floor\nMezzanine\nFirst Floor\nSecond Floor\nThird Floor": (6, "multi_floor", {"has_basement", "has_ground", "has_mezzanine", "has_first_floor", "has_second_floor", "has_third_floor"}),
    "LOWER GROUND FLOOR": (2, "duplex", {"has_lower_ground", "has_ground"}),
    "4th Floor, 5th Floor and 6th Flocr": (3, "triplex", {"has_fourth_plus"}),
    "Fifteenth, Sixteenth and Seventeenth": (3, "triplex", set()),
    "14th fioor": (2, "duplex", {"has_fourth_plus"}),  # 4th is found inside
    "2nth Floor": (1, "single_floor", {"has_second_floor"}),
    "Ground Floor\nexcluding the basement\nReduced  headroom on the first floor\nnot included: cellar": (1, "single_floor", {"has_ground"}),
    "Roof terrace": (0, "single_floor", {"has_roof_terrace"}),
    "Penthouse on the 8th": (1, "single_floor", {"has_fourth_plus"}),
    "LGF and GF": (2, "duplex", {"has_lower_ground", "has_ground"}),
    "": (0, "single_floor", set()),
    None: (0, "single_floor", set()),
}



def test_areas(spark):
    sqft, sqm = P.total_area(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in AREAS], "t string").select("t", sqft.alias("a"), sqm.alias("b")).collect()
    assert {r["t"]: (r["a"], r["b"]) for r in rows} == AREAS


def test_floors(spark):
    rows = spark.createDataFrame([(t,) for t in FLOORS], "t string").withColumns(P.floors(F.col("t"))).collect()
    assert {r["t"]: (r["floor_count"], r["property_levels"], {k for k, v in r.asDict().items() if k.startswith("has_") and v}) for r in rows} == FLOORS
    assert next(r["floors"] for r in rows if r["t"] == "LOWER GROUND FLOOR") == ["Ground Floor", "Lower Ground"]


def plain_feet(text):
    m = re.search(P.FEET, text)
    return (m.group(0), int((int(m[1]) + int(m[2] or 0) / 12) * (int(m[3]) + int(m[4] or 0) / 12))) if m else (None, None)


def plain_rooms(text):
    out = []
    for line in (text or "").split("\n"):
        kind = next((k for k, p in P.ROOMS.items() if re.search(p, line.lower().strip())), None)
        if not kind:
            continue
        words = []
        for w in line.split():
            if w[0].isupper() or w.lower() in ("and", "with", "room"):
                words.append(w)
            elif words:
                break
        metric, height = re.search(P.METRES, line), re.search(r"CH\s*(\d+\.?\d*)\s*m?", line, re.I)
        out.append((kind, " ".join(words) or kind.title(), *(plain_feet(line)[:1]), f"{metric[1]} x {metric[2]}" if metric else None, plain_feet(line)[1], round(float(metric[1]) * float(metric[2]), 1) if metric else None, height[1] + "m" if height else None))
    return out


def plain_outdoor(text):
    out = []
    for kind, pattern in P.OUTDOOR.items():
        for m in re.finditer(pattern, (text or "").lower()):
            out.append((kind, *plain_feet(text[max(0, m.start() - 10) : m.end() + 50])))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(91)
    parts = ["Principal Bedroom 2", "Kitchen", "kitchen/breakfast room", "Roof  Terrace", "rear garden", "Garden", "balcony", "Courtyard", "19'9 x 13'7", "16’11\" × 11’", "6.02m x 4.14m", "5 x 3", "CH 2.54m", "\n", "\n", "and", "with Study", "office", "(", "WC", "En-suite", "Staff Room", "12' x 9'6", "éÀ", "some long words in between that say nothing", "pool"]
    return ["", None, "terrace", "Terrace 20'8 x 11'5", "20'8 x 11'5 terrace", "123456789 terrace terrace"] + [rng.choice([" ", "  ", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]


def test_rooms_and_outdoor_spaces_are_those_of_plain_loops(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.rooms(F.col("t")).alias("rooms"), P.outdoor(F.col("t")).alias("outdoor"))
    for r in rows.collect():
        want = plain_rooms(texts[r["i"]])
        got = [tuple(x) for x in r["rooms"]]
        assert [x[:5] + x[6:] for x in got] == [x[:5] + x[6:] for x in want]
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=0.11)) for a, b in zip((x[5] for x in got), (x[5] for x in want)))
        assert [tuple(x) for x in r["outdoor"]] == plain_outdoor(texts[r["i"]])


def test_counts_features_lines_and_confidence(spark):
    text = "Flat 2\n10 Eaton Square, SW1W 9BB\nBedroom 1 3.0 x 4.0\nBedroom 2\nWine cellar, Sauna\nGround Floor\nTotal Area 900 sq ft"
    row = spark.createDataFrame([(text,)], "t string").select(P.room_counts(P.rooms(F.col("t"))).alias("counts"), P.special(F.col("t")).alias("special"), P.address_line(F.col("t")).alias("line"), P.confidence(P.total_area(F.col("t"))[0], P.rooms(F.col("t")), P.floors(F.col("t"))["floors"]).alias("sure")).first()
    assert row["counts"] == {"bedroom": 2, "cellar": 1} and row["special"] == ["cellar", "sauna", "wine cellar"] and row["line"] == "10 Eaton Square, SW1W 9BB"
    assert row["sure"] == round(0.4 + 0.3 * 3 / 5 + 0.2 / 3 + 0.1, 2)


def test_signs_tell_what_the_patterns_tell(spark, texts):
    """Types by their signs alone, and the confidence from the text alone, are those from whole rooms."""
    assert list(P.SIGNS) == list(P.ROOMS)
    every = [*(x for t in texts for x in (t or "").split("\n")), "bed 3", "bed x", "shower room", "en suite", "staff quarters", "staff", "media room", "TV  ROOM", "entrance hall", "wine cellar", "home office", "Laundry"]
    got = spark.createDataFrame([(x,) for x in every], "x string").select("x", P.kind(F.col("x")).alias("kind")).collect()
    assert all(r["kind"] == next((k for k, p in P.ROOMS.items() if re.search(p, r["x"].lower().strip())), None) for r in got)
    tails = ["", "\nTotal Area 900 sq ft", "\nexcluding the basement", "\nLGF", "\nFirst Floor"]
    rows = spark.createDataFrame([((t or "") + tails[i % 5] if t is not None else None,) for i, t in enumerate(texts)], "t string")
    whole = P.confidence(P.total_area(F.col("t"))[0], P.rooms(F.col("t")), P.floors(F.col("t"))["floors"])
    assert rows.where(~whole.eqNullSafe(P.plan_confidence(F.col("t")))).isEmpty()


def test_texts_without_outdoor_spaces_cost_little(spark):
    """Three long texts with one mention at the end: what stands before is read at the mention only."""
    rows = spark.range(3).select(F.concat(F.repeat(F.lit("a quiet street of tall houses "), 100_000), F.lit("Terrace 12'6 x 10'0")).alias("t")).repartition(3).cache()
    rows.count()
    began = time.time()
    assert [[tuple(x) for x in r["o"]] for r in rows.select(P.outdoor(F.col("t")).alias("o")).collect()] == [[("terrace", "12'6 x 10'0", 125)]] * 3
    assert time.time() - began < 30  # it took over a minute when each character had what stands before it read


def test_kinds_are_counted_without_making_rooms(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.room_counts(P.rooms(F.col("t"))).alias("a"), P.kind_counts(P.room_kinds(F.col("t"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and any(len(r["a"]) > 3 for r in rows)
    # A line is split into words once for all that is taken from them.
    assert str(P.rooms(F.col("t"))).count("split(") == 2


def test_facts_of_floors_are_worked_out_once(spark):
    rows = spark.createDataFrame([(t,) for t in FLOORS], "t string")
    one = rows.select("t", P.floor_facts(F.col("t")).alias("f")).select("t", "f.*").collect()
    assert one == rows.withColumns(P.floors(F.col("t"))).select("t", *P.FACTS).collect()
    # The text is mended and put in lower case once, not once a pattern.
    assert str(P.floor_facts(F.col("t"))).count("flocr") == 1
