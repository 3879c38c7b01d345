"""Floorplans of listings, as text, and what they say. The plans are made of the listings' own figures, the same way on Spark and in the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floorplan as P
from .catalogue import Tables, query

PLAN = """CONCAT(address, ', ', postcode, chr(10), 'Reception Room ', CAST(10 + id % 12 AS STRING), chr(39), CAST(id % 11 AS STRING), ' x ', CAST(9 + id % 7 AS STRING), chr(39), '6', chr(10),
CASE WHEN bedrooms > 0 THEN CONCAT('Principal Bedroom 4.', CAST(id % 10 AS STRING), 'm x 3.5m CH 2.5m', chr(10)) ELSE '' END, CASE WHEN id % 6 = 0 THEN CONCAT('with Dressing Area', chr(10), 'Garage', chr(10)) ELSE '' END,
CASE id % 5 WHEN 0 THEN 'Lower Ground Fioor' WHEN 1 THEN 'Ground Floor and First Floor' WHEN 2 THEN '14th Flocr' WHEN 3 THEN 'Area excluding the Basement' ELSE 'Mezz, 2nth Floor, Third Floor' END, chr(10),
CASE id % 3 WHEN 0 THEN CONCAT('Roof Terrace 20', chr(39), '8 x 11', chr(39), '5', chr(10)) WHEN 1 THEN CONCAT('Balcony', chr(10), 'Underfloor heating', chr(10)) ELSE '' END,
CASE WHEN size_sqft IS NULL THEN '' WHEN id % 2 = 0 THEN CONCAT('Approximate Gross Internal Area = ', CAST(size_sqft AS STRING), ' sq ft', chr(10), 'Store 40 sq ft total') ELSE CONCAT('Total = ', CAST(50 + id % 90 AS STRING), '.5 sq m / 1,', CAST(100 + size_sqft % 900 AS STRING), ' sq ft') END)"""
#: As SQL: the plan without lines of what is left out, with misreadings put right.
CLEAN = f"""(SELECT id, LOWER(ARRAY_TO_STRING(LIST_FILTER(STRING_SPLIT(regexp_replace(regexp_replace(regexp_replace({PLAN}, '\\bflocr\\b', 'floor', 'gi'), '\\bfioor\\b', 'floor', 'gi'), '\\b2nth\\b', '2nd', 'gi'), chr(10)), LAMBDA y : NOT regexp_matches(y, '{P.EXCLUDED}', 'i')), chr(10))) AS x FROM listings)"""
FLAGS = {n: f"regexp_matches(x, '{p}')" for n, p in P.floor_patterns().items()}
NTH = [f"{w.title()} Floor" for w in P.NTH]
FLAG_NAMES = {"has_basement": ["Basement"], "has_lower_ground": ["Lower Ground"], "has_ground": ["Ground Floor"], "has_mezzanine": ["Mezzanine"], "has_first_floor": NTH[:1], "has_second_floor": NTH[1:2], "has_third_floor": NTH[2:3], "has_fourth_plus": [*NTH[3:7], "Penthouse"], "has_roof_terrace": ["Roof Terrace", "Roof"]}
COUNT = " + ".join(f"CAST({FLAGS[n]} AS INT)" for n in (*P.LOW_FLOORS, *NTH))
#: Names of floors in order of the alphabet, as SQL.
SHOWN = "CONCAT_WS(', ', " + ", ".join(f"CASE WHEN {FLAGS[n]} THEN '{n}' END" for n in sorted(FLAGS)) + ")"


def plans(t: Tables) -> DataFrame:
    return t.listings.select("id", F.expr(PLAN).alias("plan"))


@query(f"""SELECT id, {SHOWN} AS floors, {', '.join(f"CAST({' OR '.join(FLAGS[n] for n in names)} AS INT) AS {flag}" for flag, names in FLAG_NAMES.items())}, {COUNT} AS floor_count, CASE WHEN {COUNT} <= 1 THEN 'single_floor' WHEN {COUNT} = 2 THEN 'duplex' WHEN {COUNT} = 3 THEN 'triplex' ELSE 'multi_floor' END AS property_levels FROM {CLEAN} c""")
def tx_floors(t: Tables) -> DataFrame:
    """Floors named on the plan, their flags, how many they are and what kind of home that makes."""
    found = plans(t).select("id", P.floor_facts(F.col("plan")).alias("found"))
    return found.select("id", F.array_join("found.floors", ", ").alias("floors"), *[f"found.{n}" for n in P.FACTS if n != "floors"])


@query(f"""SELECT id, CAST(CASE WHEN size_sqft IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN CASE WHEN size_sqft > 100 THEN size_sqft END ELSE 1100 + size_sqft % 900 END END AS BIGINT) AS sqft, CAST(CASE WHEN size_sqft IS NOT NULL AND id % 2 = 1 THEN 50 + id % 90 END AS BIGINT) AS sqm FROM listings""")
def tx_total_area(t: Tables) -> DataFrame:
    sqft, sqm = P.total_area(F.col("plan"))
    return plans(t).select("id", sqft.alias("sqft"), sqm.alias("sqm"))


@query(f"""SELECT id, type, COUNT(*) AS n FROM (SELECT id, CASE {' '.join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in P.ROOMS.items())} END AS type FROM (SELECT id, LOWER(UNNEST(STRING_SPLIT({PLAN}, chr(10)))) AS line FROM listings) l) r WHERE type IS NOT NULL GROUP BY 1, 2""")
def tx_room_counts(t: Tables) -> DataFrame:
    return plans(t).select("id", F.explode(P.kind_counts(P.room_kinds(F.col("plan")))).alias("type", "n"))


@query()
def tx_rooms(t: Tables) -> DataFrame:
    """Rooms with their names and sizes, one a row."""
    return plans(t).select("id", F.posexplode(P.rooms(F.col("plan"))).alias("nth", "room")).select("id", "nth", "room.*")


@query()
def tx_outdoor(t: Tables) -> DataFrame:
    """Mentions of outdoor spaces in all documents and plans, with sizes near them."""
    texts = t.documents.select(F.lit("document").alias("of"), F.col("doc_id").alias("id"), "text").unionByName(plans(t).select(F.lit("plan").alias("of"), "id", F.col("plan").alias("text")))
    return texts.select("of", "id", F.posexplode(P.outdoor(F.col("text"))).alias("nth", "space")).select("of", "id", "nth", "space.*")


@query(f"""SELECT id, CONCAT_WS(', ', {', '.join(f"CASE WHEN CONTAINS(LOWER({PLAN}), '{f}') THEN '{f}' END" for f in sorted(P.FEATURES))}) AS features FROM listings""")
def tx_special(t: Tables) -> DataFrame:
    return plans(t).select("id", F.array_join(P.special(F.col("plan")), ", ").alias("features"))


@query(rf"""SELECT id, TRIM(LIST_FILTER(LIST_SLICE(STRING_SPLIT({PLAN}, chr(10)), 1, 5), LAMBDA y : regexp_matches(y, '[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s*\d[A-Z]{{2}}') OR regexp_matches(y, 'Street|Road|Avenue|Lane|Gardens|Square|Place|Terrace', 'i'))[1]) AS line FROM listings""")
def tx_address_line(t: Tables) -> DataFrame:
    return plans(t).select("id", P.address_line(F.col("plan")).alias("line"))


@query()
def tx_confidence(t: Tables) -> DataFrame:
    """How much was read of each plan."""
    return plans(t).select("id", P.plan_confidence(F.col("plan")).alias("confidence"))
