"""Amenities, floors, agencies, types, prices and models' rows from the texts and figures of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from ..functions import wording as W
from .catalogue import Tables, query
from .rent_model import LOADED, loaded

SUMMARY = "LOWER(COALESCE(summary, ''))"
FLAGS = {n: f"CAST(regexp_matches({SUMMARY}, '{p}') AS INT)" for n, p in W.AMENITIES.items()}
OUTDOOR = f"CAST({SUMMARY} LIKE '%balcon%' OR {SUMMARY} LIKE '%terrace%' OR {SUMMARY} LIKE '%garden%' AS INT)"
#: As SQL: agency by the four names that the tables have.
AGENCY = "CASE WHEN agent_name IS NULL THEN 'Unknown' ELSE TRIM(SPLIT_PART(agent_name, ',', 1)) END"


@query(f"SELECT id, {', '.join(f'{sql} AS {n}' for n, sql in FLAGS.items())}, {OUTDOOR} AS has_outdoor_space, CASE WHEN summary LIKE '%ground floor%' THEN 0 END AS floor_level, CAST(NULL AS VARCHAR) AS furnished FROM listings")
def tx_amenity_regex(t: Tables) -> DataFrame:
    text = F.col("summary")
    return t.listings.select("id", *[c.cast("int").alias(n) for n, c in W.amenities(text).items()], W.floor_level(text).alias("floor_level"), W.furnished(text).alias("furnished"))


@query(f"SELECT id, {AGENCY} AS agency FROM listings")
def fn_agency_40(t: Tables) -> DataFrame:
    return t.listings.select("id", W.agency(F.col("agent_name")).alias("agency"))


@query("SELECT id, CASE WHEN agent_name IS NULL THEN 'Other' ELSE SPLIT_PART(agent_name, ',', 1) END AS agency FROM listings")
def fn_agency_16(t: Tables) -> DataFrame:
    return t.listings.select("id", W.competitor(F.col("agent_name")).alias("agency"))


@query("SELECT id, CASE property_type WHEN 'Apartment' THEN 'flat' WHEN 'flat' THEN 'flat' WHEN 'Studio' THEN 'studio' WHEN 'Terraced House' THEN 'other' ELSE 'flat' END AS kind FROM listings")
def fn_type_std(t: Tables) -> DataFrame:
    return t.listings.select("id", W.standard_type(F.col("property_type")).alias("kind"))


@query("SELECT id, NULLIF(SPLIT_PART(UPPER(TRIM(postcode)), ' ', 1), '') AS outcode, CASE WHEN postcode = '' THEN 'W1' END AS inferred FROM listings")
def fn_outcode(t: Tables) -> DataFrame:
    """The outward part, and for rows without postcode that of their area; here all of them lie in Mayfair."""
    inferred = W.district_of_area(F.when(F.col("postcode") == "", "Mayfair"))
    return t.listings.select("id", A.outcode(F.col("postcode")).alias("outcode"), inferred.alias("inferred"))


@query("SELECT id, CASE WHEN price_pcm < 0 THEN NULL ELSE price_pcm END AS amount, CASE WHEN id % 2 = 0 THEN 'pw' ELSE 'pcm' END AS period, size_sqft AS sqft, CAST(price_pcm AS INT) AS clean FROM listings")
def fn_price_text(t: Tables) -> DataFrame:
    """Price, period and size read back from a line of text, and the price cleaned of its signs."""
    price = F.concat(F.lit("£"), F.format_number("price_pcm", 0))
    line = F.concat(F.lit("To let at "), price, F.when(F.col("id") % 2 == 0, " per week").otherwise(" PCM"), F.coalesce(F.concat(F.lit(", "), F.format_number("size_sqft", 0), F.lit(" sq ft")), F.lit("")))
    found = W.price_in_text(line)
    return t.listings.select("id", found["amount"].alias("amount"), found["period"].alias("period"), W.sqft_in_text(line).alias("sqft"), X.clean_price(price).alias("clean"))


@query("SELECT id, CONCAT('cht_', SUBSTR(sha256(address), 1, 16)) AS hashed, REPLACE(address, ', ', ' ') AS clean FROM listings")
def fn_id_hash(t: Tables) -> DataFrame:
    return t.listings.select("id", W.id_by_hash("cht_", F.col("address")).alias("hashed"), X.clean_text(F.replace("address", F.lit(","), F.lit("  "))).alias("clean"))


@query("SELECT id, CAST(EPOCH(last_seen) - EPOCH(first_seen) AS DOUBLE) / 86400 AS days FROM listings")
def fn_days_fractional(t: Tables) -> DataFrame:
    return t.listings.select("id", ((F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86400e6).alias("days"))


@query(f"""WITH m AS {LOADED}, r AS (SELECT SPLIT_PART(postcode, ' ', 1) AS d, SUM(CAST(price_pcm AS DOUBLE)) / SUM(size_sqft) AS rate, COUNT(*) AS n FROM m GROUP BY 1), g AS (SELECT SUM(CAST(price_pcm AS DOUBLE)) / SUM(size_sqft) AS rate FROM m)
SELECT id, p AS predicted, p * 0.82 AS low, p * 1.18 AS high FROM (SELECT id, size_sqft * (LEAST(r.n / 10.0, 1) * r.rate + (1 - LEAST(r.n / 10.0, 1)) * g.rate) AS p FROM m JOIN r ON r.d = SPLIT_PART(postcode, ' ', 1) CROSS JOIN g) x""")
def ml_predict_blend(t: Tables) -> DataFrame:
    """A rent by size from the district's rate, blended with the whole market's where the district has under ten rows; 18 % to either side."""
    rows = loaded(t).withColumn("district", F.substring_index("postcode", " ", 1))
    rate = F.sum(F.col("price_pcm").cast("double")) / F.sum("size_sqft")
    per = rows.groupBy("district").agg(rate.alias("rate"), F.count(F.lit(1)).alias("n"))
    weight = F.least(F.col("n") / 10, F.lit(1.0))
    priced = rows.join(per, "district").crossJoin(F.broadcast(rows.agg(rate.alias("whole"))))  # one row
    p = F.col("size_sqft") * (weight * F.col("rate") + (1 - weight) * F.col("whole"))
    return priced.select("id", p.alias("predicted"), (p * 0.82).alias("low"), (p * 1.18).alias("high"))


def fold(id_: Column, n: int = 5) -> Column:
    """A fold for each row by arithmetic on its id, the same wherever it is computed."""
    return F.pmod(id_ * 7919 + 42, F.lit(n)).cast("int")


@query(f"""WITH m AS (SELECT *, CAST((id * 7919 + 42) % 5 AS INT) AS fold FROM {LOADED} x), f AS (SELECT fold, SUM(CAST(price_pcm AS DOUBLE)) AS price, SUM(size_sqft) AS size FROM m GROUP BY 1), s AS (SELECT SUM(price) AS price, SUM(size) AS size FROM f)
SELECT tier, COUNT(*) AS n, AVG(ABS(p - price_pcm)) AS mae, AVG(ABS(p - price_pcm) / price_pcm) * 100 AS mape FROM (SELECT price_pcm, size_sqft * (s.price - f.price) / (s.size - f.size) AS p,
CASE WHEN price_pcm < 3000 THEN '0-3k' WHEN price_pcm < 5000 THEN '3-5k' WHEN price_pcm < 10000 THEN '5-10k' WHEN price_pcm < 20000 THEN '10-20k' WHEN price_pcm < 100000 THEN '20-100k' END AS tier FROM m JOIN f USING (fold) CROSS JOIN s) y GROUP BY 1""")
def ml_tier_errors(t: Tables) -> DataFrame:
    """Errors by price tier of a rate that is learnt from the other four folds."""
    rows = loaded(t).withColumn("fold", fold(F.col("id")))
    per = rows.groupBy("fold").agg(F.sum(F.col("price_pcm").cast("double")).alias("price"), F.sum("size_sqft").alias("size"))
    whole = per.agg(F.sum("price").alias("_price"), F.sum("size").alias("_size"))  # one row
    p = F.col("size_sqft") * (F.col("_price") - F.col("price")) / (F.col("_size") - F.col("size"))
    out = rows.join(F.broadcast(per), "fold").crossJoin(F.broadcast(whole)).withColumn("error", F.abs(p - F.col("price_pcm")))  # five rows and one
    tier = F.when(F.col("price_pcm") < 100000, X.ladder(F.col("price_pcm"), ((3000, "0-3k"), (5000, "3-5k"), (10000, "5-10k"), (20000, "10-20k")), "20-100k"))
    return out.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae"), (F.avg(F.col("error") / F.col("price_pcm")) * 100).alias("mape"))
