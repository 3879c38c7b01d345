"""Joins of listings with their price history and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching as M
from .catalogue import Tables, query

# Fixed value: letters of a place's beginning by which addresses that hold it are looked for.
LETTERS = 8


def holding(addresses: DataFrame) -> DataFrame:
    """``at_a``, ``at_b``: numbers of addresses of one postcode of which one holds the other's place, in both orders, each with itself too.

    A place's first letters stand somewhere in an address that holds it, so those meet by them; only shorter places meet their whole postcode.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("address") - LETTERS + 1), lambda i: F.substring(F.col("address"), i, F.lit(LETTERS))))
    holders = addresses.select(F.col("at").alias("at_a"), F.col("postcode").alias("postcode_a"), F.col("address").alias("address_a"))
    held = addresses.select(F.col("at").alias("at_b"), F.col("postcode").alias("postcode_b"), F.col("place").alias("place_b"))
    long = addresses.where(F.length("address") >= LETTERS).select(F.col("at").alias("at_a"), F.col("postcode").alias("postcode_a"), F.col("address").alias("address_a"), F.explode(pieces).alias("piece"))
    same, short = F.col("postcode_a") == F.col("postcode_b"), F.length("place_b") < LETTERS
    met = long.join(held.where(~short), same & (F.col("piece") == F.substring("place_b", 1, LETTERS))).drop("piece").unionByName(holders.join(held.where(short), same))
    one = met.where(F.contains("address_a", F.col("place_b"))).select("at_a", "at_b")
    return one.unionByName(one.select(F.col("at_b").alias("at_a"), F.col("at_a").alias("at_b"))).distinct()


@query("SELECT source, COUNT(*) AS events, COUNT(DISTINCT id) AS listings FROM price_history JOIN listings ON id = listing_id GROUP BY source")
def jn_inner_hist(t: Tables) -> DataFrame:
    rows = t.history.join(t.listings, F.col("id") == F.col("listing_id"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("listings"))


@query("""SELECT a.source, a.n, COALESCE(b.n, 0) AS weekly, COALESCE(c.n, 0) AS studios FROM (SELECT source, COUNT(*) AS n FROM listings GROUP BY 1) a
LEFT JOIN (SELECT source, COUNT(*) AS n FROM listings WHERE price_period = 'pw' GROUP BY 1) b ON a.source = b.source LEFT JOIN (SELECT source, COUNT(*) AS n FROM listings WHERE bedrooms = 0 GROUP BY 1) c ON a.source = c.source""")
def jn_left_many(t: Tables) -> DataFrame:
    """Three counts by source in one pass instead of two joins."""
    one = F.count_if(F.coalesce(F.col("price_period") == "pw", F.lit(False)))
    return t.listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"), one.alias("weekly"), F.count_if(F.col("bedrooms") == 0).alias("studios"))


@query("""WITH d AS (SELECT CAST(UNNEST(GENERATE_SERIES(TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, s.source, COUNT(id) AS inventory FROM d CROSS JOIN (SELECT DISTINCT source FROM listings) s LEFT JOIN listings l ON l.source = s.source AND day >= CAST(first_seen AS DATE) AND day <= CAST(last_seen AS DATE) GROUP BY 1, 2""")
def jn_interval(t: Tables) -> DataFrame:
    """Inventory per day and source from starts and ends: rows grow with days, not with days times listings."""
    span = "to_date('1998-01-01')", "to_date('1998-01-31')"
    days = t.spark.sql(f"SELECT explode(sequence({span[0]}, {span[1]})) AS day")
    own = t.listings.where(f"to_date(last_seen) >= {span[0]} and to_date(first_seen) <= {span[1]}")
    moves = own.select("source", F.explode(F.array(F.struct(F.expr(f"greatest(to_date(first_seen), {span[0]})").alias("day"), F.lit(1).alias("by")), F.struct(F.expr("date_add(to_date(last_seen), 1)").alias("day"), F.lit(-1).alias("by")))).alias("m"))
    moves = moves.groupBy("source", "m.day").agg(F.sum("m.by").alias("by"))
    grid = t.listings.select("source").distinct().crossJoin(F.broadcast(days))
    every = grid.join(moves, ["source", "day"], "left")
    return every.select("day", "source", F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy("source").orderBy("day")).alias("inventory"))


@query("""SELECT DISTINCT p.listing_id FROM price_history p WHERE EXISTS (SELECT 1 FROM price_history q WHERE q.listing_id = p.listing_id AND q.seq < p.seq AND q.price_pcm > p.price_pcm)""")
def jn_semi_exists(t: Tables) -> DataFrame:
    """A row with an earlier, higher price, by the running maximum before it."""
    before = Window.partitionBy("listing_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return t.history.withColumn("most", F.max("price_pcm").over(before)).where("most > price_pcm").select("listing_id").distinct()


@query("SELECT id FROM listings WHERE NOT EXISTS (SELECT 1 FROM price_history WHERE listing_id = id)")
def jn_anti(t: Tables) -> DataFrame:
    return t.listings.join(t.history, F.col("id") == F.col("listing_id"), "left_anti").select("id")


@query("SELECT id FROM listings WHERE (postcode, bedrooms, price_pcm) IN (SELECT postcode, bedrooms, price_pcm FROM listings GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)")
def jn_semi_in_group(t: Tables) -> DataFrame:
    keys = t.listings.groupBy("postcode", "bedrooms", "price_pcm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.listings.join(keys, ["postcode", "bedrooms", "price_pcm"], "left_semi").select("id")


@query("SELECT id, (SELECT price_pcm FROM price_history WHERE listing_id = id ORDER BY seq DESC LIMIT 1) AS last_price FROM listings")
def jn_scalar_lookup_top1(t: Tables) -> DataFrame:
    last = t.history.groupBy("listing_id").agg(F.max_by("price_pcm", "seq").alias("last_price"))
    return t.listings.join(last, F.col("id") == F.col("listing_id"), "left").select("id", "last_price")


@query("SELECT COALESCE(a.bedrooms, b.bedrooms) AS bedrooms, a.n AS savills, b.n AS foxtons FROM (SELECT bedrooms, COUNT(*) AS n FROM listings WHERE source = 'savills' AND bedrooms < 4 GROUP BY 1) a FULL JOIN (SELECT bedrooms, COUNT(*) AS n FROM listings WHERE source = 'foxtons' AND bedrooms > 1 GROUP BY 1) b ON a.bedrooms = b.bedrooms")
def jn_outer(t: Tables) -> DataFrame:
    one = t.listings.where("source = 'savills' and bedrooms < 4").groupBy("bedrooms").agg(F.count(F.lit(1)).alias("savills"))
    two = t.listings.where("source = 'foxtons' and bedrooms > 1").groupBy("bedrooms").agg(F.count(F.lit(1)).alias("foxtons"))
    return one.join(two, "bedrooms", "full_outer")


@query("""SELECT a.id AS id_a, b.id AS id_b FROM listings a JOIN listings b ON a.postcode = b.postcode AND a.bedrooms = b.bedrooms AND a.id < b.id AND a.source <> b.source
AND ABS(a.price_pcm - b.price_pcm) * 50 <= GREATEST(a.price_pcm, b.price_pcm) AND (CONTAINS(a.address, SPLIT_PART(b.address, ', ', -1)) OR CONTAINS(b.address, SPLIT_PART(a.address, ', ', -1))) WHERE a.postcode <> ''""")
def jn_theta_band(t: Tables) -> DataFrame:
    """Addresses of which one holds the other's place are found first, each once; then rows meet by address, bedrooms and band of the logarithm of prices."""
    band = F.floor(F.log(F.col("price_pcm").cast("double")) / F.log(F.lit(50 / 49)) + 1e-9)
    rows = t.listings.where("postcode <> '' and price_pcm > 0").select("id", "source", "postcode", "bedrooms", "price_pcm", "address", band.alias("band"))
    places = rows.select("postcode", "address").distinct().withColumn("place", F.element_at(F.split("address", ", "), -1))
    places = M.lasting(places.withColumn("at", F.monotonically_increasing_id()))
    numbered = rows.join(places.drop("place"), ["postcode", "address"])
    a, b = M.sides(numbered, "id", "source", "bedrooms", "price_pcm", "band", "at")
    b = b.withColumn("band_b", M.around(F.col("band_b"))).withColumnRenamed("at_b", "_at")
    on = (F.col("at_b") == F.col("_at")) & (F.col("bedrooms_a") == F.col("bedrooms_b")) & (F.col("band_a") == F.col("band_b"))
    near = (F.col("id_a") < F.col("id_b")) & (F.col("source_a") != F.col("source_b")) & (F.abs(F.col("price_pcm_a") - F.col("price_pcm_b")) * 50 <= F.greatest("price_pcm_a", "price_pcm_b"))
    return a.join(holding(places), "at_a").join(b.hint("shuffle_hash"), on).where(near).select("id_a", "id_b")
