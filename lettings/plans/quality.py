"""Invariants and a snapshot of the tables, what amenities add to rents, and two samples compared by ranks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import wording as W
from .catalogue import Tables, query
from .extraction import FLAGS, OUTDOOR

#: Most violations of a rule that pass.
ALLOWED = {"suspicious sqft": 49}
#: Prices in a range of the first of two levels of prefix sums.
RANGE = 64


@query("""SELECT rule, violations, violations <= CASE WHEN rule = 'suspicious sqft' THEN 49 ELSE 0 END AS ok FROM (SELECT 'missing source' AS rule, COUNT(*) FILTER (WHERE source IS NULL) AS violations FROM listings UNION ALL SELECT 'missing property_id', COUNT(*) FILTER (WHERE property_id IS NULL) FROM listings
UNION ALL SELECT 'repeated key', COUNT(*) FROM (SELECT 1 FROM listings GROUP BY source, property_id HAVING COUNT(*) > 1) k UNION ALL SELECT 'invalid price', COUNT(*) FILTER (WHERE price_pcm <= 0 OR price_pcm > 500000) FROM listings
UNION ALL SELECT 'suspicious sqft', COUNT(*) FILTER (WHERE size_sqft > 0 AND (size_sqft < 100 OR size_sqft > 50000)) FROM listings UNION ALL SELECT 'fingerprint length', 0 UNION ALL SELECT 'seen order', COUNT(*) FILTER (WHERE first_seen > last_seen) FROM listings) r""")
def dq_integrity(t: Tables) -> DataFrame:
    """The seven invariants with the number of rows (or keys) that break each, and whether that passes."""
    rows = t.listings
    fp = A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id"))
    rules = {
        "missing source": F.col("source").isNull(), "missing property_id": F.col("property_id").isNull(), "invalid price": (F.col("price_pcm") <= 0) | (F.col("price_pcm") > 500_000),
        "suspicious sqft": (F.col("size_sqft") > 0) & ((F.col("size_sqft") < 100) | (F.col("size_sqft") > 50_000)), "fingerprint length": F.length(fp) != 16, "seen order": F.col("first_seen") > F.col("last_seen"),
    }
    counted = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "violations")
    keys = rows.groupBy("source", "property_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("repeated key").alias("rule"), F.count(F.lit(1)).alias("violations"))
    most = F.coalesce(*[F.when(F.col("rule") == n, k) for n, k in ALLOWED.items()], F.lit(0))
    return counted.unionByName(keys).select("rule", "violations", (F.col("violations") <= most).alias("ok"))


TODAY = "(SELECT MAX(CAST(first_seen AS DATE)) FROM listings)"


@query(f"""SELECT COUNT(*) AS total, (SELECT COUNT(*) FROM price_history) AS history, COUNT(DISTINCT LOWER(address) || '|' || postcode) AS fingerprints, MIN(first_seen) AS earliest, MAX(last_seen) AS latest, {TODAY} AS today,
COUNT(*) FILTER (WHERE CAST(first_seen AS DATE) = {TODAY}) AS new_today, COUNT(*) FILTER (WHERE CAST(last_seen AS DATE) = {TODAY}) AS updated_today, (SELECT COUNT(*) FROM price_history WHERE CAST(recorded_at AS DATE) = {TODAY}) AS changes_today FROM listings""")
def dq_snapshot(t: Tables) -> DataFrame:
    """The tables in one row; today is the last day that a listing was first seen. ``dq_snapshot_source`` has the sources."""
    fp = A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id"))
    today = F.broadcast(t.listings.agg(F.max(F.to_date("first_seen")).alias("today")))  # one row
    is_today = lambda c: F.to_date(c) == F.col("today")
    rows = t.listings.crossJoin(today).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(fp).alias("fingerprints"), F.min("first_seen").alias("earliest"), F.max("last_seen").alias("latest"), F.max("today").alias("today"), F.count_if(is_today("first_seen")).alias("new_today"), F.count_if(is_today("last_seen")).alias("updated_today"))
    history = t.history.crossJoin(today).agg(F.count(F.lit(1)).alias("history"), F.count_if(is_today("recorded_at")).alias("changes_today"))
    return rows.crossJoin(F.broadcast(history))


@query("SELECT source, COUNT(*) AS total, COUNT(*) FILTER (WHERE size_sqft > 0) AS with_sqft, COUNT(DISTINCT LOWER(address) || '|' || postcode) AS fingerprints, COUNT(*) FILTER (WHERE is_active = 1) AS active FROM listings GROUP BY source")
def dq_snapshot_source(t: Tables) -> DataFrame:
    fp = A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id"))
    return t.listings.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("size_sqft") > 0).alias("with_sqft"), F.count_distinct(fp).alias("fingerprints"), F.count_if(F.col("is_active") == 1).alias("active"))


ALL_FLAGS = FLAGS | {"has_outdoor_space": OUTDOOR}


@query(f"""SELECT amenity, CAST(SUM(has) AS BIGINT) AS n, ROUND(AVG(has) * 100, 2) AS share, ROUND(AVG(CASE WHEN has = 1 THEN price_pcm END), 2) AS mean_with, ROUND(AVG(CASE WHEN has = 0 THEN price_pcm END), 2) AS mean_without,
ROUND((AVG(CASE WHEN has = 1 THEN price_pcm END) / AVG(CASE WHEN has = 0 THEN price_pcm END) - 1) * 100, 4) AS premium FROM ({' UNION ALL '.join(f"SELECT '{n}' AS amenity, {sql} AS has, price_pcm FROM listings WHERE price_pcm > 0" for n, sql in ALL_FLAGS.items())}) x GROUP BY 1""")
def r_amenity_premium(t: Tables) -> DataFrame:
    """Each of the 18 amenities: how many homes have it, their mean rent, that of the others, and what it adds in percent; null where there are none of a kind."""
    flags = W.amenities(F.col("summary"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("amenity"), c.cast("int").alias("has")) for n, c in flags.items()]))
    rows = t.listings.where("price_pcm > 0").select("price_pcm", each.alias("a")).select("price_pcm", "a.*")
    mean = lambda has: F.avg(F.when(F.col("has") == has, F.col("price_pcm")))
    return rows.groupBy("amenity").agg(F.sum("has").alias("n"), F.round(F.avg("has") * 100, 2).alias("share"), F.round(mean(1), 2).alias("mean_with"), F.round(mean(0), 2).alias("mean_without"), F.round((F.try_divide(mean(1), mean(0)) - 1) * 100, 4).alias("premium"))


def mann_whitney(rows: DataFrame, value: str, first: str) -> DataFrame:
    """One row for two samples (``first`` says whether a row is of the first): sizes, U of the first, and z of the greater U, corrected for continuity and ties.

    From counts by value: values are summed in ranges, then ranges, so that no window spans all rows. Null
    values take no part; z is null for an empty sample or one value alone.
    """
    own = F.col(first)
    by = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(own).alias("a"), F.count_if(~own).alias("b"))
    by = by.withColumn("range", F.floor(F.col("v") / RANGE))
    ranges = by.groupBy("range").agg(F.sum("b").alias("all_b")).withColumn("below", F.sum("all_b").over(Window.orderBy("range")) - F.col("all_b"))
    within = by.withColumn("before", F.sum("b").over(Window.partitionBy("range").orderBy("v")) - F.col("b")).join(ranges, "range")
    ties = (F.col("a") + F.col("b")).cast("double")
    one = within.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_first"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_second"), F.sum(F.col("a") * (F.col("below") + F.col("before") + F.col("b") / 2)).alias("u"), F.sum(ties * ties * ties - ties).alias("_ties"))
    x, y = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = x + y
    spread = F.sqrt(x * y / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.col("u"), x * y - F.col("u")) - x * y / 2 - 0.5, F.nullif(spread, F.lit(0.0)))
    return one.select("n_first", "n_second", "u", z.alias("z"))


def two_sided(z: pa.Array) -> pa.Array:
    return pa.array([None if v is None else min(1.0, math.erfc(v / math.sqrt(2))) for v in z.to_pylist()], pa.float64())


def samples(t: Tables) -> DataFrame:
    return t.listings.where(F.col("source").isin("savills", "foxtons")).select("price_pcm", (F.col("source") == "savills").alias("first"))


@query("""WITH r AS (SELECT source, AVG(rn) OVER (PARTITION BY price_pcm) AS rk, COUNT(*) OVER (PARTITION BY price_pcm) AS t FROM (SELECT source, price_pcm, ROW_NUMBER() OVER (ORDER BY price_pcm) AS rn FROM listings WHERE source IN ('savills', 'foxtons')) x),
s AS (SELECT COUNT(*) FILTER (WHERE source = 'savills') AS n_first, COUNT(*) FILTER (WHERE source = 'foxtons') AS n_second, SUM(CASE WHEN source = 'savills' THEN rk ELSE 0 END) AS ranks, SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM r), u AS (SELECT *, ranks - n_first * (n_first + 1) / 2e0 AS u FROM s)
SELECT n_first, n_second, ROUND(u, 3) AS u, ROUND((GREATEST(u, n_first * n_second - u) - n_first * n_second / 2e0 - 5e-1) / SQRT(n_first * n_second / 12e0 * (n_first + n_second + 1 - ties / ((n_first + n_second) * (n_first + n_second - 1e0)))), 8) AS z FROM u""")
def agg_mannwhitney(t: Tables) -> DataFrame:
    return mann_whitney(samples(t), "price_pcm", "first").select("n_first", "n_second", F.round("u", 3).alias("u"), F.round("z", 8).alias("z"))


@query()
def agg_mannwhitney_p(t: Tables) -> DataFrame:
    """The same with the two-sided probability by the normal distribution, of one row."""
    return mann_whitney(samples(t), "price_pcm", "first").withColumn("p", F.arrow_udf(two_sided, "double")(F.col("z")))
