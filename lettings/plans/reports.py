"""Named questions of the dashboards, audits and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from .catalogue import Tables, query

RATE = "CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0)"
COMPS = f"is_active = 1 AND size_sqft BETWEEN 400 AND 1600 AND bedrooms BETWEEN 1 AND 3 AND (postcode LIKE 'SW1A%' OR postcode LIKE 'SW3%' OR postcode LIKE 'SW7%') AND (price_period = 'pcm' OR price_period IS NULL OR price_period = '') AND (summary NOT ILIKE '%short let%' OR summary IS NULL) AND {RATE} BETWEEN 3 AND 30"


def comparables(t: Tables) -> DataFrame:
    rate = X.ppsf(F.col("price_pcm"), F.col("size_sqft"))
    rows = t.listings.where("is_active = 1").where(F.col("size_sqft").between(400, 1600) & F.col("bedrooms").between(1, 3))
    rows = rows.where(F.col("postcode").rlike("^(?:SW1[A-Z]|SW3|SW7|W1[A-Z])") & F.coalesce("price_period", F.lit("")).isin("pcm", ""))
    return rows.where((~F.col("summary").ilike("%short let%") | F.col("summary").isNull()) & rate.between(3, 30)).withColumn("ppsf", rate)


@query(f"""SELECT id, ROUND(ppsf, 4) AS ppsf FROM (SELECT id, price_pcm, {RATE} AS ppsf, ROW_NUMBER() OVER (PARTITION BY price_pcm, size_sqft, SPLIT_PART(postcode, ' ', 1) ORDER BY CASE WHEN source = 'rightmove' THEN 1 ELSE 0 END, id) AS rn FROM listings WHERE {COMPS}) x WHERE rn = 1 ORDER BY price_pcm, id LIMIT 200""")
def q_comparables(t: Tables) -> DataFrame:
    key = Window.partitionBy("price_pcm", "size_sqft", A.district_by_space(F.col("postcode"))).orderBy((F.col("source") == "rightmove").cast("int"), "id")
    rows = comparables(t).withColumn("rn", F.row_number().over(key)).where("rn = 1")
    return rows.orderBy("price_pcm", "id").limit(200).select("id", F.round("ppsf", 4).alias("ppsf"))


@query(f"SELECT COUNT(*) AS n, ROUND(QUANTILE_CONT({RATE}, 0.25), 6) AS p25, ROUND(QUANTILE_CONT({RATE}, 0.5), 6) AS p50, ROUND(QUANTILE_CONT({RATE}, 0.75), 6) AS p75, ROUND(AVG({RATE}), 6) AS mean FROM listings WHERE is_active = 1 AND size_sqft > 0")
def q_market_stats(t: Tables) -> DataFrame:
    rows = t.listings.where("is_active = 1 and size_sqft > 0").withColumn("r", X.ppsf(F.col("price_pcm"), F.col("size_sqft")))
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.percentile("r", p), 6).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75)), F.round(F.avg("r"), 6).alias("mean"))


@query("""SELECT listing_id, seq, previous, price_pcm, ROUND((price_pcm - previous) * 100.0 / previous, 4) AS change FROM (SELECT *, LAG(price_pcm) OVER (PARTITION BY listing_id ORDER BY seq) AS previous FROM price_history) x WHERE previous > 0 AND ABS(price_pcm - previous) >= 50 AND ABS(price_pcm - previous) * 50 >= previous""")
def st_price_change(t: Tables) -> DataFrame:
    """Changes of £50 and 2 % at least."""
    rows = t.history.withColumn("previous", F.lag("price_pcm").over(Window.partitionBy("listing_id").orderBy("seq")))
    delta = F.col("price_pcm") - F.col("previous")
    rows = rows.where((F.col("previous") > 0) & (F.abs(delta) >= 50) & (F.abs(delta) * 50 >= F.col("previous")))
    return rows.select("listing_id", "seq", "previous", "price_pcm", F.round(delta * 100 / F.col("previous"), 4).alias("change"))


@query("SELECT id, CASE WHEN is_active = 1 AND last_seen < (SELECT MAX(first_seen) FROM listings) - INTERVAL 7 DAY THEN 0 ELSE is_active END AS is_active FROM listings")
def st_mark_inactive(t: Tables) -> DataFrame:
    now = t.listings.agg(F.max("first_seen").alias("now"))
    gone = F.expr("is_active = 1 and last_seen < now - INTERVAL 7 DAYS")
    return t.listings.crossJoin(F.broadcast(now)).select("id", F.when(gone, 0).otherwise(F.col("is_active")).alias("is_active"))


@query("SELECT CASE WHEN r < 1.5 THEN '< 1.5 (extreme low)' WHEN r < 2.5 THEN '1.5-2.5 (low)' WHEN r > 50 THEN '> 50 (extreme high)' WHEN r > 25 THEN '25-50 (high)' ELSE '2.5-25 (normal)' END AS band, COUNT(*) AS n FROM (SELECT ROUND(CAST(price_pcm AS DOUBLE) / size_sqft, 2) AS r FROM listings WHERE is_active = 1 AND size_sqft > 0 AND price_pcm > 0) x GROUP BY 1")
def dq_ppsf_bands(t: Tables) -> DataFrame:
    r = F.round(X.ppsf(F.col("price_pcm"), F.col("size_sqft")), 2)
    band = F.when(r < 1.5, "< 1.5 (extreme low)").when(r < 2.5, "1.5-2.5 (low)").when(r > 50, "> 50 (extreme high)").when(r > 25, "25-50 (high)").otherwise("2.5-25 (normal)")
    return t.listings.where("is_active = 1 and size_sqft > 0 and price_pcm > 0").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, spider_name, items_scraped, error_count FROM scrape_runs ORDER BY started_at DESC, spider_name LIMIT 20")
def q_recent_runs(t: Tables) -> DataFrame:
    return t.runs.orderBy(F.desc("started_at"), "spider_name").limit(20).select("run_id", "spider_name", "items_scraped", "error_count")


@query("""SELECT CASE WHEN price_pcm < 2000 THEN '<£2k' WHEN price_pcm < 3000 THEN '£2-3k' WHEN price_pcm < 5000 THEN '£3-5k' WHEN price_pcm < 10000 THEN '£5-10k' ELSE '£10k+' END AS bucket,
COUNT(*) AS n, ROUND(AVG(days), 4) AS mean_days, ROUND(MEDIAN(days), 4) AS median_days FROM (SELECT price_pcm, DATE_DIFF('day', first_seen, last_seen) AS days FROM listings) x GROUP BY 1""")
def r_dom_bucket(t: Tables) -> DataFrame:
    days = X.days_on_market(F.col("first_seen"), F.col("last_seen"))
    return t.listings.groupBy(X.tier(F.col("price_pcm")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(days), 4).alias("mean_days"), F.round(F.median(days), 4).alias("median_days"))
