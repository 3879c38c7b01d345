"""Aggregations over listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from .catalogue import Tables, query

BUCKET = "CASE WHEN price_pcm < 2000 THEN '<£2k' WHEN price_pcm < 3000 THEN '£2-3k' WHEN price_pcm < 5000 THEN '£3-5k' WHEN price_pcm < 10000 THEN '£5-10k' ELSE '£10k+' END"
RATE = "CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0)"


@query("SELECT source, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(*) FILTER (WHERE size_sqft > 0) AS with_sqft FROM listings GROUP BY source")
def agg_count_sum_case(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(F.col("size_sqft") > 0).alias("with_sqft"))


@query(f"SELECT source, ROUND(AVG(price_pcm) FILTER (WHERE is_active = 1), 4) AS avg_active, ROUND(AVG({RATE}) FILTER (WHERE size_sqft > 0), 4) AS avg_ppsf FROM listings GROUP BY source")
def agg_filter(t: Tables) -> DataFrame:
    rate = X.ppsf(F.col("price_pcm"), F.col("size_sqft"))
    return t.listings.groupBy("source").agg(F.round(F.avg(F.when(F.col("is_active") == 1, F.col("price_pcm"))), 4).alias("avg_active"), F.round(F.avg(F.when(F.col("size_sqft") > 0, rate)), 4).alias("avg_ppsf"))


@query("SELECT source, COUNT(DISTINCT postcode) AS postcodes, COUNT(DISTINCT CASE WHEN is_active = 1 THEN bedrooms END) AS active_beds FROM listings GROUP BY source")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(F.count_distinct("postcode").alias("postcodes"), F.count_distinct(F.when(F.col("is_active") == 1, F.col("bedrooms"))).alias("active_beds"))


@query(f"SELECT source, ROUND(QUANTILE_CONT({RATE}, 0.25), 6) AS p25, ROUND(QUANTILE_CONT({RATE}, 0.5), 6) AS p50, ROUND(QUANTILE_CONT({RATE}, 0.75), 6) AS p75 FROM listings GROUP BY source")
def agg_percentile(t: Tables) -> DataFrame:
    rate = X.ppsf(F.col("price_pcm"), F.col("size_sqft"))
    return t.listings.groupBy("source").agg(*(F.round(F.percentile(rate, p), 6).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))))


@query("SELECT source, ROUND(QUANTILE_CONT(price_pcm, 0.5) FILTER (WHERE is_active = 1), 6) AS median_active FROM listings GROUP BY source")
def agg_percentile_filter(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(F.round(F.percentile(F.when(F.col("is_active") == 1, F.col("price_pcm")), 0.5), 6).alias("median_active"))


@query("SELECT source, COUNT(price_pcm) AS n, ROUND(AVG(price_pcm), 4) AS mean, ROUND(STDDEV_SAMP(price_pcm), 4) AS std, MIN(price_pcm) AS least, MAX(price_pcm) AS most, ROUND(MEDIAN(price_pcm), 4) AS median FROM listings GROUP BY source")
def agg_multi(t: Tables) -> DataFrame:
    p = F.col("price_pcm")
    return t.listings.groupBy("source").agg(F.count(p).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.median(p), 4).alias("median"))


@query("SELECT bedrooms, STRING_AGG(DISTINCT source, ',' ORDER BY source) AS sources FROM listings GROUP BY bedrooms")
def agg_group_concat(t: Tables) -> DataFrame:
    return t.listings.groupBy("bedrooms").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("SELECT postcode, bedrooms, COUNT(*) AS n FROM listings GROUP BY postcode, bedrooms HAVING COUNT(*) >= 30")
def agg_having(t: Tables) -> DataFrame:
    return t.listings.groupBy("postcode", "bedrooms").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")


@query(f"SELECT CAST(FLOOR({RATE}) AS INT) AS bucket, COUNT(*) AS n FROM listings WHERE {RATE} BETWEEN 1 AND 20 GROUP BY 1")
def agg_histogram(t: Tables) -> DataFrame:
    rate = X.ppsf(F.col("price_pcm"), F.col("size_sqft"))
    return t.listings.where(rate.between(1, 20)).groupBy(F.floor(rate).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, CASE WHEN SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 0 THEN 'failed' ELSE 'completed' END AS status, CAST(SUM(items_scraped) AS BIGINT) AS items FROM scrape_runs GROUP BY run_id")
def agg_bool_any_fail(t: Tables) -> DataFrame:
    return t.runs.groupBy("run_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"), F.sum("items_scraped").alias("items"))


@query("SELECT source, ROUND(AVG(CASE WHEN added_date LIKE 'Reduced%' THEN 1.0 ELSE 0.0 END) * 100, 4) AS reduced_rate FROM listings GROUP BY source")
def agg_rate(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(F.round(F.avg(F.coalesce(F.col("added_date").startswith("Reduced"), F.lit(False)).cast("int")) * 100, 4).alias("reduced_rate"))


@query("SELECT source, " + ", ".join(f"ROUND(QUANTILE_CONT(price_pcm, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + " FROM listings GROUP BY source")
def agg_percentile_list(t: Tables) -> DataFrame:
    rows = t.listings.groupBy("source").agg(F.percentile("price_pcm", [p / 100 for p in (10, 25, 50, 75, 90, 95)]).alias("p"))
    return rows.select("source", *(F.round(F.col("p")[i], 6).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90, 95))))


@query("SELECT ROUND(AVG(CASE WHEN price_pcm < 9000 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percentile FROM listings")
def agg_percentile_rank(t: Tables) -> DataFrame:
    return t.listings.agg(F.round(F.avg((F.col("price_pcm") < 9000).cast("int")) * 100, 6).alias("percentile"))


@query("SELECT source, " + ", ".join(f"ROUND(MEDIAN(CASE WHEN bedrooms = {b} THEN price_pcm END), 4) AS beds_{b}" for b in range(6)) + " FROM listings GROUP BY source")
def agg_pivot(t: Tables) -> DataFrame:
    rows = t.listings.groupBy("source").pivot("bedrooms", list(range(6))).agg(F.round(F.median("price_pcm"), 4))
    return rows.select("source", *(F.col(f"`{b}`").alias(f"beds_{b}") for b in range(6)))


@query("SELECT postcode, COUNT(*) AS n FROM listings GROUP BY postcode ORDER BY n DESC, postcode LIMIT 3")
def agg_value_counts_topn(t: Tables) -> DataFrame:
    return t.listings.groupBy("postcode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "postcode").limit(3)


@query("SELECT id, ROUND(CAST(COUNT(*) OVER (PARTITION BY postcode) AS DOUBLE) / COUNT(*) OVER (), 8) AS freq FROM listings")
def agg_freq_encode(t: Tables) -> DataFrame:
    counts = t.listings.groupBy("postcode").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    freq = counts.crossJoin(F.broadcast(total)).select("postcode", F.round(F.col("n") / F.col("total"), 8).alias("freq"))
    return t.listings.join(freq, "postcode").select("id", "freq")


@query("""WITH g AS (SELECT LN(1 + AVG(price_pcm)) AS g FROM listings) SELECT postcode, ROUND((LN(1 + AVG(price_pcm)) * COUNT(*) + MAX(g) * 15) / (COUNT(*) + 15), 8) AS encoded FROM listings, g GROUP BY postcode""")
def agg_smoothed_target(t: Tables) -> DataFrame:
    every = t.listings.agg(F.log1p(F.avg("price_pcm")).alias("g"))
    by = t.listings.groupBy("postcode").agg(F.log1p(F.avg("price_pcm")).alias("m"), F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(every)).select("postcode", F.round((F.col("m") * F.col("n") + F.col("g") * 15) / (F.col("n") + 15), 8).alias("encoded"))


@query("SELECT ARG_MIN(source, m) AS cheapest, ARG_MAX(source, m) AS dearest FROM (SELECT source, AVG(price_pcm) AS m FROM listings GROUP BY source) x")
def agg_argmax_label(t: Tables) -> DataFrame:
    by = t.listings.groupBy("source").agg(F.avg("price_pcm").alias("m"))
    return by.agg(F.min_by("source", "m").alias("cheapest"), F.max_by("source", "m").alias("dearest"))


@query("SELECT bedrooms, " + ", ".join(f"COUNT(*) FILTER (WHERE DATE_DIFF('day', first_seen, last_seen) >= {d}) AS over_{d}" for d in (7, 14, 21, 30)) + " FROM listings GROUP BY bedrooms")
def agg_threshold_counts(t: Tables) -> DataFrame:
    days = X.days_on_market(F.col("first_seen"), F.col("last_seen"))
    return t.listings.groupBy("bedrooms").agg(*(F.count_if(days >= d).alias(f"over_{d}") for d in (7, 14, 21, 30)))


@query(f"SELECT SPLIT_PART(postcode, ' ', 1) AS district, COUNT(*) AS n, ROUND(MEDIAN({RATE}), 6) AS median_ppsf FROM listings WHERE size_sqft > 0 AND is_active = 1 GROUP BY 1 HAVING COUNT(*) >= 5 ORDER BY 3 DESC, 1 LIMIT 15")
def q_ppsf_district(t: Tables) -> DataFrame:
    rows = t.listings.where("size_sqft > 0 and is_active = 1").groupBy(A.district_by_space(F.col("postcode")).alias("district"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.median(X.ppsf(F.col("price_pcm"), F.col("size_sqft"))), 6).alias("median_ppsf"))
    return rows.where("n >= 5").orderBy(F.desc("median_ppsf"), "district").limit(15)


@query(f"SELECT source, {BUCKET} AS segment, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY source), 4) AS share FROM listings WHERE is_active = 1 GROUP BY 1, 2")
def q_portfolio_tier(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.listings.where("is_active = 1").groupBy("source", X.tier(F.col("price_pcm")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("source")), 4))
