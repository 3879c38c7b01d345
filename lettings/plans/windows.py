"""Window functions, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .catalogue import Tables, query

def by_listing() -> WindowSpec:
    return Window.partitionBy("listing_id").orderBy("seq")


@query("""SELECT id FROM (SELECT id, ROW_NUMBER() OVER (PARTITION BY price_pcm, size_sqft, SPLIT_PART(postcode, ' ', 1) ORDER BY CASE WHEN source = 'rightmove' THEN 1 ELSE 0 END, id) AS rn FROM listings) x WHERE rn = 1""")
def win_row_number_dedupe(t: Tables) -> DataFrame:
    key = Window.partitionBy("price_pcm", "size_sqft", F.substring_index("postcode", " ", 1)).orderBy((F.col("source") == "rightmove").cast("int"), "id")
    return t.listings.withColumn("rn", F.row_number().over(key)).where("rn = 1").select("id")


@query("SELECT listing_id, seq, LAG(price_pcm) OVER (PARTITION BY listing_id ORDER BY seq) AS previous FROM price_history")
def win_lag_price(t: Tables) -> DataFrame:
    return t.history.select("listing_id", "seq", F.lag("price_pcm").over(by_listing()).alias("previous"))


@query("SELECT DISTINCT ON (listing_id) listing_id, price_pcm FROM price_history ORDER BY listing_id, seq")
def win_distinct_on(t: Tables) -> DataFrame:
    return t.history.groupBy("listing_id").agg(F.min_by("price_pcm", "seq").alias("price_pcm"))


@query("SELECT source, n, ROW_NUMBER() OVER (ORDER BY n DESC, source) AS rank FROM (SELECT source, COUNT(*) AS n FROM listings GROUP BY 1) x")
def win_rank_global(t: Tables) -> DataFrame:
    by = t.listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source")))


@query("SELECT postcode, source, DENSE_RANK() OVER (PARTITION BY postcode ORDER BY n DESC) AS rank FROM (SELECT postcode, source, COUNT(*) AS n FROM listings GROUP BY 1, 2) x")
def win_dense_rank(t: Tables) -> DataFrame:
    by = t.listings.groupBy("postcode", "source").agg(F.count(F.lit(1)).alias("n"))
    return by.select("postcode", "source", F.dense_rank().over(Window.partitionBy("postcode").orderBy(F.desc("n"))).alias("rank"))


@query("SELECT source, day, SUM(n) OVER (PARTITION BY source ORDER BY day) AS running FROM (SELECT source, CAST(last_seen AS DATE) AS day, COUNT(*) AS n FROM listings WHERE is_active = 0 GROUP BY 1, 2) x")
def win_running_sum(t: Tables) -> DataFrame:
    by = t.listings.where("is_active = 0").groupBy("source", F.to_date("last_seen").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("source", "day", F.sum("n").over(Window.partitionBy("source").orderBy("day")).alias("running"))


@query("SELECT id, ROUND(price_pcm - MEDIAN(price_pcm) OVER (PARTITION BY postcode), 4) AS deviation FROM listings")
def win_group_median_dev(t: Tables) -> DataFrame:
    by = t.listings.groupBy("postcode").agg(F.median("price_pcm").alias("m"))
    return t.listings.join(by, "postcode").select("id", F.round(F.col("price_pcm") - F.col("m"), 4).alias("deviation"))


@query("""WITH e AS (SELECT QUANTILE_CONT(size_sqft, 0.2) AS a, QUANTILE_CONT(size_sqft, 0.4) AS b, QUANTILE_CONT(size_sqft, 0.6) AS c, QUANTILE_CONT(size_sqft, 0.8) AS d FROM listings)
SELECT id, CASE WHEN size_sqft IS NULL THEN NULL WHEN size_sqft <= a THEN 0 WHEN size_sqft <= b THEN 1 WHEN size_sqft <= c THEN 2 WHEN size_sqft <= d THEN 3 ELSE 4 END AS bin FROM listings, e""")
def win_qcut(t: Tables) -> DataFrame:
    edges = t.listings.agg(F.percentile("size_sqft", [0.2, 0.4, 0.6, 0.8]).alias("e"))
    bins = F.size(F.filter("e", lambda x: x < F.col("size_sqft")))
    return t.listings.crossJoin(F.broadcast(edges)).select("id", F.when(F.col("size_sqft").isNotNull(), bins).alias("bin"))


@query("SELECT id, price_pcm FROM listings ORDER BY price_pcm DESC, id LIMIT 10")
def lim_topk(t: Tables) -> DataFrame:
    return t.listings.orderBy(F.desc("price_pcm"), "id").select("id", "price_pcm").limit(10)


@query("SELECT postcode, id FROM (SELECT postcode, id, ROW_NUMBER() OVER (PARTITION BY postcode ORDER BY price_pcm, id) AS rn FROM listings) x WHERE rn <= 5")
def lim_top_per_group(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("postcode").orderBy("price_pcm", "id"))
    return t.listings.withColumn("rn", rn).where("rn <= 5").select("postcode", "id")


@query("SELECT DISTINCT source FROM listings")
def set_distinct(t: Tables) -> DataFrame:
    return t.listings.select("source").distinct()


@query("SELECT origin, COUNT(*) AS n FROM (SELECT 'a' AS origin FROM listings WHERE source = 'savills' UNION ALL SELECT 'b' FROM listings WHERE source <> 'savills') x GROUP BY 1")
def set_union_all(t: Tables) -> DataFrame:
    one = t.listings.where("source = 'savills'").select(F.lit("a").alias("origin"))
    return one.unionByName(t.listings.where("source <> 'savills'").select(F.lit("b").alias("origin"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(UNNEST(GENERATE_SERIES(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day")
def gen_series(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-31', interval 1 day)) AS day")
