"""Further questions of the dashboards, duration reports, audits and model checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import listing as X
from .catalogue import Tables, query

RATE = "(CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0))"
DAYS = "DATE_DIFF('day', first_seen, last_seen)"
DISTRICT = "SPLIT_PART(postcode, ' ', 1)"
STALE_DAYS = (7, 14, 21, 30, 45, 60, 90)


def rate() -> Column:
    return X.ppsf(F.col("price_pcm"), F.col("size_sqft"))


def days() -> Column:
    return X.days_on_market(F.col("first_seen"), F.col("last_seen"))


def rows() -> Column:
    return F.count(F.lit(1))


@query("SELECT source, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(*) FILTER (WHERE size_sqft > 0) AS with_sqft FROM listings GROUP BY source")
def q_listing_stats(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(rows().alias("total"), F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(F.col("size_sqft") > 0).alias("with_sqft"))


@query(f"SELECT CAST(FLOOR({RATE}) AS BIGINT) AS bin, COUNT(*) AS n FROM listings WHERE is_active = 1 AND {RATE} >= 1 AND {RATE} < 20 GROUP BY 1")
def q_ppsf_hist(t: Tables) -> DataFrame:
    """Bins one pound wide from 1 to 20."""
    return t.listings.where((F.col("is_active") == 1) & (rate() >= 1) & (rate() < 20)).groupBy(F.floor(rate()).alias("bin")).agg(rows().alias("n"))


@query("""SELECT CASE WHEN bedrooms = 0 THEN 'Studio' WHEN bedrooms <= 4 THEN CAST(bedrooms AS VARCHAR) || ' Bed' ELSE '5+ Bed' END AS label, COUNT(*) AS n,
ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 4) AS share FROM listings WHERE is_active = 1 GROUP BY 1""")
def q_portfolio_beds(t: Tables) -> DataFrame:
    return _mix(t.listings.where("is_active = 1").groupBy(X.bedroom_label(F.col("bedrooms")).alias("label")))


@query("""SELECT label, n, share FROM (SELECT property_type AS label, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 4) AS share FROM listings WHERE is_active = 1 AND property_type IS NOT NULL GROUP BY 1) x ORDER BY n DESC, label LIMIT 6""")
def q_portfolio_type(t: Tables) -> DataFrame:
    return _mix(t.listings.where("is_active = 1 and property_type is not null").groupBy(F.col("property_type").alias("label"))).orderBy(F.desc("n"), "label").limit(6)


def _mix(groups: object) -> DataFrame:
    """Groups with their share of all rows: the window sees one row a group."""
    return groups.agg(rows().alias("n")).withColumn("share", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 4))


@query("""SELECT listing_id, seq, previous, price_pcm FROM (SELECT h.*, LAG(h.price_pcm) OVER (PARTITION BY listing_id ORDER BY seq) AS previous FROM price_history h JOIN listings ON id = listing_id WHERE source = 'savills') x
WHERE previous <> price_pcm ORDER BY recorded_at DESC, listing_id, seq LIMIT 50""")
def q_price_events(t: Tables) -> DataFrame:
    """An agency's latest price changes."""
    own = t.listings.where("source = 'savills'").select(F.col("id").alias("listing_id"))
    found = t.history.join(own, "listing_id").withColumn("previous", F.lag("price_pcm").over(Window.partitionBy("listing_id").orderBy("seq"))).where("previous <> price_pcm")
    return found.orderBy(F.desc("recorded_at"), "listing_id", "seq").limit(50).select("listing_id", "seq", "previous", "price_pcm")


@query("""SELECT source, day, CAST(SUM(fresh) AS BIGINT) AS new, CAST(SUM(let) AS BIGINT) AS lets, CAST(SUM(SUM(let)) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS lets_so_far FROM
(SELECT source, CAST(first_seen AS DATE) AS day, 1 AS fresh, 0 AS let FROM listings UNION ALL SELECT source, CAST(last_seen AS DATE), 0, 1 FROM listings WHERE is_active = 0) x GROUP BY source, day""")
def q_agency_trends(t: Tables) -> DataFrame:
    """Daily events of both kinds in one aggregate, then a running sum over days: no join with a calendar."""
    ends = F.array(F.struct(F.to_date("first_seen").alias("day"), F.lit(1).alias("fresh"), F.lit(0).alias("let")), F.when(F.col("is_active") == 0, F.struct(F.to_date("last_seen").alias("day"), F.lit(0).alias("fresh"), F.lit(1).alias("let"))))
    by = t.listings.select("source", F.explode(F.array_compact(ends)).alias("e")).groupBy("source", F.col("e.day").alias("day")).agg(F.sum("e.fresh").alias("new"), F.sum("e.let").alias("lets"))
    return by.withColumn("lets_so_far", F.sum("lets").over(Window.partitionBy("source").orderBy("day")))


@query(f"SELECT source, COUNT(*) AS n, ROUND(AVG({DAYS}), 4) AS mean, MIN({DAYS}) AS least, ROUND(QUANTILE_CONT({DAYS}, 0.25), 4) AS p25, ROUND(MEDIAN({DAYS}), 4) AS p50, ROUND(QUANTILE_CONT({DAYS}, 0.75), 4) AS p75, MAX({DAYS}) AS most FROM listings GROUP BY source")
def r_dom_source(t: Tables) -> DataFrame:
    quarters = [F.round(F.percentile(days(), p), 4).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return t.listings.groupBy("source").agg(rows().alias("n"), F.round(F.avg(days()), 4).alias("mean"), F.min(days()).alias("least"), *quarters, F.max(days()).alias("most"))


@query("SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {DAYS} >= {d}) AS d{d}" for d in STALE_DAYS) + " FROM listings")
def r_stale(t: Tables) -> DataFrame:
    return t.listings.agg(*(F.count_if(days() >= d).alias(f"d{d}") for d in STALE_DAYS))


@query("SELECT source, COUNT(*) FILTER (WHERE added_date LIKE 'Reduced%') AS reduced, COUNT(*) AS total, ROUND(COUNT(*) FILTER (WHERE added_date LIKE 'Reduced%') * 100.0 / COUNT(*), 4) AS rate FROM listings WHERE added_date IS NOT NULL GROUP BY source")
def r_agency_reductions(t: Tables) -> DataFrame:
    by = t.listings.where("added_date is not null").groupBy("source").agg(F.count_if(X.event_type(F.col("added_date")) == "reduced").alias("reduced"), rows().alias("total"))
    return by.withColumn("rate", F.round(F.col("reduced") * 100 / F.col("total"), 4))


@query(f"""SELECT source = 'chestertons' AS focus, COUNT(*) AS n, ROUND(MEDIAN(price_pcm), 4) AS price, ROUND(MEDIAN(size_sqft), 4) AS sqft, ROUND(MEDIAN({RATE}), 4) AS ppsf, ROUND(MEDIAN({DAYS}), 4) AS days, ROUND(AVG(bedrooms), 4) AS beds FROM listings GROUP BY 1""")
def r_focus_overview(t: Tables) -> DataFrame:
    middle = {"price": F.col("price_pcm"), "sqft": F.col("size_sqft"), "ppsf": rate(), "days": days()}
    return t.listings.groupBy((F.col("source") == "chestertons").alias("focus")).agg(rows().alias("n"), *(F.round(F.median(x), 4).alias(n) for n, x in middle.items()), F.round(F.avg("bedrooms"), 4).alias("beds"))


@query(f"SELECT id, ROUND({RATE}, 4) AS ppsf FROM listings WHERE {RATE} < 1.5 OR {RATE} > 50")
def dq_extremes(t: Tables) -> DataFrame:
    return t.listings.where((rate() < 1.5) | (rate() > 50)).select("id", F.round(rate(), 4).alias("ppsf"))


@query(f"SELECT id, CASE WHEN {RATE} < 1.5 OR {RATE} > 50 THEN NULL ELSE size_sqft END AS size_sqft FROM listings")
def dq_fix_sizes(t: Tables) -> DataFrame:
    extreme = F.coalesce((rate() < 1.5) | (rate() > 50), F.lit(False))
    return t.listings.select("id", F.when(~extreme, F.col("size_sqft")).alias("size_sqft"))


@query("SELECT id, CASE WHEN price_period = 'pw' THEN CAST(FLOOR(price_pcm * 52 / 12.0) AS INTEGER) ELSE price_pcm END AS price_pcm FROM listings")
def dq_fix_weekly(t: Tables) -> DataFrame:
    return t.listings.select("id", F.when(F.col("price_period") == "pw", X.monthly(F.col("price_pcm"))).otherwise(F.col("price_pcm")).alias("price_pcm"))


@query("SELECT source, COUNT(*) AS total, COUNT(*) FILTER (WHERE COALESCE(size_sqft, 0) = 0) AS sqft, COUNT(*) FILTER (WHERE bathrooms IS NULL) AS bathrooms, COUNT(*) FILTER (WHERE COALESCE(price_period, '') = '') AS period FROM listings GROUP BY source")
def dq_work_queue(t: Tables) -> DataFrame:
    """How many rows still need each field."""
    return t.listings.groupBy("source").agg(rows().alias("total"), F.count_if(F.coalesce("size_sqft", F.lit(0)) == 0).alias("sqft"), F.count_if(F.col("bathrooms").isNull()).alias("bathrooms"), F.count_if(F.coalesce("price_period", F.lit("")) == "").alias("period"))


@query("""SELECT COALESCE(a.source, b.source) AS source, a.n AS before, b.n AS after, COALESCE(b.n, 0) * 100 >= a.n * 95 AS kept FROM (SELECT source, COUNT(*) AS n FROM listings GROUP BY 1) a
FULL JOIN (SELECT source, COUNT(*) AS n FROM listings WHERE is_active = 1 GROUP BY 1) b ON a.source = b.source""")
def dq_compare(t: Tables) -> DataFrame:
    """Rows by source before and after, with a loss of 5 % at most: one pass over both."""
    by = t.listings.groupBy("source").agg(rows().alias("before"), F.nullif(F.count_if(F.col("is_active") == 1), F.lit(0)).alias("after"))
    return by.withColumn("kept", F.coalesce("after", F.lit(0)) * 100 >= F.col("before") * 95)


@query("SELECT run_id, CASE WHEN BOOL_OR(status = 'failed') THEN 'failed' ELSE 'completed' END AS status, STRING_AGG(spider_name, ',' ORDER BY spider_name) AS spiders, CAST(SUM(items_scraped) AS BIGINT) AS items FROM scrape_runs GROUP BY run_id")
def dq_audit_runs(t: Tables) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_list("spider_name")), ",")
    return t.runs.groupBy("run_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"), names.alias("spiders"), F.sum("items_scraped").alias("items"))


@query("""WITH p AS (SELECT price_pcm AS y, AVG(price_pcm) OVER (PARTITION BY bedrooms, source) AS x, AVG(price_pcm) OVER () AS m FROM listings WHERE price_pcm > 0)
SELECT COUNT(*) AS n, ROUND(AVG(ABS(y - x)), 3) AS mae, ROUND(SQRT(AVG((y - x) * (y - x))), 3) AS rmse, ROUND(1 - SUM((y - x) * (y - x)) / SUM((y - m) * (y - m)), 4) AS r2, ROUND(AVG(ABS(y - x) / y) * 100, 3) AS mape, ROUND(MEDIAN(ABS(y - x) / y) * 100, 3) AS median_ape FROM p""")
def ml_metrics(t: Tables) -> DataFrame:
    """Errors of a group-mean predictor."""
    found = t.listings.where("price_pcm > 0").select("bedrooms", "source", F.col("price_pcm").alias("y"))
    means = found.groupBy("bedrooms", "source").agg(F.avg("y").alias("x"))
    return metrics(found.join(means, ["bedrooms", "source"]), F.col("y"), F.col("x"))


def metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Mean errors, R² and percentage errors of predictions, in one aggregate."""
    off = actual - predicted
    share = F.abs(off) / actual
    return df.agg(
        rows().alias("n"), F.round(F.avg(F.abs(off)), 3).alias("mae"), F.round(F.sqrt(F.avg(off * off)), 3).alias("rmse"),
        F.round(1 - F.sum(off * off) / (F.var_pop(actual) * F.count(actual)), 4).alias("r2"), F.round(F.avg(share) * 100, 3).alias("mape"), F.round(F.median(share) * 100, 3).alias("median_ape"),
    )
