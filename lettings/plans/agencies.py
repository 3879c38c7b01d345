"""How fast homes go, by price, place and agency, and one agency against the rest of the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing as X
from ..functions import wording as W
from .catalogue import Tables, query
from .extraction import AGENCY

FOCUS, AGED = "Chestertons", (7, 14, 21, 30, 45, 60, 90)
RIVALS = ("Foxtons", "Knight Frank", "Savills", "Hamptons", "Dexters", "John D Wood")
BUCKETS = [label for _, label in X.PRICE_BUCKETS] + ["£25,000+"]
BUCKET = "CASE WHEN price_pcm IS NULL OR price_pcm <= 0 THEN 'Unknown' " + " ".join(f"WHEN price_pcm < {end} THEN '{label}'" for end, label in X.PRICE_BUCKETS) + " ELSE '£25,000+' END"
DAY = "CASE WHEN added_date LIKE '%yesterday' THEN CAST(now AS DATE) - 1 WHEN added_date IS NOT NULL THEN CAST(first_seen AS DATE) END"
#: As SQL: listings with what the reports group by.
TOLD = f"""(SELECT *, CASE WHEN added_date LIKE 'Reduced%' THEN 'reduced' WHEN added_date IS NOT NULL THEN 'added' END AS event, CAST(now AS DATE) - {DAY} AS days, {BUCKET} AS bucket, {AGENCY} AS agency,
SPLIT_PART(postcode, ' ', 1) AS district, CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0) AS ppsf FROM listings CROSS JOIN (SELECT MAX(first_seen) AS now FROM listings) n)"""


def told(t: Tables) -> DataFrame:
    """Listings with event, days on the market, price bucket, agency, district and rate."""
    rows = t.listings.crossJoin(F.broadcast(t.listings.agg(F.max("first_seen").alias("now"))))  # one row
    since = X.parse_added(F.col("added_date"), F.col("now")).cast("timestamp")
    return rows.select(
        "id", "source", "price_pcm", "size_sqft", "bedrooms", F.substring_index("postcode", " ", 1).alias("district"), X.event_type(F.col("added_date")).alias("event"), X.days_on_market(since, F.col("now").cast("timestamp")).alias("days"),
        X.price_bucket(F.col("price_pcm")).alias("bucket"), W.agency(F.col("agent_name")).alias("agency"), X.ppsf(F.col("price_pcm"), F.col("size_sqft")).alias("ppsf"),
    )


def n() -> Column:
    return F.count(F.lit(1))


def by_bucket(key: str) -> str:
    medians = ", ".join(f"MEDIAN(days) FILTER (WHERE bucket = '{label}') AS days_{i}" for i, label in enumerate(BUCKETS))
    return f"SELECT {key}, COUNT(*) AS n, {medians} FROM {TOLD} r WHERE days IS NOT NULL AND {key} <> '' GROUP BY 1 ORDER BY n DESC, {key} LIMIT 15"


def median_by_bucket(rows: DataFrame, key: str) -> DataFrame:
    """For the 15 keys with most rows, the median days of each price bucket, in one aggregate."""
    medians = [F.median(F.when(F.col("bucket") == label, F.col("days"))).alias(f"days_{i}") for i, label in enumerate(BUCKETS)]
    return rows.where(F.col("days").isNotNull() & (F.col(key) != "")).groupBy(key).agg(n().alias("n"), *medians).orderBy(F.desc("n"), key).limit(15)


@query(by_bucket("district"))
def r_heatmap(t: Tables) -> DataFrame:
    return median_by_bucket(told(t), "district")


@query(by_bucket("agency"))
def r_agency_bucket(t: Tables) -> DataFrame:
    return median_by_bucket(told(t), "agency")


SPEED = f"(SELECT agency, COUNT(*) AS n, MEDIAN(days) AS median_days, AVG(days) AS mean_days FROM {TOLD} r WHERE days IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 20)"


@query(f"SELECT * FROM (SELECT *, 'fast' AS side FROM {SPEED} f ORDER BY median_days, agency LIMIT 5) a UNION ALL SELECT * FROM (SELECT *, 'slow' AS side FROM {SPEED} s ORDER BY median_days DESC, agency LIMIT 5) b")
def r_agency_speed(t: Tables) -> DataFrame:
    """Of agencies with twenty homes or more the five fastest and the five slowest."""
    per = told(t).where("days is not null").groupBy("agency").agg(n().alias("n"), F.median("days").alias("median_days"), F.avg("days").alias("mean_days")).where("n >= 20")
    fast, slow = per.orderBy("median_days", "agency").limit(5), per.orderBy(F.desc("median_days"), "agency").limit(5)
    return fast.withColumn("side", F.lit("fast")).unionByName(slow.withColumn("side", F.lit("slow")))


@query(f"""SELECT bucket, COUNT(*) AS n, COUNT(*) FILTER (WHERE event = 'added') AS added, COUNT(*) FILTER (WHERE event = 'reduced') AS reduced, MEDIAN(price_pcm) AS median_price, MEDIAN(days) FILTER (WHERE event = 'added') AS days_added,
MEDIAN(days) FILTER (WHERE event = 'reduced') AS days_reduced, CAST(COUNT(*) FILTER (WHERE event = 'reduced') AS DOUBLE) / COUNT(*) * 100 AS reduced_pct FROM {TOLD} r WHERE event IS NOT NULL GROUP BY 1""")
def r_added_reduced(t: Tables) -> DataFrame:
    is_ = lambda e: F.col("event") == e
    return told(t).where("event is not null").groupBy("bucket").agg(
        n().alias("n"), F.count_if(is_("added")).alias("added"), F.count_if(is_("reduced")).alias("reduced"), F.median("price_pcm").alias("median_price"),
        F.median(F.when(is_("added"), F.col("days"))).alias("days_added"), F.median(F.when(is_("reduced"), F.col("days"))).alias("days_reduced"), (F.count_if(is_("reduced")) / n() * 100).alias("reduced_pct"),
    )


@query(f"SELECT bucket, COUNT(*) AS n, {', '.join(f'COUNT(*) FILTER (WHERE days >= {d}) AS aged_{d}' for d in AGED)} FROM {TOLD} r WHERE days IS NOT NULL GROUP BY 1")
def r_stale_buckets(t: Tables) -> DataFrame:
    return told(t).where("days is not null").groupBy("bucket").agg(n().alias("n"), *[F.count_if(F.col("days") >= d).alias(f"aged_{d}") for d in AGED])


@query(f"SELECT id, days, price_pcm, agency FROM {TOLD} r WHERE days IS NOT NULL ORDER BY days DESC, id LIMIT 10")
def lim_nlargest(t: Tables) -> DataFrame:
    return told(t).where("days is not null").orderBy(F.desc("days"), "id").limit(10).select("id", "days", "price_pcm", "agency")


def focus_sql(key: str) -> str:
    at, off = f"FILTER (WHERE agency = '{FOCUS}')", f"FILTER (WHERE agency <> '{FOCUS}')"
    return f"""SELECT {key}, n_focus, n_rest, n_focus * 100.0 / NULLIF(SUM(n_focus) OVER (), 0) AS pct_focus, n_rest * 100.0 / NULLIF(SUM(n_rest) OVER (), 0) AS pct_rest, price_focus, price_rest, (price_focus / price_rest - 1) * 100 AS difference_pct
FROM (SELECT {key}, COUNT(*) {at} AS n_focus, COUNT(*) {off} AS n_rest, MEDIAN(price_pcm) {at} AS price_focus, MEDIAN(price_pcm) {off} AS price_rest FROM {TOLD} r GROUP BY 1) x"""


def focus_by(rows: DataFrame, key: str) -> DataFrame:
    """Per value of a key: rows, share and median price of the agency in focus and of all others."""
    at = F.col("agency") == FOCUS
    per = rows.groupBy(key).agg(F.count_if(at).alias("n_focus"), F.count_if(~at).alias("n_rest"), F.median(F.when(at, F.col("price_pcm"))).alias("price_focus"), F.median(F.when(~at, F.col("price_pcm"))).alias("price_rest"))
    whole = rows.agg(F.nullif(F.count_if(at), F.lit(0)).alias("_focus"), F.nullif(F.count_if(~at), F.lit(0)).alias("_rest"))  # one row
    return per.crossJoin(F.broadcast(whole)).select(
        key, "n_focus", "n_rest", (F.col("n_focus") * 100 / F.col("_focus")).alias("pct_focus"), (F.col("n_rest") * 100 / F.col("_rest")).alias("pct_rest"), "price_focus", "price_rest", ((F.col("price_focus") / F.nullif("price_rest", F.lit(0)) - 1) * 100).alias("difference_pct")
    )


@query(focus_sql("bucket"))
def r_focus_price(t: Tables) -> DataFrame:
    return focus_by(told(t), "bucket")


@query(focus_sql("district"))
def r_focus_area(t: Tables) -> DataFrame:
    return focus_by(told(t), "district")


@query(focus_sql("bedrooms"))
def r_focus_beds(t: Tables) -> DataFrame:
    return focus_by(told(t), "bedrooms")


SIZES = ((500, "<500"), (750, "500-750"), (1000, "750-1000"), (1500, "1000-1500"), (2500, "1500-2500"))
SIZE = "CASE " + " ".join(f"WHEN size_sqft <= {end} THEN '{label}'" for end, label in SIZES) + " WHEN size_sqft > 2500 THEN '2500+' ELSE 'none' END"


@query(focus_sql("size").replace("FROM " + TOLD, f"FROM (SELECT *, {SIZE} AS size FROM {TOLD} q)"))
def r_focus_size(t: Tables) -> DataFrame:
    size = F.when(F.col("size_sqft") <= SIZES[0][0], SIZES[0][1])
    for end, label in SIZES[1:]:
        size = size.when(F.col("size_sqft") <= end, label)
    return focus_by(told(t).withColumn("size", size.when(F.col("size_sqft").isNotNull(), "2500+").otherwise("none")), "size")


@query(f"""SELECT CASE WHEN agency = '{FOCUS}' THEN 'focus' ELSE 'rest' END AS side, COUNT(*) AS n, {', '.join(f'QUANTILE_CONT(days, {p / 100}) AS p{p}' for p in (10, 25, 50, 75, 90))}, AVG(days) AS mean_days,
{', '.join(f'CAST(COUNT(*) FILTER (WHERE days >= {d}) AS DOUBLE) * 100 / COUNT(*) AS aged_{d}_pct' for d in (30, 60))} FROM {TOLD} r WHERE days IS NOT NULL GROUP BY 1""")
def r_focus_time(t: Tables) -> DataFrame:
    side = F.when(F.col("agency") == FOCUS, "focus").otherwise("rest")
    points = [F.percentile("days", p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    aged = [(F.count_if(F.col("days") >= d) * 100 / n()).alias(f"aged_{d}_pct") for d in (30, 60)]
    return told(t).where("days is not null").groupBy(side.alias("side")).agg(n().alias("n"), *points, F.avg("days").alias("mean_days"), *aged)


@query(f"SELECT agency, COUNT(*) AS n, MEDIAN(price_pcm) AS median_price, MEDIAN(ppsf) AS median_ppsf, MEDIAN(days) AS median_days FROM {TOLD} r WHERE agency IN ('Foxtons', 'Knight Frank', 'Savills') GROUP BY 1 HAVING COUNT(*) > 10")
def r_focus_competitors(t: Tables) -> DataFrame:
    per = told(t).where(F.col("agency").isin(*RIVALS)).groupBy("agency")
    return per.agg(n().alias("n"), F.median("price_pcm").alias("median_price"), F.median("ppsf").alias("median_ppsf"), F.median("days").alias("median_days")).where("n > 10")


@query(f"SELECT district, COUNT(*) AS n, MIN(ppsf) AS low, QUANTILE_CONT(ppsf, 0.25) AS q1, MEDIAN(ppsf) AS median, QUANTILE_CONT(ppsf, 0.75) AS q3, MAX(ppsf) AS high FROM {TOLD} r WHERE ppsf IS NOT NULL AND district <> '' GROUP BY 1 HAVING COUNT(*) >= 5 ORDER BY median DESC, district LIMIT 15")
def r_district_box(t: Tables) -> DataFrame:
    per = told(t).where("ppsf is not null and district <> ''").groupBy("district")
    figures = per.agg(n().alias("n"), F.min("ppsf").alias("low"), F.percentile("ppsf", 0.25).alias("q1"), F.median("ppsf").alias("median"), F.percentile("ppsf", 0.75).alias("q3"), F.max("ppsf").alias("high"))
    return figures.where("n >= 5").orderBy(F.desc("median"), "district").limit(15)


@query("SELECT source, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(*) FILTER (WHERE size_sqft > 0) AS with_sqft, COUNT(*) FILTER (WHERE latitude <> 0 AND longitude <> 0) AS with_place, COUNT(*) FILTER (WHERE added_date IS NOT NULL) AS with_date, MAX(last_seen) AS last_seen FROM listings GROUP BY 1")
def dq_status(t: Tables) -> DataFrame:
    return t.listings.groupBy("source").agg(
        n().alias("n"), F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(F.col("size_sqft") > 0).alias("with_sqft"), F.count_if((F.col("latitude") != 0) & (F.col("longitude") != 0)).alias("with_place"),
        F.count_if(F.col("added_date").isNotNull()).alias("with_date"), F.max("last_seen").alias("last_seen"),
    )
