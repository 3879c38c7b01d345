"""The dashboard's figures of agencies and runs in full, and scored comparables. The present is the last day that a listing was first seen, and for runs their last start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from .catalogue import Tables, query

# Shares of lets that last and of rents that are got, by month the season's factor, and the commission.
LASTING, GOT, COMMISSION = 0.9, 0.95, 0.1
SEASON = {1: 0.70, 2: 0.75, 3: 0.90, 4: 0.95, 5: 1.10, 6: 1.15, 7: 1.20, 8: 1.30, 9: 1.35, 10: 1.00, 11: 0.85, 12: 0.70}
WINDOW_DAYS, DAILY_DAYS = 30, 14

RATE = "(CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0))"
NOW = "(SELECT MAX(first_seen) FROM listings)"
RECENT = f"{NOW} - INTERVAL {WINDOW_DAYS} DAY"
SEASON_SQL = f"(SELECT CAST(CASE EXTRACT(MONTH FROM MAX(first_seen)) {' '.join(f'WHEN {m} THEN {v}' for m, v in SEASON.items())} END AS DOUBLE) FROM listings)"
KEPT = f"({RATE} BETWEEN 3 AND 30 OR size_sqft IS NULL OR size_sqft = 0)"
STEPS = "(SELECT listing_id, seq, recorded_at, price_pcm AS cp, LAG(price_pcm) OVER (PARTITION BY listing_id ORDER BY seq) AS previous FROM price_history)"
NAME = "UPPER(SUBSTR(source, 1, 1)) || SUBSTR(source, 2)"
GMV = f"inactive * 9e-1 * COALESCE(avg_price, 0) * 95e-2 * 12 / {SEASON_SQL} * (365e0 / 30)"


def active() -> Column:
    return F.col("is_active") == 1


def present(t: Tables) -> DataFrame:
    """One row: the present."""
    return t.listings.agg(F.max("first_seen").alias("now"))


def recent(c: str, days: int = WINDOW_DAYS) -> Column:
    return F.col(c) >= F.col("now") - F.make_dt_interval(F.lit(days))


def steps(t: Tables) -> DataFrame:
    """Prices with the one before each."""
    return t.history.select("listing_id", "seq", "recorded_at", F.col("price_pcm").alias("cp"), F.lag("price_pcm").over(Window.partitionBy("listing_id").orderBy("seq")).alias("previous"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100, whole), digits), F.lit(0.0))


def figures(t: Tables) -> DataFrame:
    """Agencies' figures over sound or unsized listings, without the aggregator, with the yearly worth of lets ``gmv``, unrounded."""
    rows = t.listings.where("source <> 'rightmove'").where(X.ppsf(F.col("price_pcm"), F.col("size_sqft")).between(3, 30) | (F.coalesce("size_sqft", F.lit(0)) == 0))
    rate = F.when(active() & (F.col("size_sqft") > 0), F.col("price_pcm") / F.col("size_sqft"))
    days = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86400e6
    price = F.when(active(), F.col("price_pcm"))
    by = rows.groupBy("source").agg(
        F.count_if(active()).alias("active"), F.count_if(~active()).alias("inactive"), F.count(F.lit(1)).alias("n"), F.round(F.avg(price)).alias("avg_price"), F.round(F.median(price)).alias("median_price"), F.round(F.avg(rate), 2).alias("avg_ppsf"),
        F.round(F.median(rate), 2).alias("median_ppsf"), F.round(F.avg(F.when(~active(), days)), 1).alias("mean_days"), F.sum(price.cast("long") * 12).alias("portfolio"), percent(F.count_if(F.col("size_sqft") > 0), F.count(F.lit(1))).alias("coverage"),
    )
    season = F.element_at(F.create_map(*[F.lit(x) for pair in SEASON.items() for x in pair]), F.month("now"))
    by = by.crossJoin(F.broadcast(present(t).select(season.alias("season"))))  # one row
    gmv = F.col("inactive") * LASTING * F.coalesce("avg_price", F.lit(0.0)) * GOT * 12 / F.col("season") * (365.0 / 30)
    return by.withColumns({"display_name": F.initcap(F.replace("source", F.lit("_"), F.lit(" "))), "let_rate": percent(F.col("inactive"), F.col("n")), "gmv": gmv})


BASE = f"""(SELECT source, {NAME} AS display_name, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(*) FILTER (WHERE is_active = 0) AS inactive, ROUND(COUNT(*) FILTER (WHERE is_active = 0) * 100.0 / COUNT(*), 1) AS let_rate, ROUND(AVG(price_pcm) FILTER (WHERE is_active = 1)) AS avg_price, ROUND(MEDIAN(price_pcm) FILTER (WHERE is_active = 1)) AS median_price,
ROUND(AVG({RATE}) FILTER (WHERE is_active = 1 AND size_sqft > 0), 2) AS avg_ppsf, ROUND(MEDIAN({RATE}) FILTER (WHERE is_active = 1 AND size_sqft > 0), 2) AS median_ppsf, ROUND(AVG(CAST(EPOCH(last_seen) - EPOCH(first_seen) AS DOUBLE) / 86400) FILTER (WHERE is_active = 0), 1) AS mean_days,
CAST(SUM(CAST(price_pcm AS BIGINT) * 12) FILTER (WHERE is_active = 1) AS BIGINT) AS portfolio, ROUND(COUNT(*) FILTER (WHERE size_sqft > 0) * 100.0 / COUNT(*), 1) AS coverage FROM listings WHERE source <> 'rightmove' AND {KEPT} GROUP BY source)"""


@query(f"""SELECT source, display_name, active, inactive, let_rate, CAST(COALESCE(avg_price, 0) AS BIGINT) AS avg_price, COALESCE(avg_ppsf, 0) AS avg_ppsf, COALESCE(portfolio, 0) AS portfolio, gmv, CAST(ROUND(gmv * 1e-1) AS BIGINT) AS commission, ROW_NUMBER() OVER (ORDER BY gmv DESC, source) AS rank FROM (SELECT *, CAST(ROUND({GMV}) AS BIGINT) AS gmv FROM {BASE} b WHERE active > 0) g""")
def q_agency_list(t: Tables) -> DataFrame:
    """Agencies with listings by the estimated worth of a year's lets (ties by name)."""
    rows = figures(t).where("active > 0").withColumn("gmv", F.round("gmv").cast("long"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gmv"), "source"))  # a row an agency
    return rows.select("source", "display_name", "active", "inactive", "let_rate", F.coalesce(F.col("avg_price"), F.lit(0)).cast("long").alias("avg_price"), F.coalesce("avg_ppsf", F.lit(0.0)).alias("avg_ppsf"), F.coalesce("portfolio", F.lit(0)).alias("portfolio"), "gmv", F.round(F.col("gmv") * COMMISSION).cast("long").alias("commission"), rank.alias("rank"))


@query(f"""SELECT source, display_name, active, inactive, let_rate, CAST(COALESCE(avg_price, 0) AS BIGINT) AS avg_price, CAST(COALESCE(median_price, 0) AS BIGINT) AS median_price, COALESCE(avg_ppsf, 0) AS avg_ppsf, COALESCE(median_ppsf, 0) AS median_ppsf, COALESCE(mean_days, 0) AS mean_days, COALESCE(cuts, 0) AS reductions,
CASE WHEN active > 0 THEN ROUND(COALESCE(cuts, 0) * 100.0 / active, 1) ELSE 0 END AS reduction_rate, coverage, COALESCE(portfolio, 0) AS portfolio, CAST(ROUND({GMV}) AS BIGINT) AS gmv, CAST(ROUND({GMV} * 1e-1) AS BIGINT) AS commission,
CAST(LEAST(100, GREATEST(0, ROUND(LEAST(50, inactive) * 5e-1 + (100 - LEAST(100, COALESCE(cuts, 0))) * 2e-1 + coverage * 15e-2 + LEAST(100, active / 5e0) * 15e-2))) AS INT) AS health
FROM {BASE} b LEFT JOIN (SELECT source, COUNT(DISTINCT id) AS cuts FROM listings JOIN (SELECT *, MAX(price_pcm) OVER (PARTITION BY listing_id ORDER BY recorded_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS top FROM price_history) h ON h.listing_id = id AND h.recorded_at >= {RECENT} AND h.top > h.price_pcm GROUP BY source) c USING (source)""")
def q_agency_detail(t: Tables) -> DataFrame:
    """Everything of an agency: a listing is reduced if a price of the last 30 days lies below any earlier one."""
    by = t.history.groupBy("listing_id", "recorded_at").agg(F.min("price_pcm").alias("least"), F.max("price_pcm").alias("most"))
    top = F.max("most").over(Window.partitionBy("listing_id").orderBy("recorded_at").rowsBetween(Window.unboundedPreceding, -1))
    cut = by.withColumn("top", top).crossJoin(F.broadcast(present(t))).where(recent("recorded_at") & (F.col("top") > F.col("least"))).select("listing_id").distinct()
    cuts = t.listings.select("id", "source").join(cut, F.col("id") == F.col("listing_id")).groupBy("source").agg(F.count(F.lit(1)).alias("cuts"))
    rows = figures(t).join(F.broadcast(cuts), "source", "left").withColumn("reductions", F.coalesce("cuts", F.lit(0)))
    upto = lambda c, most: F.least(c, F.lit(most))
    health = upto(F.col("inactive"), 50) * 0.5 + (100 - upto(F.col("reductions"), 100)) * 0.2 + F.col("coverage") * 0.15 + F.least(F.lit(100.0), F.col("active") / 5) * 0.15
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.select("source", "display_name", "active", "inactive", "let_rate", none("avg_price").cast("long").alias("avg_price"), none("median_price").cast("long").alias("median_price"), none("avg_ppsf"), none("median_ppsf"), none("mean_days"), "reductions",
        percent(F.col("reductions"), F.col("active")).alias("reduction_rate"), "coverage", F.coalesce("portfolio", F.lit(0)).alias("portfolio"), F.round("gmv").cast("long").alias("gmv"), F.round(F.col("gmv") * COMMISSION).cast("long").alias("commission"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(health))).cast("int").alias("health"))


@query(f"""WITH w AS (SELECT listing_id, price_pcm AS cp, LAG(price_pcm) OVER (PARTITION BY listing_id ORDER BY seq) AS previous FROM price_history WHERE recorded_at >= {RECENT}),
r AS (SELECT source, COUNT(DISTINCT listing_id) AS n, ROUND(AVG((cp - previous) * 1e0 / previous * 100), 2) AS cut FROM w JOIN listings ON id = listing_id WHERE cp < previous GROUP BY 1),
i AS (SELECT source, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(*) FILTER (WHERE is_active = 0 AND last_seen >= {RECENT} OR first_seen >= {RECENT}) AS turned FROM listings WHERE source <> 'rightmove' GROUP BY 1)
SELECT source, active, COALESCE(n, 0) AS reductions, COALESCE(cut, 0) AS mean_cut, ROUND(COALESCE(n, 0) * 100.0 / active, 1) AS cut_rate, ROUND(turned * 100.0 / active, 1) AS turnover_rate FROM i LEFT JOIN r USING (source) WHERE active > 0""")
def q_agent_perf(t: Tables) -> DataFrame:
    """Reductions and turnover of the last 30 days; a price is compared with the one before within the window."""
    now = F.broadcast(present(t))
    inside = t.history.crossJoin(now).where(recent("recorded_at")).select("listing_id", F.col("price_pcm").alias("cp"), F.lag("price_pcm").over(Window.partitionBy("listing_id").orderBy("seq")).alias("previous")).where("cp < previous")
    # A listing's figures first: then no distinct counts are needed.
    own = inside.groupBy("listing_id").agg(F.sum((F.col("cp") - F.col("previous")) / F.col("previous") * 100).alias("cuts"), F.count(F.lit(1)).alias("n"))
    rows = t.listings.where("source <> 'rightmove'").join(own, F.col("id") == F.col("listing_id"), "left").crossJoin(now)
    turned = F.coalesce((~active() & recent("last_seen")) | recent("first_seen"), F.lit(False))
    by = rows.groupBy("source").agg(F.count_if(active()).alias("active"), F.count("n").alias("reductions"), F.coalesce(F.round(F.try_divide(F.sum("cuts"), F.sum("n")), 2), F.lit(0.0)).alias("mean_cut"), F.count_if(turned).alias("turned"))
    return by.where("active > 0").select("source", "active", "reductions", "mean_cut", percent(F.col("reductions"), F.col("active")).alias("cut_rate"), percent(F.col("turned"), F.col("active")).alias("turnover_rate"))


@query(f"""WITH f AS (SELECT listing_id, ARG_MIN((cp - previous) * 1e0 / previous * 100, seq) AS cut FROM {STEPS} s WHERE cp < previous AND recorded_at >= {RECENT} GROUP BY 1),
m AS (SELECT source, COUNT(*) FILTER (WHERE is_active = 1) AS active, COUNT(cut) AS reductions, COALESCE(ROUND(AVG(cut), 2), 0) AS mean_cut, COUNT(*) FILTER (WHERE is_active = 0 AND last_seen >= {RECENT}) AS turned FROM listings LEFT JOIN f ON listing_id = id WHERE source <> 'rightmove' GROUP BY 1),
s AS (SELECT *, 100 - LEAST(reductions, 100) + 100 - LEAST(ABS(mean_cut) * 20, 100) + LEAST(turned * 1e2 / active, 50) AS raw FROM m WHERE active > 0)
SELECT ROW_NUMBER() OVER (ORDER BY ROUND(raw, 6) DESC, source) AS rank, source, ROUND(raw, 1) AS score, active, reductions, mean_cut, ROUND(turned * 1e2 / active, 1) AS turnover FROM s""")
def q_agent_leaderboard(t: Tables) -> DataFrame:
    """Few and small first cuts of the last 30 days and a high turnover score well; agencies without listings don't take part."""
    now = F.broadcast(present(t))
    cuts = steps(t).where("cp < previous").crossJoin(now).where(recent("recorded_at"))
    first = cuts.groupBy("listing_id").agg(F.min_by((F.col("cp") - F.col("previous")) / F.col("previous") * 100, "seq").alias("cut"))
    rows = t.listings.where("source <> 'rightmove'").join(first, F.col("id") == F.col("listing_id"), "left").crossJoin(now)
    by = rows.groupBy("source").agg(F.count_if(active()).alias("active"), F.count("cut").alias("reductions"), F.coalesce(F.round(F.avg("cut"), 2), F.lit(0.0)).alias("mean_cut"), F.count_if(~active() & recent("last_seen")).alias("turned")).where("active > 0")
    upto = lambda c, most: F.least(c.cast("double"), F.lit(float(most)))
    turnover = F.col("turned") * 100.0 / F.col("active")
    score = 100 - upto(F.col("reductions"), 100) + 100 - upto(F.abs("mean_cut") * 20, 100) + upto(turnover, 50)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(score, 6)), "source"))  # a row an agency
    return by.select(rank.alias("rank"), "source", F.round(score, 1).alias("score"), "active", "reductions", "mean_cut", F.round(turnover, 1).alias("turnover"))


@query(f"""WITH d AS (SELECT CAST(UNNEST(GENERATE_SERIES(CAST({NOW} AS DATE) - INTERVAL {WINDOW_DAYS} DAY, CAST({NOW} AS DATE), INTERVAL 1 DAY)) AS DATE) AS day), s AS (SELECT DISTINCT source FROM listings WHERE source <> 'rightmove'),
f AS (SELECT source, first_cut, COUNT(*) AS n FROM (SELECT listing_id, MIN(CAST(recorded_at AS DATE)) AS first_cut FROM {STEPS} x WHERE cp < previous AND recorded_at >= {RECENT} GROUP BY 1) y JOIN listings ON id = listing_id GROUP BY 1, 2)
SELECT day, source, (SELECT COUNT(*) FROM listings l WHERE l.source = s.source AND CAST(first_seen AS DATE) <= day AND (is_active = 1 OR CAST(last_seen AS DATE) >= day)) AS inventory, CAST(COALESCE((SELECT SUM(n) FROM f WHERE f.source = s.source AND first_cut <= day), 0) AS BIGINT) AS reductions_so_far,
(SELECT COUNT(*) FROM listings l WHERE l.source = s.source AND first_seen >= {RECENT} AND CAST(first_seen AS DATE) <= day) AS new_so_far FROM d CROSS JOIN s""")
def q_agent_trends(t: Tables) -> DataFrame:
    """Per day of the last 30 and agency: listings there, and those reduced and new so far.

    Each listing adds and takes away at its days, in one aggregate and running sums; the grid of days and
    agencies has a row for each pair, and days before it count on its first.
    """
    now = F.broadcast(present(t))
    cuts = steps(t).where("cp < previous").crossJoin(now).where(recent("recorded_at")).groupBy("listing_id").agg(F.min(F.to_date("recorded_at")).alias("cut"))
    rows = t.listings.where("source <> 'rightmove'").join(cuts, F.col("id") == F.col("listing_id"), "left").crossJoin(now)
    begin, end = F.date_sub(F.to_date("now"), WINDOW_DAYS), F.to_date("now")
    step = lambda day, n=0, cut=0, new=0: F.struct(F.greatest(day, begin).alias("day"), F.lit(n).alias("n"), F.lit(cut).alias("cut"), F.lit(new).alias("new"))
    there = F.to_date("first_seen") <= F.coalesce(F.when(active(), end), F.to_date("last_seen"))
    moves = F.array(F.when(there, step(F.to_date("first_seen"), n=1)), F.when(there & ~active(), step(F.date_add(F.to_date("last_seen"), 1), n=-1)), F.when(F.col("cut").isNotNull(), step(F.col("cut"), cut=1)), F.when(recent("first_seen"), step(F.to_date("first_seen"), new=1)))
    by = rows.select("source", F.explode(F.array_compact(moves)).alias("m")).groupBy("source", "m.day").agg(*[F.sum(f"m.{c}").alias(c) for c in ("n", "cut", "new")])
    grid = rows.select("source").distinct().crossJoin(now).select("source", F.explode(F.sequence(begin, end)).alias("day"))
    so_far = Window.partitionBy("source").orderBy("day")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(so_far)
    return grid.join(by, ["source", "day"], "left").select("day", "source", total("n").alias("inventory"), total("cut").alias("reductions_so_far"), total("new").alias("new_so_far"))


DISTRICT = "SPLIT_PART(postcode, ' ', 1)"


@query(f"""SELECT district, n, total, ROUND(n * 100.0 / total, 1) AS share, CAST(ROUND(price) AS BIGINT) AS avg_price, 1 AS rank FROM (SELECT {DISTRICT} AS district, COUNT(*) FILTER (WHERE source = 'savills') AS n, COUNT(*) AS total, AVG(price_pcm) FILTER (WHERE source = 'savills') AS price FROM listings WHERE is_active = 1 AND postcode <> '' AND source <> 'rightmove' GROUP BY 1 HAVING COUNT(*) >= 3) d
WHERE n > 0 ORDER BY ROUND(n * 100.0 / total, 1) DESC, district LIMIT 20""")
def q_market_share(t: Tables) -> DataFrame:
    """One agency's share of the active listings of each district that has three or more, the 20 greatest (ties by name).

    A district has one row, so its rank within the district is 1, as in the dashboard.
    """
    own = F.col("source") == "savills"
    by = t.listings.where("is_active = 1 and postcode <> '' and source <> 'rightmove'").groupBy(A.district_by_space(F.col("postcode")).alias("district")).agg(F.count_if(own).alias("n"), F.count(F.lit(1)).alias("total"), F.avg(F.when(own, F.col("price_pcm"))).alias("price"))
    rows = by.where("total >= 3 and n > 0").select("district", "n", "total", percent(F.col("n"), F.col("total")).alias("share"), F.round("price").cast("long").alias("avg_price"), F.lit(1).alias("rank"))
    return rows.orderBy(F.desc("share"), "district").limit(20)


@query(f"""SELECT CAST(started_at AS DATE) AS day, COUNT(*) AS runs, CAST(SUM(items_scraped) AS BIGINT) AS items, CAST(SUM(error_count) AS BIGINT) AS errors, ROUND(SUM(EPOCH(finished_at) - EPOCH(started_at)) / 60, 1) AS minutes FROM scrape_runs WHERE started_at >= (SELECT MAX(started_at) FROM scrape_runs) - INTERVAL {DAILY_DAYS} DAY GROUP BY 1""")
def q_daily_stats(t: Tables) -> DataFrame:
    """Runs, items, errors and minutes of each of the last 14 days."""
    now = F.broadcast(t.runs.agg(F.max("started_at").alias("now")))
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    rows = t.runs.crossJoin(now).where(recent("started_at", DAILY_DAYS))
    return rows.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("items_scraped").alias("items"), F.sum("error_count").alias("errors"), F.round(F.sum(seconds) / 60e6, 1).alias("minutes"))


@query("""SELECT (SELECT MAX(started_at) FROM scrape_runs) AS last_run, (SELECT status FROM scrape_runs ORDER BY started_at DESC, run_id DESC, spider_name DESC LIMIT 1) AS last_status, (SELECT COUNT(*) FROM listings) AS listings,
(SELECT CAST(SUM(items_scraped) AS BIGINT) FROM scrape_runs WHERE started_at >= (SELECT MAX(started_at) FROM scrape_runs) - INTERVAL 24 HOUR) AS items_of_day, (SELECT CAST(SUM(error_count) AS BIGINT) FROM scrape_runs WHERE started_at >= (SELECT MAX(started_at) FROM scrape_runs) - INTERVAL 24 HOUR) AS errors_of_day""")
def q_health(t: Tables) -> DataFrame:
    """The last run and its status, the number of listings, and items and errors of the last 24 hours."""
    last = t.runs.agg(F.max("started_at").alias("now"), F.max_by("status", F.struct("started_at", "run_id", "spider_name")).alias("last_status"))
    day = t.runs.crossJoin(F.broadcast(last.select("now"))).where(F.expr("started_at >= now - INTERVAL 24 HOURS")).agg(F.sum("items_scraped").alias("items_of_day"), F.sum("error_count").alias("errors_of_day"))
    total = t.listings.agg(F.count(F.lit(1)).alias("listings"))
    return last.crossJoin(F.broadcast(day)).crossJoin(F.broadcast(total)).select(F.col("now").alias("last_run"), F.coalesce("last_status", F.lit("unknown")).alias("last_status"), "listings", F.coalesce("items_of_day", F.lit(0)).alias("items_of_day"), F.coalesce("errors_of_day", F.lit(0)).alias("errors_of_day"))


# Scores of the four tiers; and the subject that comparables are looked for here.
TIER_SCORES = {1: 100, 2: 80, 3: 50, 4: 20}
SUBJECT = {"size": 500, "bedrooms": 2, "district": "SW3", "rent": 6000, "range": 0.2}
TIER_SQL = f"CASE WHEN d = '' THEN 4 WHEN UPPER(d) = 'SW3' THEN 1 WHEN regexp_extract(UPPER(d), '^([A-Z]+[0-9]+)', 1) = 'SW3' THEN 2 WHEN UPPER(d) IN {A.PRIME_ADJACENT} OR regexp_extract(UPPER(d), '^([A-Z]+[0-9]+)', 1) IN {A.PRIME_ADJACENT} THEN 3 ELSE 4 END"
SCORED = f"""(SELECT *, CASE tier WHEN 1 THEN 100 WHEN 2 THEN 80 WHEN 3 THEN 50 ELSE 20 END AS location_score, GREATEST(0, 50 * (1 - ABS(size_sqft - 500) / 500e0 / 2e-1)) AS size_score, GREATEST(0, 50 * (1 - LEAST(ABS(ppsf - 12e0) / 12e0, 5e-1) / 5e-1)) AS ppsf_score FROM
(SELECT *, {TIER_SQL} AS tier FROM (SELECT *, {DISTRICT} AS d, CAST(price_pcm AS DOUBLE) / size_sqft AS ppsf FROM listings WHERE is_active = 1 AND price_pcm > 0 AND bedrooms = 2 AND size_sqft BETWEEN 400 AND 600) a) b)"""


def scored(t: Tables, size: int = SUBJECT["size"], bedrooms: int = SUBJECT["bedrooms"], district: str = SUBJECT["district"], rent: int = SUBJECT["rent"], within: float = SUBJECT["range"]) -> DataFrame:
    """Active listings of about the subject's size and as many bedrooms, with scores of place, size and rate, half of each in all."""
    own = rent / size
    rows = t.listings.where("is_active = 1 and price_pcm > 0").where(F.col("size_sqft").between(size * (1 - within), size * (1 + within)) & (F.col("bedrooms") == bedrooms))
    rows = rows.withColumns({"district": A.district_by_space(F.col("postcode")), "ppsf": F.col("price_pcm") / F.col("size_sqft")})
    rows = rows.withColumn("tier", A.comp_tier(F.col("district"), F.lit(district)))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in TIER_SCORES.items() for x in pair]), F.col("tier"))
    near = F.greatest(F.lit(0.0), 50 * (1 - F.abs(F.col("size_sqft") - size) / size / within))
    like = F.greatest(F.lit(0.0), 50 * (1 - F.least(F.abs(F.col("ppsf") - own) / own, F.lit(0.5)) / 0.5))
    rows = rows.withColumns({"location_score": place, "size_score": near, "ppsf_score": like})
    return rows.withColumn("score", (F.col("location_score") + F.col("size_score") + F.col("ppsf_score")) * 0.5)


@query(f"SELECT id, d AS district, tier, ROUND(ppsf, 6) AS ppsf, location_score, ROUND(size_score, 6) AS size_score, ROUND(ppsf_score, 6) AS ppsf_score, ROUND((location_score + size_score + ppsf_score) * 5e-1, 6) AS score FROM {SCORED} s")
def r_comps_scored(t: Tables) -> DataFrame:
    return scored(t).select("id", "district", "tier", "location_score", *[F.round(c, 6).alias(c) for c in ("ppsf", "size_score", "ppsf_score", "score")])


MARKET = f"(SELECT *, {DISTRICT} AS d, CAST(price_pcm AS DOUBLE) / size_sqft AS ppsf FROM listings WHERE is_active = 1 AND size_sqft > 100 AND price_pcm > 500)"


@query(f"""SELECT c.*, m.*, 12.0 AS subject_ppsf FROM (SELECT COUNT(*) AS comps, COUNT(*) FILTER (WHERE regexp_matches(d, '^SW1[A-Z]$')) AS sw1_comps, ROUND(MEDIAN(ppsf), 2) AS median_ppsf, ROUND(AVG(ppsf), 2) AS mean_ppsf, ROUND(QUANTILE_CONT(ppsf, 0.25), 2) AS p25_ppsf, ROUND(QUANTILE_CONT(ppsf, 0.75), 2) AS p75_ppsf, ROUND(AVG(CAST(ppsf < 12 AS INT)) * 100, 1) AS comp_percentile,
ROUND(MEDIAN(price_pcm) FILTER (WHERE regexp_matches(d, '^SW1[A-Z]$')), 0) AS sw1_median_rent, ROUND(MEDIAN(price_pcm), 0) AS median_rent, {', '.join(f"COUNT(*) FILTER (WHERE tier = {i}) AS tier{i}_count, ROUND(MEDIAN(ppsf) FILTER (WHERE tier = {i}), 2) AS tier{i}_median_ppsf, ROUND(MEDIAN(price_pcm) FILTER (WHERE tier = {i}), 0) AS tier{i}_median_rent" for i in TIER_SCORES)} FROM {SCORED} s) c
CROSS JOIN (SELECT COUNT(*) AS market, COUNT(*) FILTER (WHERE regexp_matches(d, '^SW1[A-Z]$')) AS sw1_market, ROUND(AVG(CAST(ppsf < 12 AS INT)) * 100, 1) AS market_percentile, ROUND(MEDIAN(ppsf) FILTER (WHERE regexp_matches(d, '^SW1[A-Z]$')), 2) AS sw1_median_ppsf FROM {MARKET} x) m""")
def r_comps_stats(t: Tables) -> DataFrame:
    """The comparables and the market about them in figures: one aggregate of each."""
    own = SUBJECT["rent"] / SUBJECT["size"]
    below = F.round(F.avg((F.col("ppsf") < own).cast("int")) * 100, 1)
    middle = lambda c, where=None, digits=2: F.round(F.median(c if where is None else F.when(where, F.col(c))), digits)
    sw1 = A.is_sw1(F.col("district"))
    tiers = [x for i in TIER_SCORES for x in (F.count_if(F.col("tier") == i).alias(f"tier{i}_count"), middle("ppsf", F.col("tier") == i).alias(f"tier{i}_median_ppsf"), middle("price_pcm", F.col("tier") == i, 0).alias(f"tier{i}_median_rent"))]
    comps = scored(t).agg(F.count(F.lit(1)).alias("comps"), F.count_if(sw1).alias("sw1_comps"), middle("ppsf").alias("median_ppsf"), F.round(F.avg("ppsf"), 2).alias("mean_ppsf"), F.round(F.percentile("ppsf", 0.25), 2).alias("p25_ppsf"), F.round(F.percentile("ppsf", 0.75), 2).alias("p75_ppsf"), below.alias("comp_percentile"), middle("price_pcm", sw1, 0).alias("sw1_median_rent"), middle("price_pcm", None, 0).alias("median_rent"), *tiers)
    rows = t.listings.where("is_active = 1 and size_sqft > 100 and price_pcm > 500").withColumns({"district": A.district_by_space(F.col("postcode")), "ppsf": F.col("price_pcm") / F.col("size_sqft")})
    market = rows.agg(F.count(F.lit(1)).alias("market"), F.count_if(sw1).alias("sw1_market"), below.alias("market_percentile"), middle("ppsf", sw1).alias("sw1_median_ppsf"))
    return comps.crossJoin(F.broadcast(market)).withColumn("subject_ppsf", F.lit(own))
