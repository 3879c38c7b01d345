"""Joins with conditions, ordered choices, postcode tiers and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from .catalogue import Tables, query

#: As SQL text: the last day that any listing was seen.
NOW = "(SELECT MAX(last_seen) FROM listings)"


def district() -> Column:
    return F.substring_index("postcode", " ", 1)


def latest(t: Tables) -> DataFrame:
    return t.listings.agg(F.max("last_seen").alias("now"))


@query("""SELECT a.id, b.id AS canonical, c.id AS duplicate FROM listings a JOIN listings b ON b.id = a.id - a.id % 32 JOIN listings c ON c.id = a.id + 1 WHERE a.is_active = 1""")
def jn_self2(t: Tables) -> DataFrame:
    a = t.listings.where("is_active = 1").select("id", (F.col("id") - F.col("id") % 32).alias("_b"), (F.col("id") + 1).alias("_c"))
    b, c = t.listings.select(F.col("id").alias("canonical")), t.listings.select(F.col("id").alias("duplicate"))
    return a.join(b, F.col("_b") == F.col("canonical")).join(c, F.col("_c") == F.col("duplicate")).select("id", "canonical", "duplicate")


@query("""SELECT source, n, n * 100 / total AS share FROM (SELECT source, COUNT(*) AS n FROM listings GROUP BY 1) s CROSS JOIN (SELECT CAST(COUNT(*) AS DOUBLE) AS total FROM listings) x""")
def jn_cross_scalar(t: Tables) -> DataFrame:
    per = t.listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = t.listings.agg(F.count(F.lit(1)).cast("double").alias("total"))  # one row
    return per.crossJoin(total).select("source", "n", (F.col("n") * 100 / F.col("total")).alias("share"))


@query("""SELECT l.id, COUNT(h.seq) AS cuts FROM listings l LEFT JOIN price_history h ON h.listing_id = l.id AND h.price_pcm < l.price_pcm AND h.seq > 1 GROUP BY 1""")
def jn_left_residual(t: Tables) -> DataFrame:
    h = t.history.select("listing_id", F.col("price_pcm").alias("_price"), "seq")
    on = (F.col("id") == F.col("listing_id")) & (F.col("_price") < F.col("price_pcm")) & (F.col("seq") > 1)
    return t.listings.select("id", "price_pcm").join(h, on, "left").groupBy("id").agg(F.count("seq").alias("cuts"))


@query("""SELECT id, CASE source WHEN 'savills' THEN 1 WHEN 'knightfrank' THEN 2 WHEN 'chestertons' THEN 3 WHEN 'foxtons' THEN 4 ELSE 5 END AS rank FROM listings""")
def jn_map_broadcast(t: Tables) -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(("savills", "knightfrank", "chestertons", "foxtons")) for x in (s, i + 1)])
    return t.listings.select("id", F.coalesce(F.try_element_at(ranks, "source"), F.lit(5)).alias("rank"))


@query("""SELECT SPLIT_PART(postcode, ' ', 1) AS district, MIN(size_sqft) AS least, MAX(size_sqft) AS most, ROUND(AVG(size_sqft), 1) AS mean FROM listings WHERE size_sqft IS NOT NULL GROUP BY 1""")
def agg_min_max_round(t: Tables) -> DataFrame:
    sized = t.listings.where("size_sqft is not null").groupBy(district().alias("district"))
    return sized.agg(F.min("size_sqft").alias("least"), F.max("size_sqft").alias("most"), F.round(F.avg("size_sqft"), 1).alias("mean"))


@query("""SELECT days, SUM(n) OVER (ORDER BY days) * 1e2 / SUM(n) OVER () AS cumulative FROM (SELECT CAST(FLOOR((EPOCH(last_seen) - EPOCH(first_seen)) / 86400) AS INT) AS days, COUNT(*) AS n FROM listings WHERE last_seen IS NOT NULL AND first_seen IS NOT NULL GROUP BY 1) d""")
def agg_cdf(t: Tables) -> DataFrame:
    """Per number of days on the market the share of listings with as many or fewer; the windows span the distinct numbers only."""
    days = X.days_on_market(F.col("first_seen"), F.col("last_seen"))
    per = t.listings.groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("n")).where("days is not null")
    return per.select("days", (F.sum("n").over(Window.orderBy("days")) * F.lit(100.0) / F.sum("n").over(Window.partitionBy())).alias("cumulative"))


@query("""SELECT id FROM (SELECT id, ROW_NUMBER() OVER (PARTITION BY price_pcm, size_sqft, bedrooms, SPLIT_PART(postcode, ' ', 1) ORDER BY CASE source WHEN 'savills' THEN 1 WHEN 'knightfrank' THEN 2 WHEN 'chestertons' THEN 3 WHEN 'foxtons' THEN 4 ELSE 5 END, id) AS rn FROM listings) x WHERE rn = 1""")
def win_drop_dups_priority(t: Tables) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("savills", "knightfrank", "chestertons", "foxtons", "rightmove"))), F.col("source"))
    key = ["price_pcm", "size_sqft", "bedrooms", district().alias("district")]
    # One row of a key is a minimum, which is combined before the shuffle; a row number would not be.
    return t.listings.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), "id"))["id"].alias("id")).select("id")


@query("""SELECT label, ordinal, COUNT(*) AS n FROM (SELECT CASE WHEN bedrooms = 0 THEN 'Studio' WHEN bedrooms <= 2 THEN 'Small' ELSE 'Large' END AS label, CASE WHEN bedrooms = 0 THEN 1 WHEN bedrooms <= 2 THEN 2 ELSE 3 END AS ordinal FROM listings) x GROUP BY 1, 2 ORDER BY ordinal""")
def srt_custom_case(t: Tables) -> DataFrame:
    label = F.when(F.col("bedrooms") == 0, "Studio").when(F.col("bedrooms") <= 2, "Small").otherwise("Large")
    ordinal = F.when(F.col("bedrooms") == 0, 1).when(F.col("bedrooms") <= 2, 2).otherwise(3)
    return t.listings.groupBy(label.alias("label"), ordinal.alias("ordinal")).agg(F.count(F.lit(1)).alias("n")).orderBy("ordinal")


@query("""SELECT id, gap FROM (SELECT id, ABS(size_sqft - 500) AS gap FROM listings WHERE size_sqft IS NOT NULL) x ORDER BY gap, id LIMIT 20""")
def lim_nsmallest(t: Tables) -> DataFrame:
    gap = t.listings.where("size_sqft is not null").select("id", F.abs(F.col("size_sqft") - 500).alias("gap"))
    return gap.orderBy("gap", "id").limit(20)


AGENTS = "SELECT agent_name, COUNT(*) AS n FROM listings WHERE agent_name IS NOT NULL GROUP BY 1"


@query(f"""SELECT agent_name, n, 'most' AS side FROM (SELECT * FROM ({AGENTS}) a ORDER BY n DESC, agent_name LIMIT 5) x UNION ALL SELECT agent_name, n, 'least' AS side FROM (SELECT * FROM ({AGENTS}) b ORDER BY n, agent_name LIMIT 5) y""")
def lim_head_tail(t: Tables) -> DataFrame:
    n = t.listings.where("agent_name is not null").groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"))
    most, least = n.orderBy(F.desc("n"), "agent_name").limit(5), n.orderBy("n", "agent_name").limit(5)
    return most.withColumn("side", F.lit("most")).unionByName(least.withColumn("side", F.lit("least")))


@query("""SELECT id, price_pcm, size_sqft, CAST(price_pcm AS DOUBLE) / size_sqft AS ppsf FROM listings WHERE size_sqft > 0""")
def set_hconcat(t: Tables) -> DataFrame:
    """Columns beside one another are computed in place; rows are never paired by position."""
    return t.listings.where("size_sqft > 0").select("id", "price_pcm", "size_sqft", (F.col("price_pcm").cast("double") / F.col("size_sqft")).alias("ppsf"))


@query("""SELECT id FROM listings WHERE is_active = 1 AND source = 'savills' AND (CAST(price_pcm AS DOUBLE) / size_sqft < 2.5 OR CAST(price_pcm AS DOUBLE) / size_sqft > 25) ORDER BY id LIMIT 50""")
def flt_dynamic(t: Tables, source: str | None = "savills", issue: bool = True, limit: int | None = 50) -> DataFrame:
    """Listings by conditions that are only set if they are asked for."""
    rows, ppsf = t.listings.where("is_active = 1"), F.col("price_pcm").cast("double") / F.col("size_sqft")
    if source:
        rows = rows.where(F.col("source") == source)
    if issue:
        rows = rows.where((ppsf < 2.5) | (ppsf > 25))
    rows = rows.select("id").orderBy("id")
    return rows.limit(limit) if limit else rows


@query("""SELECT id, source, CASE WHEN CAST(price_pcm AS DOUBLE) / size_sqft < 2.5 THEN 'low' ELSE 'high' END AS issue FROM listings WHERE size_sqft > 0 AND (CAST(price_pcm AS DOUBLE) / size_sqft < 2.5 OR CAST(price_pcm AS DOUBLE) / size_sqft > 25)""")
def dq_suspicious(t: Tables) -> DataFrame:
    ppsf = F.col("price_pcm").cast("double") / F.col("size_sqft")
    return t.listings.where("size_sqft > 0").where((ppsf < 2.5) | (ppsf > 25)).select("id", "source", F.when(ppsf < 2.5, "low").otherwise("high").alias("issue"))


@query("""SELECT id, CAST(regexp_matches(SPLIT_PART(postcode, ' ', 1), '^[A-Z]{1,2}[0-9]{1,2}[A-Z]?$') AS INT) AS valid, CASE WHEN CONTAINS(postcode, ' ') THEN postcode END AS normal, CASE WHEN postcode = '' THEN NULL ELSE SPLIT_PART(postcode, ' ', 1) END AS outcode FROM listings""")
def fn_pc_normal(t: Tables) -> DataFrame:
    squeezed = F.replace(F.lower("postcode"), F.lit(" "), F.lit("  "))
    return t.listings.select("id", A.valid_district(district()).cast("int").alias("valid"), A.normal_postcode(squeezed).alias("normal"), A.outcode(F.col("postcode")).alias("outcode"))


@query("""SELECT id, CASE SPLIT_PART(postcode, ' ', 1) WHEN 'SW1A' THEN 2 WHEN 'SW3' THEN 3 WHEN 'NW3' THEN 3 WHEN 'SW7' THEN 3 WHEN 'W8' THEN 3 WHEN 'W1' THEN 3 ELSE 4 END AS tier FROM listings""")
def fn_comp_tier(t: Tables, subject: str = "SW1W") -> DataFrame:
    return t.listings.select("id", A.comp_tier(district(), F.lit(subject)).alias("tier"))


@query("""SELECT tier, COUNT(*) AS n, MEDIAN(CAST(price_pcm AS DOUBLE) / size_sqft) AS ppsf, MEDIAN(CAST(price_pcm AS DOUBLE) / size_sqft) * 850 AS fair_rent FROM (SELECT price_pcm, size_sqft, CASE SPLIT_PART(postcode, ' ', 1) WHEN 'SW1A' THEN 2 WHEN 'SW3' THEN 3 WHEN 'NW3' THEN 3 WHEN 'SW7' THEN 3 WHEN 'W8' THEN 3 WHEN 'W1' THEN 3 ELSE 4 END AS tier FROM listings WHERE is_active = 1 AND size_sqft > 0) x GROUP BY 1""")
def q_tier_stats(t: Tables, subject: str = "SW1W", size: int = 850) -> DataFrame:
    """Per tier of comparables their number, median price a square foot, and what that makes of a size."""
    rows = t.listings.where("is_active = 1 and size_sqft > 0").select(A.comp_tier(district(), F.lit(subject)).alias("tier"), (F.col("price_pcm").cast("double") / F.col("size_sqft")).alias("v"))
    per = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("ppsf"))
    return per.withColumn("fair_rent", F.col("ppsf") * size)


@query("""SELECT SUM(n) AS listings, SUM(let) AS let, SUM(let) * 1e2 / SUM(n) AS let_rate, MAX(let * 1e2 / n) AS best_rate FROM (SELECT SPLIT_PART(agent_name, ',', 1) AS agency, COUNT(*) AS n, SUM(1 - is_active) AS let FROM listings WHERE agent_name IS NOT NULL GROUP BY 1) a""")
def q_agency_totals(t: Tables) -> DataFrame:
    per = t.listings.where("agent_name is not null").groupBy(F.substring_index("agent_name", ",", 1)).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("is_active")).alias("let"))
    rate = F.col("let") * F.lit(100.0) / F.col("n")
    return per.agg(F.sum("n").alias("listings"), F.sum("let").alias("let"), (F.sum("let") * F.lit(100.0) / F.sum("n")).alias("let_rate"), F.max(rate).alias("best_rate"))


@query("""SELECT run_id, spider_name, date_sub('minute', started_at, finished_at) AS minutes FROM scrape_runs WHERE status = 'failed'""")
def q_run_minutes(t: Tables) -> DataFrame:
    """Whole minutes that each failed run took."""
    return t.runs.where("status = 'failed'").select("run_id", "spider_name", F.timestamp_diff("MINUTE", F.col("started_at"), F.col("finished_at")).alias("minutes"))


@query("""SELECT spider_name, items_scraped, error_count, status FROM scrape_runs WHERE run_id = (SELECT MAX(run_id) FROM scrape_runs) ORDER BY spider_name""")
def q_runs_by_id(t: Tables) -> DataFrame:
    last = t.runs.agg(F.max("run_id").alias("_last"))  # one row
    return t.runs.join(F.broadcast(last), F.col("run_id") == F.col("_last")).select("spider_name", "items_scraped", "error_count", "status").orderBy("spider_name")


@query(f"""SELECT source, COUNT(*) AS n FROM listings WHERE last_seen >= {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING COUNT(*) >= 1""")
def dq_recent_source(t: Tables) -> DataFrame:
    recent = t.listings.join(F.broadcast(latest(t)), F.col("last_seen") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 1")


@query("""SELECT COUNT(*) AS listings, COUNT(size_sqft) AS sized, COUNT(CASE WHEN postcode <> '' THEN 1 END) AS placed, COUNT(CASE WHEN latitude <> 0 THEN 1 END) AS located, COUNT(CASE WHEN is_active = 1 THEN 1 END) AS active FROM listings""")
def dq_coverage(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return t.listings.agg(F.count(F.lit(1)).alias("listings"), F.count("size_sqft").alias("sized"), n("postcode <> ''").alias("placed"), n("latitude <> 0").alias("located"), n("is_active = 1").alias("active"))
