"""Projections, filters and scalar functions over listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from ..functions import wording as W
from .catalogue import Tables, query

PPSF = "CAST(price_pcm AS DOUBLE) / NULLIF(size_sqft, 0)"


@query(f"SELECT id, {PPSF} AS ppsf FROM listings")
def proj_ppsf(t: Tables) -> DataFrame:
    return t.listings.select("id", X.ppsf(F.col("price_pcm"), F.col("size_sqft")).alias("ppsf"))


@query("SELECT id, SPLIT_PART(postcode, ' ', 1) AS district FROM listings")
def proj_district_space(t: Tables) -> DataFrame:
    return t.listings.select("id", A.district_by_space(F.col("postcode")).alias("district"))


@query("""SELECT id, CASE WHEN price_pcm < 2000 THEN '<£2k' WHEN price_pcm < 3000 THEN '£2-3k' WHEN price_pcm < 5000 THEN '£3-5k' WHEN price_pcm < 10000 THEN '£5-10k' ELSE '£10k+' END AS tier,
CASE WHEN bedrooms = 0 THEN 'Studio' WHEN bedrooms <= 4 THEN CONCAT(CAST(bedrooms AS STRING), ' Bed') ELSE '5+ Bed' END AS beds FROM listings""")
def proj_case_bucket(t: Tables) -> DataFrame:
    return t.listings.select("id", X.tier(F.col("price_pcm")).alias("tier"), X.bedroom_label(F.col("bedrooms")).alias("beds"))


@query("SELECT id, source FROM listings WHERE is_active = 1")
def flt_active(t: Tables) -> DataFrame:
    return t.listings.where("is_active = 1").select("id", "source")


@query("SELECT id FROM listings WHERE size_sqft BETWEEN 400 AND 900 AND bedrooms BETWEEN 1 AND 3")
def flt_between(t: Tables) -> DataFrame:
    return t.listings.where(F.col("size_sqft").between(400, 900) & F.col("bedrooms").between(1, 3)).select("id")


@query("SELECT id, postcode FROM listings WHERE regexp_matches(postcode, '^SW1[A-Z]') OR regexp_matches(postcode, '^SW3') OR regexp_matches(postcode, '^SW7') OR regexp_matches(postcode, '^W1[A-Z]')")
def flt_regex(t: Tables) -> DataFrame:
    return t.listings.where(F.col("postcode").rlike("^(?:SW1[A-Z]|SW3|SW7|W1[A-Z])")).select("id", "postcode")


@query("SELECT id FROM listings WHERE summary NOT ILIKE '%short let%' OR summary IS NULL")
def flt_ilike_null(t: Tables) -> DataFrame:
    return t.listings.where(~F.col("summary").ilike("%short let%") | F.col("summary").isNull()).select("id")


@query("SELECT id FROM listings WHERE price_period = 'pcm' OR price_period IS NULL OR price_period = ''")
def flt_null_or_empty(t: Tables) -> DataFrame:
    return t.listings.where(F.coalesce("price_period", F.lit("")).isin("pcm", "")).select("id")


@query("SELECT id FROM listings WHERE source IN ('savills', 'foxtons') AND bedrooms NOT IN (0, 5)")
def flt_in(t: Tables) -> DataFrame:
    return t.listings.where(F.col("source").isin("savills", "foxtons") & ~F.col("bedrooms").isin(0, 5)).select("id")


@query("SELECT id, postcode FROM listings WHERE postcode LIKE 'SW1%'")
def flt_like_prefix(t: Tables) -> DataFrame:
    return t.listings.where(F.col("postcode").startswith("SW1")).select("id", "postcode")


@query("SELECT id FROM listings WHERE size_sqft IS NULL OR size_sqft = 0")
def flt_isnull_or_zero(t: Tables) -> DataFrame:
    return t.listings.where(F.coalesce("size_sqft", F.lit(0)) == 0).select("id")


@query("SELECT id FROM listings WHERE last_seen >= (SELECT MAX(first_seen) FROM listings) - INTERVAL 30 DAY")
def flt_reltime(t: Tables) -> DataFrame:
    now = t.listings.agg(F.max("first_seen").alias("now"))
    return t.listings.crossJoin(F.broadcast(now)).where(F.expr("last_seen >= now - INTERVAL 30 DAYS")).select("id")


@query("SELECT id FROM listings WHERE CAST(first_seen AS DATE) = DATE '1998-03-01'")
def flt_datestr_prefix(t: Tables) -> DataFrame:
    return t.listings.where("first_seen >= '1998-03-01' and first_seen < '1998-03-02'").select("id")


@query("""SELECT id FROM listings WHERE NOT COALESCE(size_sqft / CASE WHEN bedrooms = 0 THEN 0.5 ELSE bedrooms END < 70 OR price_pcm > 100000 OR size_sqft < 150 OR size_sqft > 10000
OR CAST(price_pcm AS DOUBLE) / size_sqft < 3 OR CAST(price_pcm AS DOUBLE) / size_sqft > 30 OR price_pcm < 500, TRUE) AND size_sqft IS NOT NULL""")
def flt_quality_mask(t: Tables) -> DataFrame:
    rows = t.listings
    return rows.where(X.sound({c: F.col(c) for c in rows.columns})).select("id")


@query("SELECT id FROM listings WHERE postcode = '' OR postcode LIKE 'SW%' OR postcode LIKE 'W8%'")
def flt_target_area(t: Tables) -> DataFrame:
    return t.listings.where((F.col("postcode") == "") | F.col("postcode").startswith("SW") | F.col("postcode").startswith("W8")).select("id")


@query("SELECT id, LOWER(REPLACE(postcode, ' ', '')) AS compact FROM listings")
def fn_pc_compact(t: Tables) -> DataFrame:
    return t.listings.select("id", A.compact_postcode(F.col("postcode")).alias("compact"))


@query("SELECT id, CASE WHEN CONTAINS(postcode, ' ') THEN postcode END AS full_postcode, NULLIF(SPLIT_PART(postcode, ' ', 1), '') AS district, NULLIF(regexp_extract(postcode, '^([A-Z]{1,2})', 1), '') AS area FROM listings")
def fn_pc_parts(t: Tables) -> DataFrame:
    p = F.col("postcode")
    return t.listings.select("id", A.postcode_full(p).alias("full_postcode"), A.postcode_district(p).alias("district"), A.postcode_area(p).alias("area"))


@query("SELECT id, CAST(SPLIT_PART(postcode, ' ', 1) IN ('SW1A', 'SW3', 'SW10', 'W8', 'NW3', 'SW7', 'W1') AS INT) AS prime FROM listings")
def fn_is_prime(t: Tables) -> DataFrame:
    return t.listings.select("id", A.is_prime(A.district_by_space(F.col("postcode"))).cast("int").alias("prime"))


@query("""SELECT id, CAST(id % 200 + 1 AS STRING) AS number, CASE WHEN id % 4 = 0 THEN CAST(id % 9 + 1 AS STRING) ELSE '' END AS unit,
CASE WHEN address LIKE '%Eaton%' THEN 'eaton square' WHEN address LIKE '%James%' THEN 'saint james street' WHEN address LIKE '%Kings%' THEN 'kings road' WHEN address LIKE '%Sloane%' THEN 'sloane avenue' WHEN address LIKE '%Cadogan%' THEN 'cadogan place' ELSE 'high street' END AS street FROM listings""")
def fn_parse_address(t: Tables) -> DataFrame:
    a = F.col("address")
    return t.listings.select("id", A.street_number(a).alias("number"), A.unit(a).alias("unit"), A.street_name(a).alias("street"))


@query("""SELECT id, SUBSTR(sha256(CONCAT_WS('_', NULLIF(LOWER(REPLACE(postcode, ' ', '')), ''), CAST(id % 200 + 1 AS STRING),
CASE WHEN address LIKE '%Eaton%' THEN 'eaton square' WHEN address LIKE '%James%' THEN 'saint james street' WHEN address LIKE '%Kings%' THEN 'kings road' WHEN address LIKE '%Sloane%' THEN 'sloane avenue' WHEN address LIKE '%Cadogan%' THEN 'cadogan place' ELSE 'high street' END,
CASE WHEN id % 4 = 0 THEN CAST(id % 9 + 1 AS STRING) END)), 1, 16) AS fingerprint FROM listings""")
def fn_fingerprint(t: Tables) -> DataFrame:
    return t.listings.select("id", A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id")).alias("fingerprint"))


@query("""SELECT id, CASE WHEN price_pcm <= 0 THEN 'Unknown' WHEN price_pcm < 2000 THEN '< £2,000' WHEN price_pcm < 3000 THEN '£2,000-3,000' WHEN price_pcm < 5000 THEN '£3,000-5,000' WHEN price_pcm < 7500 THEN '£5,000-7,500'
WHEN price_pcm < 10000 THEN '£7,500-10,000' WHEN price_pcm < 15000 THEN '£10,000-15,000' WHEN price_pcm < 25000 THEN '£15,000-25,000' ELSE '£25,000+' END AS bucket FROM listings""")
def fn_bucket_8(t: Tables) -> DataFrame:
    return t.listings.select("id", X.price_bucket(F.col("price_pcm")).alias("bucket"))


@query("SELECT id, CAST(TRUNC(price_pcm * 12 / 52) AS INT) AS pw, CAST(TRUNC(price_pcm * 52 / 12) AS INT) AS from_pw FROM listings")
def fn_pcm_pw(t: Tables) -> DataFrame:
    return t.listings.select("id", X.weekly(F.col("price_pcm")).alias("pw"), X.monthly(F.col("price_pcm")).alias("from_pw"))


@query("""SELECT id, CASE WHEN added_date IS NULL THEN NULL WHEN added_date LIKE 'Reduced%' THEN 'reduced' ELSE 'added' END AS event,
CASE WHEN added_date LIKE '%yesterday' THEN CAST((SELECT MAX(first_seen) FROM listings) AS DATE) - 1 WHEN added_date IS NOT NULL THEN CAST(first_seen AS DATE) END AS added_on FROM listings""")
def fn_parse_added(t: Tables) -> DataFrame:
    rows = t.listings.crossJoin(F.broadcast(t.listings.agg(F.max("first_seen").alias("now"))))
    return rows.select("id", X.event_type(F.col("added_date")).alias("event"), X.parse_added(F.col("added_date"), F.col("now")).alias("added_on"))


@query("SELECT id, CASE WHEN LOWER(summary) LIKE '%short%' THEN 'short' WHEN LOWER(summary) LIKE '%long%' THEN 'long' ELSE 'unknown' END AS let_type FROM listings")
def fn_let_type(t: Tables) -> DataFrame:
    return t.listings.select("id", X.let_type(F.col("summary")).alias("let_type"))


@query("SELECT id, COALESCE(SPLIT_PART(agent_name, ',', 1), 'unknown') AS brand FROM listings")
def fn_agent_brand(t: Tables) -> DataFrame:
    return t.listings.select("id", W.brand(F.col("agent_name")).alias("brand"))


@query("""SELECT id, ROUND(2 * 6371000 * ATAN2(SQRT(a), SQRT(1 - a)), 3) AS metres FROM (SELECT id, POW(SIN(RADIANS(5.15e1 - latitude) / 2), 2) + COS(RADIANS(latitude)) * COS(RADIANS(5.15e1)) * POW(SIN(RADIANS(-1.5e-1 - longitude) / 2), 2) AS a FROM listings) x""")
def fn_haversine(t: Tables) -> DataFrame:
    return t.listings.select("id", F.round(X.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(51.5), F.lit(-0.15)), 3).alias("metres"))


@query("SELECT id, " + ", ".join(f"CAST(CONTAINS(LOWER(summary), '{w}') AS INT) AS has_{w.replace(' ', '_')}" for w in ("balcony", "garden", "lift", "porter", "parking", "roof terrace")) + " FROM listings")
def tx_amenity_flags(t: Tables) -> DataFrame:
    return t.listings.select("id", *(c.alias(n) for n, c in X.amenity_flags(F.col("summary")).items()))


#: Addresses of listings' pages, which the tables don't have; some are missing or of another kind.
URL = "CASE WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN CONCAT('ftp://listings.example.com/of/the/market/', property_id) ELSE CONCAT('https://example.com/', source, '/', property_id) END"


@query(f"""SELECT id, issues, issues = '' AS valid, NOT CONTAINS(issues, 'missing url') AS kept FROM (SELECT id, CONCAT_WS(';', CASE WHEN COALESCE(price_pcm, 0) <= 0 THEN 'missing/invalid price_pcm' WHEN price_pcm < 100 THEN CONCAT('price_pcm too low (', price_pcm, ')') WHEN price_pcm > 500000 THEN CONCAT('price_pcm suspiciously high (', price_pcm, ')') END,
CASE WHEN LENGTH(address) < 5 THEN 'missing/invalid address' END, CASE WHEN url IS NULL THEN 'missing url' WHEN NOT STARTS_WITH(url, 'http') THEN CONCAT('invalid url format (', SUBSTR(url, 1, 30), '...)') END, CASE WHEN bedrooms < 0 OR bedrooms > 20 THEN CONCAT('invalid bedrooms (', bedrooms, ')') END,
CASE WHEN size_sqft < 50 THEN CONCAT('sqft too small (', size_sqft, ')') WHEN size_sqft > 50000 THEN CONCAT('sqft too large (', size_sqft, ')') END) AS issues FROM (SELECT *, {URL} AS url FROM listings) u) i""")
def fn_validate_item(t: Tables) -> DataFrame:
    """Every rule a listing breaks, whether it breaks none, and whether it is kept where only critical ones drop it."""
    rows = t.listings.withColumn("url", F.expr(URL))
    rows = rows.select("id", X.issues({c: F.col(c) for c in rows.columns}).alias("found"))
    return rows.select("id", F.array_join("found", ";").alias("issues"), X.acceptable(F.col("found"), strict=True).alias("valid"), X.acceptable(F.col("found")).alias("kept"))


@query("SELECT id, CASE WHEN price_pcm <= 0 THEN NULL WHEN price_pcm <= 2000 THEN 0 WHEN price_pcm <= 5000 THEN 1 WHEN price_pcm <= 10000 THEN 2 WHEN price_pcm <= 30000 THEN 3 END AS bin FROM listings")
def fn_cut_right(t: Tables) -> DataFrame:
    return t.listings.select("id", X.cut_right(F.col("price_pcm"), (0, 2000, 5000, 10000, 30000)).alias("bin"))
