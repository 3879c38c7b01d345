"""Duplicates found by place, price and text, their groups, and what a group's rows give each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from .catalogue import Tables, query
from .matching import KEY, fingerprinted, priority

# Endings dropped from addresses; street kinds and their short forms, in order; agents whose sizes go first.
DROPPED = (", london", ", sw1", ", sw3", ", sw5", ", sw7", ", w8", ", w11")
SHORT = ((" street", " st"), (" road", " rd"), (" avenue", " ave"), (" lane", " ln"), (" court", " ct"), (" gardens", " gdns"), (" square", " sq"), (" terrace", " terr"), (" place", " pl"))
AGENCIES = ("knightfrank", "foxtons", "chestertons")
TEXTS, NUMBERS = ("property_type", "summary", "agent_name", "added_date"), ("size_sqft", "bathrooms", "latitude", "longitude")
FIELDS = NUMBERS + TEXTS

NORMAL_A = r"TRIM(regexp_replace(regexp_replace(LOWER(address), '[,.-]', ' ', 'g'), '\s+', ' ', 'g'))"
SCORE = """CASE WHEN bedrooms IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN bathrooms IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN size_sqft IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN latitude <> 0 AND longitude <> 0 THEN 1 ELSE 0 END
+ CASE WHEN property_type <> '' THEN 1 ELSE 0 END + CASE WHEN agent_name <> '' THEN 1 ELSE 0 END"""
#: As SQL: each listing with its place's key and its rank there, best first.
RANKED = f"(SELECT *, COUNT(*) OVER (PARTITION BY k) AS n, ROW_NUMBER() OVER (PARTITION BY k ORDER BY score DESC, last_seen DESC, id) AS rn FROM (SELECT *, {KEY} AS k, {SCORE} AS score FROM listings) s)"


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal_a(address: Column) -> Column:
    """Lower case, single spaces, without telling endings and punctuation."""
    out = spaced(F.lower(F.coalesce(address, F.lit(""))))
    for ending in DROPPED:
        out = F.replace(out, F.lit(ending), F.lit(""))
    return spaced(F.regexp_replace(out, r"[,.\-]", " "))


def normal_b(address: Column) -> Column:
    """Number and street with short street kinds where there are such, else the address without unit words."""
    out = F.regexp_replace(F.trim(F.lower(F.coalesce(address, F.lit("")))), r"\s+(?:flat|apartment|apt|unit)\s*\d*", "")
    for full, short in SHORT:
        out = F.replace(out, F.lit(full), F.lit(short))
    out, pattern = spaced(out), r"(\d+[-\d]*)\s+([^,]+)"
    found = F.concat_ws(" ", F.regexp_extract(out, pattern, 1), F.trim(F.regexp_extract(out, pattern, 2)))
    return F.when(out.rlike(pattern), found).otherwise(out)


def completeness() -> Column:
    """0 to 7: what a listing tells, its size counting twice."""
    told = lambda c, w=1: F.when(c, w).otherwise(0)
    there = [told(F.col("bedrooms").isNotNull()), told(F.col("bathrooms").isNotNull()), told(F.col("size_sqft").isNotNull(), 2)]
    there += [told((F.col("latitude") != 0) & (F.col("longitude") != 0)), told(F.col("property_type") != ""), told(F.col("agent_name") != "")]
    return sum(there[1:], there[0])


def prepared(t: Tables) -> DataFrame:
    """Listings with district, normal address and completeness."""
    return t.listings.withColumn("district", F.substring_index("postcode", " ", 1)).withColumn("normal", normal_a(F.col("address"))).withColumn("score", completeness())


@query(f"SELECT id, {NORMAL_A} AS normal FROM listings")
def dd_norm_addr_a(t: Tables) -> DataFrame:
    return t.listings.select("id", normal_a(F.col("address")).alias("normal"))


@query(r"""SELECT id, CASE WHEN regexp_matches(s, '\d+[-\d]*\s+[^,]+') THEN CONCAT(regexp_extract(s, '(\d+[-\d]*)\s+([^,]+)', 1), ' ', TRIM(regexp_extract(s, '(\d+[-\d]*)\s+([^,]+)', 2))) ELSE s END AS normal FROM
(SELECT id, REPLACE(REPLACE(REPLACE(REPLACE(regexp_replace(LOWER(address), '\s+(flat|apartment|apt|unit)\s*\d*', '', 'g'), ' street', ' st'), ' avenue', ' ave'), ' place', ' pl'), ' square', ' sq') AS s FROM
(SELECT id, REPLACE(address, ' Road', ' rd') AS address FROM listings) r) x""")
def dd_norm_addr_b(t: Tables) -> DataFrame:
    return t.listings.select("id", normal_b(F.col("address")).alias("normal"))


@query(f"SELECT id, {SCORE} AS score FROM listings")
def dd_completeness(t: Tables) -> DataFrame:
    return t.listings.select("id", completeness().alias("score"))


@query("""SELECT a, b FROM (SELECT x.id AS a, y.id AS b, POW(SIN(RADIANS(y.latitude - x.latitude) / 2), 2) + COS(RADIANS(x.latitude)) * COS(RADIANS(y.latitude)) * POW(SIN(RADIANS(y.longitude - x.longitude) / 2), 2) AS h
FROM listings x JOIN listings y ON x.bedrooms = y.bedrooms AND x.id < y.id AND ABS(x.price_pcm - y.price_pcm) / CAST(GREATEST(x.price_pcm, y.price_pcm) AS DOUBLE) <= 0.05 AND ABS(x.latitude - y.latitude) < 0.001
WHERE x.latitude <> 0 AND y.latitude <> 0) p WHERE 2 * 6371000 * ATAN2(SQRT(h), SQRT(1 - h)) <= 15""")
def dd_match_coords(t: Tables) -> DataFrame:
    return M.coordinate_pairs(t.listings)


@query(f"""SELECT a.id AS a, b.id AS b FROM (SELECT id, price_pcm, bedrooms, {NORMAL_A} AS s FROM listings) a JOIN (SELECT id, price_pcm, bedrooms, {NORMAL_A} AS s FROM listings) b
ON a.price_pcm = b.price_pcm AND a.bedrooms = b.bedrooms AND SUBSTR(a.s, 1, 25) = SUBSTR(b.s, 1, 25) AND LENGTH(a.s) >= 10 AND a.id < b.id""")
def dd_match_exact(t: Tables) -> DataFrame:
    return M.exact_pairs(prepared(t))


@query()
def dd_match_fuzzy(t: Tables) -> DataFrame:
    return M.fuzzy_pairs(prepared(t), "district")


@query()
def dd_group_greedy(t: Tables) -> DataFrame:
    """Per duplicate its group's canonical row (most complete, latest, first), reason and confidence."""
    rows = prepared(t)
    groups = M.lasting(M.greedy_groups(M.matches(rows, "district")))
    members = groups.select("leader", F.col("member").alias("id")).unionByName(groups.select("leader", F.col("leader").alias("id")).distinct())
    told = members.join(rows.select("id", "score", "last_seen", "price_pcm"), "id")
    best = told.groupBy("leader").agg(F.max_by("id", F.struct("score", "last_seen", -F.col("price_pcm"), -F.col("id"))).alias("canonical"))
    out = members.join(best, "leader").join(M.group_reasons(groups), "leader")
    return out.where("id <> canonical").select("canonical", F.col("id").alias("duplicate"), "reason", "confidence")


def by_address(t: Tables) -> DataFrame:
    """Listings as the search across sources takes them."""
    district = F.coalesce(F.nullif(F.regexp_extract(F.upper("postcode"), r"^([A-Z]{1,2}\d{1,2})", 1), F.lit("")), F.lit("UNKNOWN"))
    rows = t.listings.where("coalesce(address, '') <> '' or coalesce(postcode, '') <> ''")
    return rows.withColumn("district", district).withColumn("normal", normal_b(F.col("address")))


@query()
def dd_cross_pairs(t: Tables) -> DataFrame:
    return M.cross_pairs(by_address(t))


@query()
def dd_pair_stats(t: Tables) -> DataFrame:
    """Pairs of each two sources, and those of which just one row has a size."""
    pairs = M.cross_matches(by_address(t).withColumn("sized", F.coalesce("size_sqft", F.lit(0)) > 0), "sized")
    by = pairs.groupBy(F.least("source_a", "source_b").alias("source_1"), F.greatest("source_a", "source_b").alias("source_2"))
    return by.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("sized_a") != F.col("sized_b")).alias("fillable"))


@query()
def dd_merge_sqft(t: Tables) -> DataFrame:
    """Sizes for rows without one from their pairs across sources; of several partners the last by source and id."""
    pairs = M.cross_matches(by_address(t).withColumn("sized", F.coalesce("size_sqft", F.lit(0)) > 0), "size_sqft", unlike="sized")
    # Of each pair one row has a size, the other lacks one.
    pick = lambda s: F.when(F.col("sized_a"), F.col(f"{s}_a")).otherwise(F.col(f"{s}_b"))
    both = pairs.select(F.when(F.col("sized_a"), F.col("id_b")).otherwise(F.col("id_a")).alias("id"), pick("source").alias("source"), pick("id").alias("donor"), pick("size_sqft").alias("sqft"))
    return both.groupBy("id").agg(F.max_by("sqft", F.struct("source", "donor")).alias("sqft"))


@query()
def dd_components(t: Tables) -> DataFrame:
    return M.components(M.cross_pairs(by_address(t)))


@query()
def dd_canonical_b(t: Tables) -> DataFrame:
    """The row kept of each component: best source, then with a size, then the first."""
    rows = M.components(M.cross_pairs(by_address(t))).join(t.listings.select("id", "source", "size_sqft"), "id")
    score = priority(F.col("source")) * 10 + F.coalesce((F.col("size_sqft") > 0).cast("int"), F.lit(0))
    return rows.groupBy("root").agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("canonical"), F.count(F.lit(1)).alias("n"))


def rank() -> Column:
    return F.struct(F.col("score"), F.col("last_seen"), -F.col("id"))


def places(t: Tables) -> DataFrame:
    """Groups of more than one listing of a place: the best row's id, its fields, and what the others could give."""
    rows = fingerprinted(t).withColumn("score", completeness())
    own = [F.max_by(c, rank()).alias(c) for c in FIELDS]
    text = [F.max_by(c, F.when(F.col(c) != "", F.struct(F.length(c), -F.col("id")))).alias(f"best_{c}") for c in TEXTS]
    number = [F.min_by(c, F.when(F.col(c) != 0, F.col("id"))).alias(f"best_{c}") for c in NUMBERS]
    groups = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", rank()).alias("id"), *own, *number, *text).where("n > 1")
    blank = lambda c: F.coalesce(F.col(c) == ("" if c in TEXTS else 0), F.lit(True))
    return groups.select("id", "n", *[F.when(blank(c), F.col(f"best_{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS], *[(blank(c) & F.col(f"best_{c}").isNotNull()).cast("long").alias(f"gains_{c}") for c in FIELDS])


def best_sql(c: str) -> str:
    return f"FIRST({c} ORDER BY LENGTH({c}) DESC, id) FILTER (WHERE {c} <> '')" if c in TEXTS else f"FIRST({c} ORDER BY id) FILTER (WHERE {c} <> 0)"


def own_sql(c: str) -> str:
    return f"NULLIF(MAX({c}) FILTER (WHERE rn = 1), {chr(39) * 2 if c in TEXTS else 0})"


@query(f"SELECT MAX(id) FILTER (WHERE rn = 1) AS id, COUNT(*) AS n, {', '.join(f'COALESCE({own_sql(c)}, {best_sql(c)}) AS {c}' for c in FIELDS)} FROM {RANKED} r WHERE n > 1 GROUP BY k")
def dd_merge_fields(t: Tables) -> DataFrame:
    """The best row of each place, what it lacks taken from the others: the longest text, the first number."""
    return places(t).select("id", "n", *FIELDS)


@query("SELECT field, CAST(SUM(gain) AS BIGINT) AS gains FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CASE WHEN {own_sql(c)} IS NULL AND {best_sql(c)} IS NOT NULL THEN 1 ELSE 0 END AS gain FROM {RANKED} r WHERE n > 1 GROUP BY k" for c in FIELDS) + ") g GROUP BY 1")
def dd_merge_potential(t: Tables) -> DataFrame:
    sums = places(t).agg(*[F.coalesce(F.sum(f"gains_{c}"), F.lit(0)).alias(f"gains_{c}") for c in FIELDS])
    return sums.select(F.expr(f"stack({len(FIELDS)}, {', '.join(f'{chr(39)}{c}{chr(39)}, gains_{c}' for c in FIELDS)}) AS (field, gains)"))


@query(f"SELECT id FROM {RANKED} r WHERE rn = 1")
def dd_delete_groups(t: Tables) -> DataFrame:
    """What is left once each place's duplicates are deleted."""
    rows = fingerprinted(t).withColumn("score", completeness())
    best = rows.groupBy("fp").agg(F.max_by("id", rank()).alias("_best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = rows.join(best, "fp").where("id <> _best").select("id")
    return t.listings.select("id").join(gone, "id", "left_anti")


@query(f"""SELECT l.id, d.sqft FROM {RANKED} l JOIN (SELECT k, FIRST(size_sqft ORDER BY CASE WHEN source IN ('knightfrank', 'foxtons', 'chestertons') THEN 0 ELSE 1 END, CASE WHEN rn = 1 THEN 0 ELSE 1 END, id) AS sqft FROM {RANKED} r WHERE size_sqft > 0 AND n > 1 GROUP BY k) d
ON d.k = l.k WHERE COALESCE(l.size_sqft, 0) = 0""")
def dd_inherit_sqft(t: Tables) -> DataFrame:
    """Sizes that rows without one take from their place: the first agency's, else the first; the best row stands first."""
    rows = fingerprinted(t).withColumn("score", completeness())
    best = rows.groupBy("fp").agg(F.max_by("id", rank()).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(best, "fp")
    order = F.struct(~F.col("source").isin(*AGENCIES), F.col("id") != F.col("_best"), F.col("id"))
    donors = rows.where("size_sqft > 0").groupBy("fp").agg(F.min_by("size_sqft", order).alias("sqft"))
    return rows.where("coalesce(size_sqft, 0) = 0").join(donors, "fp").select("id", "sqft")
