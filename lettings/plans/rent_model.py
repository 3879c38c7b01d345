"""The rent model: rows to learn from, their features, boosted trees, their errors."""

from __future__ import annotations

import math

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import listing as X
from ..functions import places as P
from ..functions.floors import floor_flags
from ..operators.matching import lasting
from ..operators.nearest import nearest
from .catalogue import Tables, query

# Order of sources, their quality, premium agents, prime districts, numbers of types, amenities by their words, and parts of names that tell of the target.
SOURCE_ORDER = ("savills", "knightfrank", "chestertons", "foxtons", "rightmove")
SOURCE_QUALITY = {"savills": 4, "knightfrank": 4, "chestertons": 3, "foxtons": 2, "rightmove": 1, "johndwood": 3}
PREMIUM_AGENTS = ("Knight Frank", "Savills", "Harrods Estates", "Sotheby", "Beauchamp Estates", "Strutt & Parker", "Chestertons")
PRIME = ("SW1", "SW3", "SW7", "SW10", "W1", "W8", "W11", "NW3", "NW8")
TYPE_NUMBERS = {"studio": 0, "flat": 1, "apartment": 1, "maisonette": 2, "house": 3, "penthouse": 4}
AMENITY_WORDS = {
    "has_balcony": ("balcony",), "has_terrace": ("terrace",), "has_garden": ("garden",), "has_porter": ("porter", "concierge"), "has_gym": ("gym",), "has_pool": ("pool", "swimming"),
    "has_parking": ("parking", "garage"), "has_lift": ("lift", "elevator"), "has_ac": ("air con", "a/c", "aircon"), "has_high_ceilings": ("high ceiling",), "has_view": ("view",),
    "has_modern": ("modern", "contemporary"), "has_period": ("period", "victorian", "georgian"), "has_roof_terrace": ("roof terrace",),
}
LEAKY = ("luxury", "ppsf", "price", "_encoded", "is_luxury")
TOP_DISTRICTS, SEED = 15, 42
#: Rows of a partition that trees are learnt from.
PART_ROWS = 20_000

# As SQL: the same rules, for the oracles.
DISTRICT_SQL = "NULLIF(regexp_extract(postcode, '^([A-Z]+[0-9]+[A-Z]?)', 1), '')"
LET_SQL = "is_active = 1 AND size_sqft > 0 AND bedrooms IS NOT NULL AND price_pcm > 0 AND (price_period = 'pcm' OR price_period IS NULL OR price_period = '') AND (summary IS NULL OR NOT (summary ILIKE '%short let%' OR summary ILIKE '%short-let%'))"
SOUND_SQL = """size_sqft / CAST(CASE WHEN bedrooms = 0 THEN 0.5 ELSE bedrooms END AS DOUBLE) >= 70 AND price_pcm BETWEEN 500 AND 100000 AND size_sqft BETWEEN 150 AND 10000 AND CAST(price_pcm AS DOUBLE) / size_sqft BETWEEN 3 AND 30"""
ORDER_SQL = "CASE source WHEN 'savills' THEN 0 WHEN 'knightfrank' THEN 1 WHEN 'chestertons' THEN 2 WHEN 'foxtons' THEN 3 WHEN 'rightmove' THEN 4 ELSE 5 END"
LOADED = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY price_pcm, size_sqft, bedrooms, {DISTRICT_SQL} ORDER BY {ORDER_SQL}, id) AS rn FROM listings WHERE {LET_SQL} AND {SOUND_SQL}) s WHERE rn = 1)"


def either(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def mapped(c: Column, values: dict[str, int], other: int) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in values.items()], F.lit(other))


def loaded(t: Tables) -> DataFrame:
    """Rows to learn from: let for long by the month, active and sound; of equal price, size, bedrooms and district that of the best source, then the least id."""
    rows = t.listings
    text = F.coalesce(F.lower("summary"), F.lit(""))
    let = (F.col("is_active") == 1) & (F.col("size_sqft") > 0) & F.col("bedrooms").isNotNull() & (F.col("price_pcm") > 0) & F.coalesce(F.col("price_period").isin("pcm", ""), F.lit(True)) & ~either(text, ("short let", "short-let"))
    sound = rows.where(let & X.sound({c: F.col(c) for c in rows.columns}))
    rank = mapped(F.col("source"), {s: i for i, s in enumerate(SOURCE_ORDER)}, len(SOURCE_ORDER))
    best = F.min_by(F.struct(*rows.columns), F.struct(rank, "id")).alias("row")
    district = F.nullif(F.regexp_extract("postcode", r"^([A-Z]+\d+[A-Z]?)", 1), F.lit(""))
    return sound.groupBy("price_pcm", "size_sqft", "bedrooms", district.alias("district")).agg(best).select("row.*", "district")


def leaky(names: list[str]) -> list[str]:
    """The names of features that tell of the target."""
    return [n for n in names if any(part in n.lower() for part in LEAKY)]


def features(rows: DataFrame) -> DataFrame:
    """``id``, ``price_pcm`` and the features of every loaded row, none learnt from prices.

    What the whole table tells (medians, size quintiles, shares of districts and areas) is one row, or
    one a district, broadcast: as many as there are outward codes.
    """
    district = F.coalesce("district", F.lit("SW3"))
    text = F.lower(F.coalesce("summary", F.lit("")))
    lat, lon = P.filled(F.col("latitude"), F.col("longitude"), district)
    flags = {n: either(text, w).cast("int") for n, w in AMENITY_WORDS.items()}
    flags["has_terrace"] = (F.contains(text, F.lit("terrace")) & ~F.contains(text, F.lit("roof terrace"))).cast("int")
    flags["has_furnished"] = F.lit(0)
    rows = rows.select("id", "price_pcm", "bedrooms", F.coalesce("bathrooms", F.lit(1)).alias("bathrooms"), "size_sqft", "source", district.alias("district"),
        F.coalesce(F.nullif(F.regexp_extract(district, "^([A-Z]+)", 1), F.lit("")), F.lit("SW")).alias("area"), F.lower(F.coalesce("property_type", F.lit("flat"))).alias("kind"), X.let_type(F.col("summary")).alias("let"),
        F.coalesce(F.lower("agent_name"), F.lit("")).alias("agent"), P.station_km(lat, lon).alias("tube"), P.city_km(lat, lon).alias("city"), *[c.alias(n) for n, c in {**flags, **floor_flags(text)}.items()])
    quintiles = F.percentile("size_sqft", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8))))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), quintiles.alias("edges"), F.percentile("tube", 0.5).alias("mid_tube"), F.percentile("city", 0.5).alias("mid_city"))
    districts = rows.groupBy("district").agg(F.count(F.lit(1)).alias("n_district"))
    areas = rows.groupBy("area").agg(F.count(F.lit(1)).alias("n_area"))
    rows = rows.join(F.broadcast(districts), "district").join(F.broadcast(areas), "area").crossJoin(F.broadcast(whole))
    c = F.col
    steps: list[dict[str, Column]] = [
        {"beds": F.when(c("bedrooms") == 0, 0.5).otherwise(c("bedrooms")), "tube_distance_km": F.coalesce("tube", "mid_tube"), "center_distance_km": F.coalesce("city", "mid_city"),
         "is_prime_postcode": sum((F.startswith("district", F.lit(p)).cast("int") for p in PRIME[1:]), F.startswith("district", F.lit(PRIME[0])).cast("int")).cast("boolean").cast("int"),
         "is_premium_agent": either(c("agent"), tuple(a.lower() for a in PREMIUM_AGENTS)).cast("int"), "source_quality": mapped(c("source"), SOURCE_QUALITY, 2), "property_type_num": mapped(c("kind"), TYPE_NUMBERS, 1),
         "is_short_let": (c("let") == "short").cast("int"), "is_long_let": (c("let") == "long").cast("int"), "log_sqft": F.log1p("size_sqft"), "sqrt_sqft": F.sqrt("size_sqft"), "size_squared": c("size_sqft") * c("size_sqft") / 100000,
         "beds_squared": c("bedrooms") * c("bedrooms"), "size_bin": F.aggregate("edges", F.lit(0), lambda n, edge: n + (c("size_sqft") > edge).cast("int")), "is_multi_floor": (c("floor_count") >= 2).cast("int"),
         "floor_size_interaction": c("floor_count") * c("size_sqft") / 1000, "amenity_score": sum((c(n) for n in flags), F.lit(0)), "luxury_amenity_score": c("has_pool") + c("has_porter") + c("has_gym") + c("has_ac"),
         "has_outdoor_space": F.greatest("has_balcony", "has_terrace", "has_garden", "has_roof_terrace"), "postcode_freq": c("n_district") / c("n"), "postcode_area_freq": c("n_area") / c("n"), "bed_bath_interaction": c("bedrooms") * c("bathrooms")},
        {"size_per_bed": c("size_sqft") / c("beds"), "bath_ratio": c("bathrooms") / c("beds"), "log_center_distance": F.log1p("center_distance_km"), "log_tube_distance": F.log1p("tube_distance_km"),
         "center_distance_inv": 1 / (1 + c("center_distance_km")), "size_x_prime": c("size_sqft") * c("is_prime_postcode") / 1000, "outdoor_x_prime": c("has_outdoor_space") * c("is_prime_postcode"),
         "premium_agent_size": c("is_premium_agent") * c("log_sqft"), "short_let_size": c("is_short_let") * c("log_sqft")},
        {"size_x_central": c("size_sqft") * c("center_distance_inv") / 100, "beds_x_central": c("bedrooms") * c("center_distance_inv"), "amenity_x_central": c("amenity_score") * c("center_distance_inv"), "short_let_x_central": c("is_short_let") * c("center_distance_inv")},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.select("id", "price_pcm", *NAMES)


#: Names of the features, in the order of a model's vector.
NAMES = (
    "bedrooms", "bathrooms", "size_sqft", "size_per_bed", "bath_ratio", "bed_bath_interaction", "log_sqft", "sqrt_sqft", "size_squared", "beds_squared", "size_bin",
    "tube_distance_km", "log_tube_distance", "center_distance_km", "log_center_distance", "center_distance_inv", "is_prime_postcode", "postcode_freq", "postcode_area_freq",
    "size_x_central", "size_x_prime", "beds_x_central", "floor_count", "is_multi_floor", "floor_size_interaction", "has_basement", "has_ground", "has_first_floor", "has_second_floor", "has_third_floor", "has_fourth_plus",
    "is_premium_agent", "premium_agent_size", "source_quality", "amenity_score", "luxury_amenity_score", "has_outdoor_space", "amenity_x_central", "outdoor_x_prime",
    "is_short_let", "is_long_let", "short_let_x_central", "short_let_size", "property_type_num",
    "has_balcony", "has_terrace", "has_garden", "has_porter", "has_gym", "has_pool", "has_parking", "has_lift", "has_ac", "has_furnished", "has_high_ceilings", "has_view", "has_modern", "has_period", "has_roof_terrace",
)
#: Types that have an indicator of their own; the rest are ``other``.
KINDS = (*TYPE_NUMBERS, "other")


def indicators(rows: DataFrame) -> DataFrame:
    """``id`` and 0 or 1 for each type and for each of the 15 districts with most rows, by rank (ties by name)."""
    rows = rows.select("id", F.coalesce("district", F.lit("SW3")).alias("district"), F.lower(F.coalesce("property_type", F.lit("flat"))).alias("kind"))
    top = rows.groupBy("district").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "district").limit(TOP_DISTRICTS)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "district"))).select("district", "rank")  # fifteen rows
    kind = F.when(F.col("kind").isin(*TYPE_NUMBERS), F.col("kind")).otherwise("other")
    types = [(kind == k).cast("int").alias(f"type_{k}") for k in KINDS]
    return rows.join(F.broadcast(ranked), "district", "left").select("id", *types, *[F.coalesce(F.col("rank") == i, F.lit(False)).cast("int").alias(f"district_{i}") for i in range(1, TOP_DISTRICTS + 1)])


def fold(n: int) -> Column:
    """A fold by a hash of the id, the same wherever it is computed."""
    return F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)).cast("int")


def vectors(t: Tables, folds: int) -> tuple[DataFrame, list[str]]:
    """Rows with ``features`` (a vector), ``target`` (log of 1 + price) and ``fold``, written once; and the names in the vector. Rows stand in order of id, so that a run can be repeated."""
    rows = lasting(loaded(t))
    wide = features(rows).join(indicators(rows), "id")
    names = [c for c in wide.columns if c not in ("id", "price_pcm")]
    made = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(wide.na.fill(0.0))
    made = made.select("id", "price_pcm", "features", F.log1p("price_pcm").alias("target"), fold(folds).alias("fold"))
    parts = rows.count() // PART_ROWS + 1
    return lasting(made.repartitionByRange(parts, "id").sortWithinPartitions("id")), names


def trees(iterations: int = 10, depth: int = 5, step: float = 0.1) -> GBTRegressor:
    """Boosted trees that learn the absolute error of the logarithm."""
    return GBTRegressor(labelCol="target", predictionCol="log_predicted", lossType="absolute", maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=5, seed=SEED)


def pooled(t: Tables, folds: int = 5, model: GBTRegressor | None = None) -> DataFrame:
    """``id``, ``fold``, ``price_pcm`` and ``predicted`` of every loaded row, by the model that was learnt from the other folds."""
    rows, _ = vectors(t, folds)
    parts = []
    for k in range(folds):
        learnt = (model or trees()).fit(rows.where(F.col("fold") != k))
        parts.append(learnt.transform(rows.where(F.col("fold") == k)).select("id", "fold", "price_pcm", F.expm1("log_predicted").alias("predicted")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def errors(rows: DataFrame) -> list[Column]:
    """Number of rows, and errors of ``predicted`` against ``price_pcm``, as aggregates."""
    gap = F.abs(F.col("predicted") - F.col("price_pcm"))
    # The mean of squares about the mean, from the population's variance.
    r2 = 1 - F.avg(gap * gap) / F.nullif(F.var_pop("price_pcm"), F.lit(0.0))
    return [F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), r2.alias("r2"), (F.avg(gap / F.col("price_pcm")) * 100).alias("mape"), (F.percentile(gap / F.col("price_pcm"), 0.5) * 100).alias("median_ape")]


@query(f"SELECT id, source, price_pcm, size_sqft FROM {LOADED} m")
def ml_load(t: Tables) -> DataFrame:
    return loaded(t).select("id", "source", "price_pcm", "size_sqft")


@query(f"SELECT id, LN(1 + price_pcm) AS target, EXP(LN(1 + price_pcm)) - 1 AS price FROM {LOADED} m")
def ml_target_log(t: Tables) -> DataFrame:
    target = F.log1p("price_pcm")
    return loaded(t).select("id", target.alias("target"), F.expm1(target).alias("price"))


def _distance_sql(lat: str, lon: str, at: tuple[float, float]) -> str:
    a = f"POWER(SIN(RADIANS({at[0]} - {lat}) / 2), 2) + COS(RADIANS({lat})) * COS(RADIANS({at[0]})) * POWER(SIN(RADIANS({at[1]} - {lon}) / 2), 2)"
    return f"CASE WHEN {lat} <> 0 AND {lon} <> 0 THEN 12742 * ASIN(SQRT({a})) END"


def _features_sql() -> str:
    low = "LOWER(COALESCE(summary, ''))"
    has = lambda *words: " OR ".join(f"CONTAINS({low}, '{w}')" for w in words)
    flags = {n: f"CAST(({has(*w)}) AS INT)" for n, w in AMENITY_WORDS.items()}
    flags["has_terrace"] = f"CAST((CONTAINS({low}, 'terrace') AND NOT CONTAINS({low}, 'roof terrace')) AS INT)"
    flags["has_furnished"] = "0"
    centre = lambda i: f"CASE WHEN COALESCE(latitude, 0) = 0 THEN COALESCE(CASE {' '.join(f"WHEN dist = '{k}' THEN {v[i]}" for k, v in P.CENTROIDS.items())} END, CASE {' '.join(f"WHEN STARTS_WITH(dist, '{k}') THEN {v[i]}" for k, v in P.CENTROIDS.items())} END, {('latitude', 'longitude')[i]}) ELSE {('latitude', 'longitude')[i]} END"
    stations = ", ".join(_distance_sql("lat", "lon", at) for at in P.STATIONS.values())
    floors = {"has_basement": "basement|lower\\s*ground", "has_ground": "(^|[^r]|[^e]r|[^w]er|[^o]wer) ?ground floor", "has_first_floor": "first floor|1st floor", "has_second_floor": "second floor|2nd floor", "has_third_floor": "third floor|3rd floor", "has_fourth_plus": "(fourth|fifth|sixth|seventh|eighth|ninth|tenth) floor|([4-9]|1[0-9])th floor"}
    return f"""WITH a AS (SELECT *, COALESCE({DISTRICT_SQL}, 'SW3') AS dist FROM {LOADED} m),
b AS (SELECT *, {centre(0)} AS lat, {centre(1)} AS lon, regexp_extract(dist, '^([A-Z]+)', 1) AS area, LOWER(COALESCE(property_type, 'flat')) AS kind, LOWER(COALESCE(agent_name, '')) AS agent, {', '.join(f'{s} AS {n}' for n, s in flags.items())},
  {', '.join(f"CAST(regexp_matches({low}, '{p}') AS INT) AS {n}" for n, p in floors.items())} FROM a),
c AS (SELECT *, LEAST({stations}) AS tube, {_distance_sql('lat', 'lon', P.CITY)} AS city, has_basement + has_ground + has_first_floor + has_second_floor + has_third_floor + has_fourth_plus AS floor_count FROM b),
w AS (SELECT COUNT(*) AS n, QUANTILE_CONT(size_sqft, [0.2, 0.4, 0.6, 0.8]) AS edges, MEDIAN(tube) AS mid_tube, MEDIAN(city) AS mid_city FROM c),
d AS (SELECT c.* EXCLUDE (bathrooms), COALESCE(bathrooms, 1) AS bathrooms, CASE WHEN bedrooms = 0 THEN 0.5 ELSE bedrooms END AS beds, COALESCE(tube, mid_tube) AS tube_distance_km, COALESCE(city, mid_city) AS center_distance_km,
  CAST(({' OR '.join(f"STARTS_WITH(dist, '{p}')" for p in PRIME)}) AS INT) AS prime, CAST(({' OR '.join(f"CONTAINS(agent, '{a.lower()}')" for a in PREMIUM_AGENTS)}) AS INT) AS premium,
  has_balcony + has_terrace + has_garden + has_porter + has_gym + has_pool + has_parking + has_lift + has_ac + has_furnished + has_high_ceilings + has_view + has_modern + has_period + has_roof_terrace AS score,
  CASE WHEN CONTAINS({low}, 'short') THEN 'short' WHEN CONTAINS({low}, 'long') THEN 'long' ELSE 'unknown' END AS let, w.n AS total, edges, COUNT(*) OVER (PARTITION BY dist) AS nd, COUNT(*) OVER (PARTITION BY area) AS na FROM c CROSS JOIN w)
SELECT id, price_pcm, bedrooms, bathrooms, size_sqft, size_sqft / CAST(beds AS DOUBLE) AS size_per_bed, bathrooms / CAST(beds AS DOUBLE) AS bath_ratio, bedrooms * bathrooms AS bed_bath_interaction, LN(1 + size_sqft) AS log_sqft, SQRT(size_sqft) AS sqrt_sqft,
  CAST(size_sqft * size_sqft AS DOUBLE) / 100000 AS size_squared, bedrooms * bedrooms AS beds_squared, CAST(size_sqft > edges[1] AS INT) + CAST(size_sqft > edges[2] AS INT) + CAST(size_sqft > edges[3] AS INT) + CAST(size_sqft > edges[4] AS INT) AS size_bin,
  tube_distance_km, LN(1 + tube_distance_km) AS log_tube_distance, center_distance_km, LN(1 + center_distance_km) AS log_center_distance, 1 / (1 + center_distance_km) AS center_distance_inv, prime AS is_prime_postcode, CAST(nd AS DOUBLE) / total AS postcode_freq, CAST(na AS DOUBLE) / total AS postcode_area_freq,
  size_sqft / (1 + center_distance_km) / 100 AS size_x_central, CAST(size_sqft * prime AS DOUBLE) / 1000 AS size_x_prime, bedrooms / (1 + center_distance_km) AS beds_x_central, floor_count, CAST(floor_count >= 2 AS INT) AS is_multi_floor, CAST(floor_count * size_sqft AS DOUBLE) / 1000 AS floor_size_interaction,
  has_basement, has_ground, has_first_floor, has_second_floor, has_third_floor, has_fourth_plus, premium AS is_premium_agent, premium * LN(1 + size_sqft) AS premium_agent_size, CASE source WHEN 'savills' THEN 4 WHEN 'knightfrank' THEN 4 WHEN 'chestertons' THEN 3 WHEN 'foxtons' THEN 2 WHEN 'rightmove' THEN 1 ELSE 2 END AS source_quality,
  score AS amenity_score, has_pool + has_porter + has_gym + has_ac AS luxury_amenity_score, GREATEST(has_balcony, has_terrace, has_garden, has_roof_terrace) AS has_outdoor_space, score / (1 + center_distance_km) AS amenity_x_central, GREATEST(has_balcony, has_terrace, has_garden, has_roof_terrace) * prime AS outdoor_x_prime,
  CAST(let = 'short' AS INT) AS is_short_let, CAST(let = 'long' AS INT) AS is_long_let, CAST(let = 'short' AS INT) / (1 + center_distance_km) AS short_let_x_central, CAST(let = 'short' AS INT) * LN(1 + size_sqft) AS short_let_size,
  CASE kind WHEN 'studio' THEN 0 WHEN 'maisonette' THEN 2 WHEN 'house' THEN 3 WHEN 'penthouse' THEN 4 ELSE 1 END AS property_type_num, {', '.join(NAMES[-15:])} FROM d"""


@query(_features_sql())
def ml_features_v15(t: Tables) -> DataFrame:
    return features(loaded(t))


@query(f"""WITH m AS (SELECT id, COALESCE({DISTRICT_SQL}, 'SW3') AS dist, LOWER(COALESCE(property_type, 'flat')) AS kind FROM {LOADED} x), r AS (SELECT dist, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, dist) AS rank FROM m GROUP BY 1)
SELECT id, {', '.join(f"CAST(kind = '{k}' AS INT) AS type_{k}" for k in TYPE_NUMBERS)}, CAST(kind NOT IN ({', '.join(f"'{k}'" for k in TYPE_NUMBERS)}) AS INT) AS type_other, {', '.join(f'CAST(rank = {i} AS INT) AS district_{i}' for i in range(1, TOP_DISTRICTS + 1))} FROM m JOIN r USING (dist)""")
def ml_onehot(t: Tables) -> DataFrame:
    return indicators(loaded(t))


#: Amenities of the narrower table.
NARROW = ("has_balcony", "has_garden", "has_porter", "has_gym", "has_parking", "has_lift")


def narrow_features(rows: DataFrame) -> DataFrame:
    """The narrower table: 21 features and an indicator for each of the 15 districts (letters and figures alone) with most rows, by rank. Distances without coordinates stay null, as trees take them."""
    text, agent = F.lower(F.coalesce("summary", F.lit(""))), F.lower(F.coalesce("agent_name", F.lit("")))
    district = F.nullif(F.regexp_extract("postcode", r"^([A-Z]+\d+)", 1), F.lit(""))
    floors = floor_flags(text)
    made = {
        "outer": district, "sqft_per_bedroom": F.col("size_sqft") / F.greatest(F.col("bedrooms"), F.lit(1)), "is_prime": F.coalesce(district.isin(*PRIME), F.lit(False)).cast("int"), "is_premium_agent": either(agent, tuple(a.lower() for a in PREMIUM_AGENTS)).cast("int"),
        "dist_to_center": P.city_km(F.col("latitude"), F.col("longitude")), "dist_to_tube": P.station_km(F.col("latitude"), F.col("longitude")), "has_terrace": F.contains(text, F.lit("terrace")).cast("int"), "has_roof_terrace": F.contains(text, F.lit("roof terrace")).cast("int"),
        **{n: either(text, AMENITY_WORDS[n]).cast("int") for n in NARROW}, **{n: floors[n] for n in ("floor_count", "has_ground", "has_first_floor", "has_second_floor", "has_basement")},
    }
    rows = rows.withColumns(made)
    top = rows.where("outer is not null").groupBy("outer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outer").limit(TOP_DISTRICTS)
    ranked = top.select("outer", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "outer")).alias("rank"))  # fifteen rows
    tops = [F.coalesce(F.col("rank") == i, F.lit(False)).cast("int").alias(f"district_{i}") for i in range(1, TOP_DISTRICTS + 1)]
    return rows.join(F.broadcast(ranked), "outer", "left").select("id", "price_pcm", "bedrooms", "bathrooms", "size_sqft", *[n for n in made if n != "outer"], *tops)


def _narrow_sql() -> str:
    low = "LOWER(COALESCE(summary, ''))"
    has = lambda words: f"CAST(({' OR '.join(f"CONTAINS({low}, '{w}')" for w in words)}) AS INT)"
    floors = {"has_basement": "basement|lower\\s*ground", "has_ground": "(^|[^r]|[^e]r|[^w]er|[^o]wer) ?ground floor", "has_first_floor": "first floor|1st floor", "has_second_floor": "second floor|2nd floor", "_third": "third floor|3rd floor", "_fourth": "(fourth|fifth|sixth|seventh|eighth|ninth|tenth) floor|([4-9]|1[0-9])th floor"}
    stations = ", ".join(_distance_sql("latitude", "longitude", at) for at in P.STATIONS.values())
    return f"""WITH a AS (SELECT *, NULLIF(regexp_extract(postcode, '^([A-Z]+[0-9]+)', 1), '') AS outcode, {', '.join(f"CAST(regexp_matches({low}, '{p}') AS INT) AS {n}" for n, p in floors.items())} FROM {LOADED} m), r AS (SELECT outcode, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, outcode) AS rank FROM a WHERE outcode IS NOT NULL GROUP BY 1)
SELECT id, price_pcm, bedrooms, bathrooms, size_sqft, CAST(size_sqft AS DOUBLE) / GREATEST(bedrooms, 1) AS sqft_per_bedroom, CAST(COALESCE(a.outcode IN {PRIME}, FALSE) AS INT) AS is_prime, CAST(({' OR '.join(f"CONTAINS(LOWER(COALESCE(agent_name, '')), '{x.lower()}')" for x in PREMIUM_AGENTS)}) AS INT) AS is_premium_agent,
  {_distance_sql('latitude', 'longitude', P.CITY)} AS dist_to_center, LEAST({stations}) AS dist_to_tube, {has(('terrace',))} AS has_terrace, {has(('roof terrace',))} AS has_roof_terrace, {', '.join(f'{has(AMENITY_WORDS[n])} AS {n}' for n in NARROW)}, has_basement + has_ground + has_first_floor + has_second_floor + _third + _fourth AS floor_count,
  has_ground, has_first_floor, has_second_floor, has_basement, {', '.join(f'CAST(COALESCE(rank = {i}, FALSE) AS INT) AS district_{i}' for i in range(1, TOP_DISTRICTS + 1))} FROM a LEFT JOIN r ON r.outcode = a.outcode"""


@query(_narrow_sql())
def ml_features_pg(t: Tables) -> DataFrame:
    return narrow_features(loaded(t))


@query(f"""SELECT id, name, km FROM (SELECT l.id, s.name, {_distance_sql('l.latitude', 'l.longitude', ('s.lat', 's.lon'))} AS km, ROW_NUMBER() OVER (PARTITION BY l.id ORDER BY {_distance_sql('l.latitude', 'l.longitude', ('s.lat', 's.lon'))}, s.name) AS rn
FROM listings l CROSS JOIN (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in P.STATIONS.items())}) s(name, lat, lon) WHERE l.latitude <> 0 AND l.longitude <> 0) x WHERE rn = 1""")
def jn_nearest(t: Tables) -> DataFrame:
    """The nearest station of every listing that has coordinates."""
    stations = t.spark.createDataFrame([(n, *at) for n, at in P.STATIONS.items()], "name string, lat double, lon double")
    return nearest(t.listings.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), stations)


@query(f"""SELECT id, CASE WHEN latitude <> 0 THEN latitude ELSE COALESCE({', '.join(f"CASE WHEN o = '{k}' THEN {v[0]} END" for k, v in P.CENTROIDS.items())}, {', '.join(f"CASE WHEN STARTS_WITH(o, '{k}') THEN {v[0]} END" for k, v in P.CENTROIDS.items())}, latitude) END AS lat,
CASE WHEN latitude <> 0 THEN longitude ELSE COALESCE({', '.join(f"CASE WHEN o = '{k}' THEN {v[1]} END" for k, v in P.CENTROIDS.items())}, {', '.join(f"CASE WHEN STARTS_WITH(o, '{k}') THEN {v[1]} END" for k, v in P.CENTROIDS.items())}, longitude) END AS lon FROM (SELECT *, SPLIT_PART(postcode, ' ', 1) AS o FROM listings) x""")
def fn_centroid_fill(t: Tables) -> DataFrame:
    lat, lon = P.filled(F.col("latitude"), F.col("longitude"), A.outcode(F.col("postcode")))
    return t.listings.select("id", lat.alias("lat"), lon.alias("lon"))


@query()
def ml_xgb(t: Tables) -> DataFrame:
    """Out-of-fold predictions of boosted trees, pooled."""
    return pooled(t)


@query()
def ml_model_metrics(t: Tables) -> DataFrame:
    """Errors of the pooled predictions, of all rows and by price tier."""
    rows = lasting(pooled(t))
    tier = F.when(F.col("price_pcm") < 100000, X.ladder(F.col("price_pcm"), ((3000, "0-3k"), (5000, "3-5k"), (10000, "5-10k"), (20000, "10-20k")), "20-100k"))
    return rows.agg(*errors(rows)).withColumn("tier", F.lit("all")).unionByName(rows.groupBy(tier.alias("tier")).agg(*errors(rows)))


@query()
def ml_tune(t: Tables) -> DataFrame:
    """Settings of the trees by their mean R2 of the logarithm over three folds, best first."""
    rows, _ = vectors(t, 3)
    model = trees(iterations=5)
    grid = ParamGridBuilder().addGrid(model.maxDepth, [4, 6]).addGrid(model.stepSize, [0.1, 0.3]).build()
    scorer = RegressionEvaluator(labelCol="target", predictionCol="log_predicted", metricName="r2")
    found = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=scorer, numFolds=3, foldCol="fold", parallelism=2).fit(rows)
    settings = [(g[model.maxDepth], g[model.stepSize], float(score)) for g, score in zip(grid, found.avgMetrics, strict=True) if not math.isnan(score)]
    ranked = sorted(settings, key=lambda s: (-s[2], s[:2]))
    return t.spark.createDataFrame([(i, *s) for i, s in enumerate(ranked, 1)], "rank int, depth int, step double, r2 double")


@query()
def ml_importance(t: Tables) -> DataFrame:
    """The 25 features that the trees, learnt from all rows, use most."""
    rows, names = vectors(t, 5)
    weights = trees().fit(rows).featureImportances.toArray().tolist()
    top = sorted(zip(names, weights, strict=True), key=lambda x: (-x[1], x[0]))[:25]
    return t.spark.createDataFrame([(i, n, w, n in leaky(names)) for i, (n, w) in enumerate(top, 1)], "rank int, feature string, importance double, leaky boolean")
