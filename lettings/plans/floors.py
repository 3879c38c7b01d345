"""What a home's floor is worth: floors told by texts, rents by floor, and a regression with size and district."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.floors import ORDINALS, floor_info
from ..operators.matching import lasting
from .catalogue import Tables, query

TEXT = "LOWER(CONCAT(COALESCE(summary, ''), ' ', COALESCE(address, '')))"
has = lambda pattern: f"regexp_matches(x, '{pattern}')"
#: As SQL: the rules one after the other, each step of which may override fields of the one before.
INFO = f"""(SELECT *, COALESCE(cat, CASE WHEN floor_level < 0 THEN 'basement' WHEN floor_level = 0 THEN 'ground' WHEN floor_level <= 2 THEN 'lower' WHEN floor_level <= 5 THEN 'mid' WHEN floor_level IS NOT NULL THEN 'high' END) AS floor_category,
  GREATEST(COALESCE(CASE counted WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 ELSE TRY_CAST(counted AS INT) END, 1), CASE WHEN CONTAINS(x, 'triplex') THEN 3 WHEN CONTAINS(x, 'maisonette') OR CONTAINS(x, 'duplex') THEN 2 ELSE 1 END) AS num_floors_span,
  counted IS NOT NULL OR CONTAINS(x, 'maisonette') OR CONTAINS(x, 'duplex') OR CONTAINS(x, 'triplex') AS is_multi_floor,
  CASE WHEN ordinal IS NOT NULL OR number IS NOT NULL THEN 'high' WHEN is_top_floor THEN 'medium' WHEN cat IS NOT NULL THEN 'high' ELSE 'none' END AS floor_confidence
FROM (SELECT *, COALESCE(number, word_level) AS floor_level FROM (SELECT *, CASE WHEN word_level IS NULL OR cat IS NULL THEN COALESCE(TRY_CAST(regexp_extract(x, '\\b(\\d+)(?:st|nd|rd|th)?\\s*floor\\b', 1) AS DOUBLE), TRY_CAST(regexp_extract(x, '\\bfloor\\s*(\\d+)\\b', 1) AS DOUBLE)) END AS number
FROM (SELECT *, COALESCE(ordinal, CASE WHEN is_ground THEN 0 WHEN is_lower_ground THEN -0.5 WHEN is_basement THEN -1 END) AS word_level, CASE WHEN is_top_floor THEN 'top_floor' WHEN is_ground THEN 'ground' WHEN is_lower_ground THEN 'lower_ground' WHEN is_basement THEN 'basement' WHEN is_penthouse THEN 'penthouse' END AS cat
FROM (SELECT *, {has('\\bpenthouse\\b')} AS is_penthouse, {has('\\bbasement\\b')} AS is_basement, {has('\\blower ground\\b')} AS is_lower_ground, {has('\\bground floor\\b')} AS is_ground, {has('\\btop floor\\b')} AS is_top_floor,
  CASE WHEN {has('\\b(lift|elevator)\\b')} THEN TRUE WHEN {has('\\bno lift\\b|walk[- ]?up\\b')} THEN FALSE END AS has_lift, CAST(CASE {' '.join(f"WHEN {has(f'\\b{w}\\s+floor\\b')} THEN {i}" for i, w in enumerate(ORDINALS, 1))} END AS DOUBLE) AS ordinal,
  NULLIF(regexp_extract(x, '\\b(two|three|four|five|2|3|4|5)\\s+floors?\\b', 1), '') AS counted FROM (SELECT *, {TEXT} AS x FROM listings WHERE price_pcm > 0) l) a) b) c) d)"""
FIELDS = ("floor_level", "floor_category", "is_multi_floor", "num_floors_span", "has_lift", "is_penthouse", "is_basement", "is_lower_ground", "is_ground", "is_top_floor", "floor_confidence")
SPECIAL = {"penthouse": "is_penthouse", "basement": "is_basement", "lower_ground": "is_lower_ground", "ground": "is_ground", "top_floor": "is_top_floor"}
#: Fewest rows of a line of the report, by section.
FEWEST = {"category": 5, "level": 3, "lift": 1, "floors": 1, "span": 5, "special": 3}
SHOWN = " OR ".join(f"section = '{s}' AND n >= {n}" for s, n in FEWEST.items()) + " OR label = 'unknown'"


def told(t: Tables) -> DataFrame:
    """Listings with a price and what their texts tell of the floor."""
    text = F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("address", F.lit("")))
    return t.listings.where("price_pcm > 0").withColumns(floor_info(text))


@query(f"SELECT id, {', '.join(FIELDS)} FROM {INFO} i")
def tx_floor_info(t: Tables) -> DataFrame:
    return told(t).select("id", *FIELDS)


@query(f"""WITH f AS (SELECT *, CAST(price_pcm AS DOUBLE) / size_sqft AS ppsf FROM {INFO} i WHERE size_sqft > 0 AND CAST(price_pcm AS DOUBLE) / size_sqft < 20),
u AS (SELECT 'category' AS section, COALESCE(floor_category, 'unknown') AS label, * FROM f UNION ALL SELECT 'level', CAST(CAST(TRUNC(floor_level) AS INT) AS VARCHAR), * FROM f WHERE floor_level IS NOT NULL UNION ALL SELECT 'lift', CASE WHEN has_lift THEN 'with' ELSE 'without' END, * FROM f WHERE has_lift IS NOT NULL
UNION ALL SELECT 'floors', CASE WHEN is_multi_floor THEN 'several' ELSE 'one' END, * FROM f UNION ALL SELECT 'span', CAST(num_floors_span AS VARCHAR), * FROM f WHERE num_floors_span BETWEEN 2 AND 5 {' '.join(f"UNION ALL SELECT 'special', '{k}', * FROM f WHERE {v}" for k, v in SPECIAL.items())})
SELECT section, label, COUNT(*) AS n, MEDIAN(price_pcm) AS median_price, MEDIAN(size_sqft) AS median_sqft, MEDIAN(ppsf) AS median_ppsf, 100 * (MEDIAN(ppsf) / (SELECT MEDIAN(ppsf) FROM f) - 1) AS above_all, AVG(floor_level) AS mean_level FROM u GROUP BY 1, 2 HAVING {SHOWN}""")
def r_floor_impact(t: Tables) -> DataFrame:
    """Rents by category, level, lift, single or several floors, number of floors and special floors, against the median of all.

    Each listing is counted under all that hold for it in one aggregate; the median of all is one row.
    """
    rows = told(t).where("size_sqft > 0").withColumn("ppsf", F.col("price_pcm") / F.col("size_sqft")).where("ppsf < 20")
    c, line = F.col, lambda section, label: F.struct(F.lit(section).alias("section"), label.alias("label"))
    lines = [
        line("category", F.coalesce("floor_category", F.lit("unknown"))), F.when(c("floor_level").isNotNull(), line("level", c("floor_level").cast("int").cast("string"))),
        F.when(c("has_lift").isNotNull(), line("lift", F.when(c("has_lift"), "with").otherwise("without"))), line("floors", F.when(c("is_multi_floor"), "several").otherwise("one")),
        F.when(c("num_floors_span").between(2, 5), line("span", c("num_floors_span").cast("string"))), *[F.when(c(v), line("special", F.lit(k))) for k, v in SPECIAL.items()],
    ]
    under = rows.select("price_pcm", "size_sqft", "ppsf", "floor_level", F.inline(F.array_compact(F.array(*lines))))
    middle = lambda name: F.percentile(name, 0.5)
    by = under.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"), middle("price_pcm").alias("median_price"), middle("size_sqft").alias("median_sqft"), middle("ppsf").alias("median_ppsf"), F.avg("floor_level").alias("mean_level"))
    by = by.where(SHOWN).crossJoin(F.broadcast(rows.agg(middle("ppsf").alias("whole"))))
    return by.withColumn("above_all", 100 * (c("median_ppsf") / c("whole") - 1)).drop("whole")


def least_squares(rows: DataFrame, names: list[str], target: str) -> tuple[dict[str, float], float, float, int]:
    """Coefficients by name, intercept, R2 and number of rows, from sums of products about the means: two aggregates of one row each.

    Rows with a null in any column take no part. Columns that depend on others share their effect as in
    the solution of least norm; a column of equal values has coefficient 0.
    """
    every = [*names, target]
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in every]).na.drop()
    means = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_{c}") for c in every])
    near = rows.crossJoin(F.broadcast(means)).select("_n", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in every])
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    sums = near.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]).first()
    middle = means.first()
    if not middle["_n"]:
        return dict.fromkeys(names, 0.0), 0.0, 0.0, 0
    m = np.zeros((len(every), len(every)))
    for (a, b), value in zip(pairs, sums, strict=True):
        m[every.index(a), every.index(b)] = m[every.index(b), every.index(a)] = value
    inner, outer, total = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    # Columns of one length first, so that units don't decide what counts as dependent.
    scale = np.sqrt(np.where(np.diag(inner) > 0, np.diag(inner), 1))
    solved = np.linalg.lstsq(inner / np.outer(scale, scale), outer / scale, rcond=1e-12)[0] / scale
    r2 = float(solved @ outer / total) if total else 0.0
    return dict(zip(names, solved.tolist(), strict=True)), float(middle[f"_{target}"] - sum(b * middle[f"_{c}"] for c, b in zip(names, solved, strict=True))), r2, middle["_n"]


#: Columns of the regression; those after the third are the floor's.
REGRESSORS = ["log_sqft", "bedrooms", "district_number", "is_penthouse", "is_basement", "is_lower_ground", "is_ground", "is_high_floor", "is_multi_floor", "has_lift"]


def regression_rows(t: Tables) -> DataFrame:
    """One row a listing with price, size, bedrooms and postcode: the regressors and ``log_price``. Districts are numbered by name; as many as there are outward codes are broadcast."""
    rows = told(t).where("size_sqft > 0 and bedrooms > 0 and postcode is not null")
    rows = rows.withColumn("district", F.coalesce(F.nullif(F.regexp_extract("postcode", r"^([A-Z]+\d+)", 1), F.lit("")), F.lit("Unknown")))
    numbered = rows.select("district").distinct().withColumn("district_number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("district")) - 1)
    flags = {c: F.col(c).cast("int") for c in ("is_penthouse", "is_basement", "is_lower_ground", "is_ground", "is_multi_floor")}
    made = rows.join(F.broadcast(numbered), "district").withColumns(flags | {"log_sqft": F.log1p("size_sqft"), "log_price": F.log1p("price_pcm"), "is_high_floor": (F.coalesce("floor_level", F.lit(0.0)) >= 6).cast("int"), "has_lift": F.coalesce("has_lift", F.lit(False)).cast("int")})
    return made.select("id", *REGRESSORS, "log_price")


@query()
def r_floor_regression(t: Tables) -> DataFrame:
    """What each floor does to the logarithm of the rent beside size, bedrooms and district, and to the rent in percent."""
    found, intercept, r2, n = least_squares(lasting(regression_rows(t)), REGRESSORS, "log_price")
    rows = [("intercept", intercept, None), *[(name, b, 100 * float(np.expm1(b))) for name, b in found.items()]]
    return t.spark.createDataFrame([(*r, r2, n) for r in rows], "name string, coefficient double, percent double, r2 double, n long")
