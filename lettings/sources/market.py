"""Listings, price history and run records, shaped from the star-schema tables.

The same text, in plain arithmetic and CASE, makes the tables on Spark and in the SQL oracles;
only adding days and naming a day differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"days": "timestampadd(DAY, {n}, {t})", "day": "date_format({t}, 'd/M/yyyy')"}
DUCKDB = {"days": "({t} + to_days(CAST({n} AS INTEGER)))", "day": "strftime({t}, '%-d/%-m/%Y')"}

LISTINGS = """
SELECT o_orderkey AS id,
  CASE o_custkey % 5 WHEN 0 THEN 'savills' WHEN 1 THEN 'knightfrank' WHEN 2 THEN 'chestertons' WHEN 3 THEN 'foxtons' ELSE 'rightmove' END AS source,
  CAST(o_orderkey AS STRING) AS property_id,
  CAST(FLOOR(o_totalprice / 20) AS INT) AS price_pcm,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 9 = 0 THEN 'pw' ELSE 'pcm' END AS price_period,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 300 + 10 * CAST(FLOOR(qty) AS INT) END AS size_sqft,
  CAST(o_orderkey % 6 AS INT) AS bedrooms,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END AS bathrooms,
  CASE o_custkey % 8 WHEN 0 THEN 'SW1A 1AA' WHEN 1 THEN 'SW3 5TR' WHEN 2 THEN 'SW10 9BN' WHEN 3 THEN 'W8 4AA' WHEN 4 THEN 'NW3 2QG' WHEN 5 THEN 'SW7' WHEN 6 THEN 'W1' ELSE '' END AS postcode,
  CONCAT(CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('Flat ', CAST(o_orderkey % 9 + 1 AS STRING), ', ') ELSE '' END, CAST(o_orderkey % 200 + 1 AS STRING), ' ',
    CASE o_custkey % 6 WHEN 0 THEN 'Eaton Square' WHEN 1 THEN 'St James Street' WHEN 2 THEN 'Kings Road' WHEN 3 THEN 'Sloane Avenue' WHEN 4 THEN 'Cadogan Place' ELSE 'High St' END) AS address,
  CASE WHEN o_orderkey % 23 = 0 THEN 0e0 ELSE 5.149e1 + CAST(o_orderkey % 100 AS DOUBLE) / 10000 END AS latitude,
  -1.7e-1 + CAST(o_custkey % 100 AS DOUBLE) / 10000 AS longitude,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Apartment' WHEN '2-HIGH' THEN 'flat' WHEN '3-MEDIUM' THEN 'Terraced House' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Studio' END AS property_type,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CONCAT(CASE o_custkey % 4 WHEN 0 THEN 'Savills' WHEN 1 THEN 'Knight Frank' WHEN 2 THEN 'Chestertons' ELSE 'Foxtons' END, ', ', COALESCE(c_mktsegment, 'Head Office')) END AS agent_name,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Short let in a quiet street' WHEN o_orderkey % 3 = 0 THEN 'Second floor flat with balcony, lift and porter' ELSE 'Long let with garden, roof terrace and parking' END AS summary,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_active,
  o_orderdate AS first_seen, {seen} AS last_seen,
  CASE o_orderkey % 4 WHEN 0 THEN CONCAT('Reduced on ', {day}) WHEN 1 THEN CONCAT('Added on ', {day}) WHEN 2 THEN 'Added yesterday' ELSE NULL END AS added_date
FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) q ON l_orderkey = o_orderkey
LEFT JOIN customer ON c_custkey = o_custkey"""

PRICE_HISTORY = """
SELECT l_orderkey AS listing_id, CAST(FLOOR(l_extendedprice) AS INT) AS price_pcm, l_shipdate AS recorded_at,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq
FROM (SELECT DISTINCT * FROM lineitem) d"""

SCRAPE_RUNS = """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id,
  CASE user_id % 5 WHEN 0 THEN 'savills' WHEN 1 THEN 'knightfrank' WHEN 2 THEN 'chestertons' WHEN 3 THEN 'foxtons' ELSE 'rightmove' END AS spider_name,
  MIN(ts) AS started_at, MAX(ts) AS finished_at, COUNT(*) AS items_scraped, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error_count,
  CASE WHEN SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 4 > COUNT(*) THEN 'failed' ELSE 'completed' END AS status
FROM events GROUP BY 1, 2"""

TABLES = ("customer", "orders", "lineitem", "events")


def text(name: str, dialect: dict[str, str]) -> str:
    made = {"listings": LISTINGS, "price_history": PRICE_HISTORY, "scrape_runs": SCRAPE_RUNS}[name]
    if name != "listings":
        return made
    return made.replace("{seen}", dialect["days"].format(n="o_orderkey % 45", t="o_orderdate")).replace("{day}", dialect["day"].format(t="o_orderdate"))


def market(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``listings``, ``price_history`` and ``scrape_runs`` over the tables of a folder."""
    return spark.sql(
        text(name, SPARK).replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN customer", "JOIN {customer}").replace("FROM events", "FROM {events}"),
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES},
    )


def oracle(sql: str) -> str:
    """The SQL, with the tables that it names in front."""
    used = [n for n in ("listings", "price_history", "scrape_runs") if n in sql]
    if not used:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({text(n, DUCKDB)})" for n in used) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
