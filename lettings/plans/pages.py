"""Links and data of pages; the stream's stages over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.matching import lasting
from ..sources.records import balanced_json
from ..streaming import ingest
from .catalogue import Tables, query

LINK = r"""(?i)(?:href|src)\s*=\s*"([^"]*)\""""
#: A listing's page with its data in a script, with braces and quotes in strings; every seventh is cut off.
PAGE = """CONCAT('<html><script>window.PAGE_MODEL = {"propertyData": {"id": ', CAST(id AS STRING), ', "text": "a } and ', chr(92), '"{', CAST(id % 7 AS STRING), '", "sizings": [{"unit": "sqft", "maximumSize": ', CAST(COALESCE(size_sqft, 0) AS STRING), '}]}', CASE WHEN id % 7 = 3 THEN '' ELSE '};</script><p>}</p></html>' END)"""


@query()
def fn_validate_url(t: Tables) -> DataFrame:
    """Every link of every page seen from the page's address: the valid address, the same if it may be an image, and whether a known host serves it."""
    links = t.pages.select("page_id", F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("nth", "link"))
    found = links.withColumns({"url": U.valid_url(F.col("link"), F.col("page")), "image": U.valid_image_url(F.col("link"), F.col("page"))})
    return found.select("page_id", "nth", "link", "url", "image", U.trusted_floorplan(F.col("image")).alias("trusted"))


@query("SELECT id, size_sqft AS sqft, id AS data_id FROM listings WHERE id % 7 <> 3 UNION ALL SELECT id, NULL, NULL FROM listings WHERE id % 7 = 3")
def src_brace_json(t: Tables) -> DataFrame:
    """Sizes from the data in listings' pages; null where it is cut off."""
    pages = t.listings.select("id", F.expr(PAGE).alias("html"))
    data = F.from_json(balanced_json(F.col("html")), "propertyData struct<id: bigint, text: string, sizings: array<struct<unit: string, maximumSize: int>>>")["propertyData"]
    return pages.select("id", data.alias("d")).select("id", F.nullif(F.get("d.sizings", F.lit(0))["maximumSize"], F.lit(0)).alias("sqft"), F.col("d.id").alias("data_id"))


ITEMS = "SELECT id, source, property_id, CASE WHEN price_period = 'pw' THEN NULL ELSE price_pcm END AS price_pcm, CASE WHEN price_period = 'pw' THEN price_pcm END AS price_pw, CONCAT('  ', REPLACE(address, ' ', '   ')) AS address, postcode, CASE WHEN property_type IS NOT NULL THEN CONCAT(' ', UPPER(property_type)) END AS property_type, CASE WHEN id % 37 = 0 THEN 'many' ELSE CAST(bedrooms AS STRING) END AS bedrooms, CAST(bathrooms AS STRING) AS bathrooms, CAST(first_seen AS TIMESTAMP) AS at FROM listings"


def items(t: Tables) -> DataFrame:
    return t.spark.sql(ITEMS.replace("FROM listings", "FROM {listings}"), listings=t.listings)


@query(f"""SELECT id, CASE WHEN COALESCE(price_pcm, 0) = 0 AND price_pw > 0 THEN CAST(TRUNC(price_pw * 52 / 12) AS INT) ELSE price_pcm END AS price_pcm, CASE WHEN COALESCE(price_pw, 0) = 0 AND price_pcm > 0 THEN CAST(TRUNC(price_pcm * 12 / 52) AS INT) ELSE price_pw END AS price_pw,
TRIM(regexp_replace(address, '\\s+', ' ', 'g')) AS address, LOWER(TRIM(property_type)) AS property_type, TRY_CAST(bedrooms AS INT) AS bedrooms, TRY_CAST(bathrooms AS INT) AS bathrooms FROM ({ITEMS}) i""")
def st_clean(t: Tables) -> DataFrame:
    """Scraped items after the stream's first stage."""
    return ingest.cleaned(items(t)).select("id", "price_pcm", "price_pw", "address", "property_type", "bedrooms", "bathrooms")


@query()
def st_chain(t: Tables) -> DataFrame:
    """The stream's stages, clean and free of repeats, over all listings as files, until they are read; what it wrote."""
    spark, source = t.spark, lasting(items(t))
    folder = source.inputFiles()[0].rpartition("/")[0]
    stream = spark.readStream.schema(source.schema).parquet(folder)
    kept = ingest.without_repeats(ingest.cleaned(stream)).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").outputMode("append").trigger(availableNow=True).start()
    kept.awaitTermination()
    return spark.read.parquet(f"{folder}-out").select("id", "source", "property_id", "fp", "price_pcm", "bedrooms")


RUN_EVENTS = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, CONCAT('spider-', CAST(user_id % 5 AS STRING)) AS spider_name, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'finish' WHEN 'error' THEN CASE WHEN user_id % 50 = 0 THEN 'fail' ELSE 'progress' END ELSE 'progress' END AS event_type, CAST(ts AS TIMESTAMP) AS event_time, CASE WHEN event_type = 'view' THEN CAST(FLOOR(value) AS INT) END AS items, CASE WHEN event_type = 'error' THEN CAST(user_id % 3 AS INT) END AS errors FROM events"


@query(f"""SELECT run_id, spider_name, MIN(event_time) AS started_at, MAX(CASE WHEN event_type IN ('finish', 'fail') THEN event_time END) AS finished_at, (EPOCH(MAX(CASE WHEN event_type IN ('finish', 'fail') THEN event_time END)) - EPOCH(MIN(event_time))) AS duration_seconds,
CASE WHEN MAX(CASE WHEN event_type = 'fail' THEN 1 END) = 1 THEN 'failed' WHEN MAX(CASE WHEN event_type = 'finish' THEN 1 END) = 1 THEN 'completed' ELSE 'running' END AS status,
(SELECT items FROM e x WHERE x.run_id = e.run_id AND x.spider_name = e.spider_name AND items IS NOT NULL ORDER BY event_time DESC, items DESC LIMIT 1) AS items_scraped, (SELECT errors FROM e x WHERE x.run_id = e.run_id AND x.spider_name = e.spider_name AND errors IS NOT NULL ORDER BY event_time DESC, errors DESC LIMIT 1) AS error_count
FROM e GROUP BY run_id, spider_name""".replace("FROM e x", f"FROM ({RUN_EVENTS}) x").replace("FROM e GROUP", f"FROM ({RUN_EVENTS}) e GROUP"))
def st_run_upsert(t: Tables) -> DataFrame:
    """Runs as their events leave them."""
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return ingest.run_state(t.spark.sql(RUN_EVENTS.replace("FROM events", "FROM {events}"), events=events))
