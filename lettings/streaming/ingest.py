"""The stream of scraped listings: cleaned, without repeats across batches, and the record of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import address as A
from ..functions import listing as X

#: How long a key is remembered: a run of the scrapers is over by then.
REMEMBERED = "2 hours"


def cleaned(items: DataFrame) -> DataFrame:
    """Items (the columns of a batch, ``price_pw``, ``at``) with prices by month and week from one another, clean addresses, types in lower case, whole numbers of rooms, and ``fp``.

    Rooms that are no whole number become null. A given fingerprint is kept.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    monthly, weekly = X.monthly(F.col("price_pw")), X.weekly(F.col("price_pcm"))
    rows = items.withColumns({"price_pcm": F.when(none("price_pcm") & ~none("price_pw"), monthly).otherwise(F.col("price_pcm")), "price_pw": F.when(none("price_pw") & ~none("price_pcm"), weekly).otherwise(F.col("price_pw"))})
    rows = rows.withColumns({"address": X.clean_text(F.col("address")), "property_type": F.lower(F.trim("property_type")), **{c: F.col(c).try_cast("int") for c in ("bedrooms", "bathrooms")}})
    place = A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id"))
    return rows.withColumn("fp", F.coalesce("fp", place) if "fp" in items.columns else place)


def without_repeats(items: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The stream without items whose (source, property_id) came before, then without those whose (source, place, price, bedrooms) did, if place and price are known.

    The keys are state of the query, partitioned by key and dropped once the watermark on ``at`` has
    passed their time by ``remembered``: what comes later counts as new, and state stays as large as the
    keys of that time. An item that goes by its id doesn't enter its place. Items without a place or price only
    have their ids compared. A restarted query goes on with the state of its checkpoint.
    """
    rows = items.withWatermark("at", remembered)
    rows = rows.withColumn("_id", F.concat_ws("\x00", F.coalesce("source", F.lit("")), F.coalesce(F.col("property_id").cast("string"), F.lit(""))))
    rows = rows.dropDuplicatesWithinWatermark(["_id"])
    known = (F.coalesce("fp", F.lit("")) != "") & (F.coalesce("price_pcm", F.lit(0)) != 0)
    content = F.concat_ws("\x00", F.lit("place"), F.coalesce("source", F.lit("")), "fp", F.col("price_pcm").cast("string"), F.coalesce(F.col("bedrooms").cast("string"), F.lit("none")))
    rows = rows.withColumn("_content", F.when(known, content).otherwise(F.concat_ws("\x00", F.lit("id"), "_id")))
    return rows.dropDuplicatesWithinWatermark(["_content"]).drop("_id", "_content")


def ingest(items: DataFrame, out: str, checkpoint: str, remembered: str = REMEMBERED) -> StreamingQuery:
    """Cleans a stream and appends what is new to Parquet in ``out``, each item once also across restarts."""
    return without_repeats(cleaned(items), remembered).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()


def run_state(events: DataFrame) -> DataFrame:
    """One row a run from its events (run_id, spider_name, event_type, event_time, items, errors): started, finished, counts and status.

    A run's counters are those of its latest event that has them; a ``finish`` event ends it as completed, a
    ``fail`` event as failed, else it is running. Equal times go to the greater count. As a stream this is one
    aggregation in update mode, whose state is a row a run.
    """
    of = lambda kind: F.max(F.when(F.col("event_type").isin(*kind), F.col("event_time")))
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("event_time", c)))[c]
    by = events.groupBy("run_id", "spider_name").agg(
        F.min("event_time").alias("started_at"), of(("finish", "fail")).alias("finished_at"), latest("items").alias("items_scraped"), latest("errors").alias("error_count"), of(("fail",)).alias("_failed"),
    )
    status = F.when(F.col("_failed").isNotNull(), "failed").when(F.col("finished_at").isNotNull(), "completed").otherwise("running")
    seconds: Column = F.col("finished_at").cast("double") - F.col("started_at").cast("double")
    return by.select("run_id", "spider_name", "started_at", "finished_at", seconds.alias("duration_seconds"), status.alias("status"), "items_scraped", "error_count")


def upsert_runs(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of every run that a batch touched in ``out``/v=N; the row of a run with the greatest N is its state. A repeated batch writes its own version again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number}")

    return run_state(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest_runs(versions: DataFrame) -> DataFrame:
    """The last state of each run from all versions that ``upsert_runs`` wrote."""
    columns = [c for c in versions.columns if c not in ("v", "run_id", "spider_name")]
    return versions.groupBy("run_id", "spider_name").agg(F.max_by(F.struct(*columns), "v").alias("row")).select("run_id", "spider_name", "row.*")
