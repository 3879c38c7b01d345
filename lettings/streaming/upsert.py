"""Keyed upsert of scraped listings with a price history, for one batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import address as A

# A change worth a history row, in pounds, percent and hours; the step allowed to a listing under a new id.
CHANGE_POUNDS, CHANGE_PERCENT, CHANGE_HOURS, RELIST_PERCENT = 50, 2, 1, 20
#: Taken from the batch where it has a value, else kept.
STICKY = ("size_sqft", "bedrooms", "bathrooms", "postcode", "address", "latitude", "longitude", "property_type", "agent_name")
#: Always taken from the batch.
REPLACED = ("price_pcm", "price_period", "summary", "added_date")
COLUMNS = ("id", "source", "property_id", *STICKY, *REPLACED, "is_active", "first_seen", "last_seen")


def with_keys(df: DataFrame) -> DataFrame:
    place = A.fingerprint(F.col("address"), F.col("postcode"), F.col("source"), F.col("property_id"))
    return df.withColumn("fp", place).withColumn("district", A.district_by_space(F.col("postcode")))


def first_of_each(batch: DataFrame) -> DataFrame:
    """Without repeats of (source, property_id), then of (source, place, price, bedrooms) with a price; ``arrival`` orders rows."""
    ids = Window.partitionBy("source", "property_id").orderBy("arrival")
    same = Window.partitionBy("source", "fp", "price_pcm", F.coalesce("bedrooms", F.lit(-1))).orderBy("arrival")
    rows = batch.withColumn("rn", F.row_number().over(ids)).where("rn = 1")
    return rows.withColumn("rn", F.row_number().over(same)).where("rn = 1 or coalesce(price_pcm, 0) = 0").drop("rn")


def matched(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The batch with the ``match`` of each row: the listing's id, or null.

    Tried in turn: source and id; source, place and bedrooms, if the price is within 20 %; source,
    price, size, bedrooms and district. Of several listings the last seen counts, then the greatest id.
    Every step aggregates the listings by its key first, so that a frequent key joins once.
    """
    latest = F.struct("last_seen", "id")

    def newest(keys: list[str], name: str, *extra: Column) -> DataFrame:
        return target.groupBy(*keys).agg(F.max_by(F.struct("id", *extra), latest).alias(name))

    by_id = ["source", "property_id"]
    by_place = ["source", "fp", "bedrooms"]
    by_size = ["source", "price_pcm", "size_sqft", "bedrooms", "district"]
    rows = batch.join(newest(by_id, "m1"), by_id, "left")
    rows = rows.join(newest(by_place, "m2", F.col("price_pcm").alias("price")), by_place, "left")
    rows = rows.join(newest(by_size, "m3"), by_size, "left")
    near = F.abs(F.col("price_pcm") - F.col("m2.price")) * 100 <= F.col("m2.price") * RELIST_PERCENT
    rows = rows.withColumn("match", F.coalesce("m1.id", F.when(near, F.col("m2.id")), "m3.id"))
    return rows.drop("m1", "m2", "m3")


def significant(old: Column, new: Column) -> Column:
    step = F.abs(new - old)
    return (old > 0) & (new > 0) & (step >= CHANGE_POUNDS) & (step * 100 >= old * CHANGE_PERCENT)


def upsert(target: DataFrame, history: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The listings after the batch, and the history rows (listing_id, price_pcm, recorded_at) that it adds.

    ``batch`` has the columns of listings but for id, dates and is_active, and ``arrival``. Of rows that
    lead to one listing the last to arrive counts. New ids follow the greatest one, with gaps. The
    matched batch is checkpointed, since both results must see the same ids.
    """
    rows = matched(first_of_each(with_keys(batch)), with_keys(target))
    last = Window.partitionBy(F.coalesce(F.col("match").cast("string"), F.concat_ws("\x00", F.lit("new"), "source", "property_id"))).orderBy(F.desc("arrival"))
    rows = rows.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    top = target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).withColumn("key", F.coalesce("match", F.col("top") + 1 + F.monotonically_increasing_id()))
    new = rows.select("key", F.col("match").isNotNull().alias("known"), *(F.col(c).alias(f"new_{c}") for c in ("source", "property_id", *STICKY, *REPLACED))).checkpoint()

    both = target.join(new, F.col("id") == F.col("key"), "full_outer")
    touched = F.col("key").isNotNull()
    take = lambda c: F.when(touched, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    out = both.select(
        F.coalesce("key", "id").alias("id"), take("source"), take("property_id"), *(F.coalesce(f"new_{c}", c).alias(c) for c in STICKY), *map(take, REPLACED),
        F.when(touched, 1).otherwise(F.col("is_active")).alias("is_active"), F.coalesce("first_seen", now).alias("first_seen"), F.when(touched, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )

    recorded = history.groupBy(F.col("listing_id").alias("_listing")).agg(F.max("recorded_at").alias("_at"))
    changed = new.where("known").join(target.select("id", F.col("price_pcm").alias("old")), F.col("key") == F.col("id"))
    changed = changed.where(significant(F.col("old"), F.col("new_price_pcm"))).join(recorded, F.col("key") == F.col("_listing"), "left")
    rested = F.col("_at").isNull() | (F.timestamp_diff("SECOND", F.col("_at"), now) >= CHANGE_HOURS * 3600)
    added = changed.where(rested).select("key", "new_price_pcm").unionByName(new.where("not known and new_price_pcm > 0").select("key", "new_price_pcm"))
    return out, added.select(F.col("key").alias("listing_id"), F.col("new_price_pcm").alias("price_pcm"), now.alias("recorded_at"))


def start(stream: DataFrame, base: str, out: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream into versions of two tables: ``out``/listings/v=N and ``out``/history/v=N for batch N.

    ``base`` holds the first listings and history as Parquet. Batches are numbered without gaps, so each
    starts from the version before it, and a repeated batch writes its own version again. History rows
    of a version are only those it added. ``arrival`` and ``at`` (the batch's clock) are columns of the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = f"{base}/listings" if number == 0 else f"{out}/listings/v={number - 1}"
        history = spark.read.parquet(f"{base}/history")
        for n in [f"{out}/history/v={i}" for i in range(number)]:
            history = history.unionByName(spark.read.parquet(n))
        at = batch.agg(F.max("at")).first()[0]
        listings, added = upsert(spark.read.parquet(before), history, batch.drop("at"), F.lit(at).cast("timestamp"))
        listings.write.mode("overwrite").parquet(f"{out}/listings/v={number}")
        added.write.mode("overwrite").parquet(f"{out}/history/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
