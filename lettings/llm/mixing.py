"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A source's target is its share of all words by weight, at most ``max_repeats`` times its
own words; what is over is shared again by weight among the others. Equal blocks of words
are then apportioned twice by highest quotients ``v / (2k - 1)``: to the sources, and
within a source to its shards, which are seeded groups of documents of bounded size. The
blocks of a shard are those of its documents in a seeded order; a quota beyond the shard's
own blocks goes round again. So no window spans more than a shard's documents, a source's
shards, or the table of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, n_words


def apportion(df: DataFrame, value: str, seats: Column, group: list[str], key: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row by Sainte-Laguë within its group.

    ``value`` is what seats are proportional to, ``seats`` the number of a group. Rounding
    ``q = value * seats / sum(value)`` to the nearest gives the seats whose quotients reach
    the divisor ``sum / seats``; if these are too few or too many, the next highest quotients
    come in or the lowest go, of which none lies beyond the first ones' d-th. Ties go to the
    smaller ``key``; a group whose values are all 0 gets no seat.
    """
    g = Window.partitionBy(*group)
    q = F.coalesce(F.try_divide(F.col(value).cast("double") * F.col("_n"), F.col("_sum").cast("double")), F.lit(0.0))
    df = df.withColumns({"_n": seats.cast("long"), "_sum": F.sum(value).over(g)}).withColumn("_r", F.floor(q + 0.5).cast("long"))
    df = df.withColumn("_d", F.when(F.col("_sum") > 0, F.col("_n") - F.sum("_r").over(g)).otherwise(0))
    # The quotient of the next seat to come in, or of the last one that is in.
    first = F.when(F.col("_d") > 0, F.col(value) / (2 * F.col("_r") + 1)).when(F.col("_r") > 0, F.col(value) / (2 * F.col("_r") - 1))
    df = df.withColumn("_v", first)
    order = [F.when(F.col("_d") > 0, -F.col("_v")).otherwise(F.col("_v")).asc_nulls_last(), F.col(key)]
    df = df.withColumn("_i", F.row_number().over(g.orderBy(*order)))
    df = df.withColumn("_edge", F.max(F.when(F.col("_i") <= F.abs("_d"), F.when(F.col("_d") > 0, -F.col("_v")).otherwise(F.col("_v")))).over(g))
    # Seats of this row between its first quotient and the edge: candidates beside which no other can win.
    up = F.floor((F.col(value) / F.nullif(-F.col("_edge"), F.lit(0.0)) + 1) / 2 + 1e-9) - F.col("_r")
    down = F.col("_r") - F.ceil((F.col(value) / F.nullif(F.col("_edge"), F.lit(0.0)) + 1) / 2 - 1e-9) + 1
    most = F.greatest(F.lit(0), F.least(F.abs("_d"), F.when(F.col("_d") > 0, F.coalesce(up, F.abs("_d"))).otherwise(F.least(F.col("_r"), F.coalesce(down, F.col("_r"))))))
    df = df.withColumn("_most", F.when(F.col("_d") == 0, 0).otherwise(most).cast("int"))
    kept = [c for c in df.columns if c[0] != "_" or c in group or c in (key, value)]
    steps = df.select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("_k"))
    move = F.when(F.col("_d") > 0, -F.col(value) / (2 * (F.col("_r") + F.col("_k")) - 1)).otherwise(F.col(value) / (2 * (F.col("_r") - F.col("_k")) + 1))
    steps = steps.withColumn("_q", F.when(F.col("_k") > 0, move))
    steps = steps.withColumn("_i", F.row_number().over(g.orderBy(F.col("_q").asc_nulls_last(), key, "_k")))
    more = F.when((F.col("_k") > 0) & (F.col("_i") <= F.abs("_d")), F.signum("_d")).otherwise(0)
    kept += [c for c in ("_n", "_r") if c not in kept]
    return steps.groupBy(*kept).agg(F.sum(more).cast("long").alias("_more")).withColumn(out, F.col("_r") + F.col("_more")).drop("_n", "_r", "_more")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``docs`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. A source is at its limit if
    its words times ``max_repeats`` over its weight lie below the level that the others reach.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    every = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_most", F.col("source_size") * max_repeats).withColumn("_at", F.col("_most") / F.col("weight"))
    by = every.orderBy("_at", F.col("source").asc_nulls_last())
    s = s.withColumns({"_all": F.sum("source_size").over(every), "_w": F.sum("weight").over(every)})
    s = s.withColumns({"_below": F.coalesce(F.sum("_most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_below_w": F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # The level if exactly the sources before this one were at their limit; the first it suits sets it.
    s = s.withColumn("_level", (F.col("_all") - F.col("_below")) / (F.col("_w") - F.col("_below_w")))
    s = s.withColumn("_set", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(every)["_level"])
    target = F.least(F.col("_most").cast("double"), F.col("_set") * F.col("weight"))
    return s.select("source", "source_size", "docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, seed: int = 1, block: int = 8, shard_docs: int = 1000, shard_words: int = 2_000_000, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): its size, its source's size and target, ``taken`` and ``copies``.

    ``taken`` are the words that the mix takes, counting repeats; the last block of a shard may
    end within a document. ``copies`` is the same in whole documents: how often the mix holds
    the document, the last time if at least half of it is within the quota.

    Null or empty texts have size 0 and are taken 0 times. A null source is a source of its own,
    the last one. Rows that are equal in all columns are separate documents; which one comes
    first makes no difference to the counts. Null doc_ids are kept. An empty table gives an empty
    result. Other columns are not read, whatever their names. The same rows and seed give the
    same result, however they are partitioned.
    """
    # The text's hash tells rows with one doc_id apart.
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    sizes = Cut(sized, "mix-sizes").df
    sources = Cut(source_targets(sizes, weights, max_repeats), "mix-sources").df
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_total"))
    whole = sources.crossJoin(F.broadcast(total)).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~null"))).withColumn("_one", F.lit(0))
    quota = apportion(whole, "target", F.round(F.col("_total") / block), ["_one"], "_key", "_blocks")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("docs") / shard_docs, F.col("source_size") / shard_words)))
    quota = Cut(quota.select("source", "source_size", "target", "_blocks", n.cast("long").alias("_shards")), "mix-quotas").df
    small = checked_broadcast(quota)
    placed = sizes.join(small, sizes["source"].eqNullSafe(small["source"])).select(sizes["*"], small["source_size"], small["target"], small["_blocks"], small["_shards"])
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_h"), F.col("_shards")))
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_size"), F.first("_blocks").alias("_blocks"))
    shards = Cut(apportion(shards, "_size", F.col("_blocks"), ["source"], "_shard", "_quota"), "mix-shards").df.select("source", "_shard", "_quota", "_size")
    near = checked_broadcast(shards)
    placed = placed.join(near, placed["source"].eqNullSafe(near["source"]) & (placed["_shard"] == near["_shard"])).select(placed["*"], near["_quota"], near["_size"])
    words = F.least(F.col("_quota") * block, F.col("_size") * max_repeats)
    rounds = F.coalesce(F.floor(F.try_divide(words, F.col("_size"))), F.lit(0)).cast("long")
    order = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size")
    placed = placed.withColumn("_rounds", rounds).withColumn("_rest", words - F.col("_rounds") * F.col("_size"))
    placed = placed.withColumn("_start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    taken = (F.col("_rounds") * F.col("size") + more).cast("long")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("_rounds") + F.when(2 * more >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.cast("long").alias("copies"), F.col("_h").alias("row_hash"))


#: Copies of one document that are made by one row of the join; more are dealt to more rows.
COPIES = 1000


def mixed_documents(docs: DataFrame, seed: int = 1, **options: object) -> DataFrame:
    """The documents of the mix, each as often as its ``copies`` say, with the columns of ``docs``, whatever their names.

    Rows of equal doc_id, text and source are one document that the mix holds as often as it takes
    them together; if their other columns differ, the copies have those of the least hash. Null texts
    have no words and are never taken; of an empty table nothing is.
    """
    plan = mix(docs, seed, **options).where("copies > 0").select(F.col("row_hash").alias("_h"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copies")
    plan = plan.groupBy("_h", "_id", "_source").agg(F.sum("copies").alias("copies"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))).alias("_part"))
    plan = plan.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("_part") * COPIES))
    # The document is one column meanwhile, so that none of its names can clash.
    doc = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"), doc.alias("doc"))
    rows = rows.groupBy("row", "id", "from").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    joined = rows.join(plan, (F.col("row") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("from").eqNullSafe(F.col("_source")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select("doc.*")
