"""Pairs of listings that match, and groups made of such pairs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far apart two rows of one place may be; sureness of a group by its reason.
METRES, PRICE_SHARE, PREFIX, SHORTEST, RATIO = 15, 0.05, 25, 10, 0.85
CONFIDENCE = {"coords": 0.95, "exact": 0.90, "fuzzy": 0.75}
#: Sides of a grid cell in degrees, a little over METRES: a degree of latitude has at least 110,570 m; of longitude that times the cosine.
CELL = METRES / 110_500
#: Longitude cells are made for latitudes up to this; beyond it (no town of the market) rows are not placed.
FARTHEST = 66.0
#: A text with more price bands than this meets all texts of its block, others meet by band: either way all that could be a pair meet.
BANDS = 12
#: Pairs that are made a forest at once.
PAIRS_AT_ONCE = 1_000_000
#: The folder of a local session without spark.checkpoint.dir, once there is one.
OWN_FOLDER: dict[str, str] = {}


def lasting(df: DataFrame) -> DataFrame:
    """The table, written once to the shared folder and read from there; only a local session gets a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or OWN_FOLDER.get("path")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = OWN_FOLDER["path"] = f"file://{tempfile.mkdtemp(prefix='matching-')}"
    path = f"{folder}/matching-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def price_band(price: Column) -> Column:
    """Number of a price's band; prices within PRICE_SHARE of the larger are in one band or in neighbours."""
    return F.floor(F.ln(price) / -F.log1p(F.lit(-PRICE_SHARE))).cast("long")


def near_price(x: Column, y: Column) -> Column:
    return (x > 0) & (y > 0) & (F.abs(x - y) / F.greatest(x, y) <= PRICE_SHARE)


def around(c: Column) -> Column:
    return F.explode(F.array(c - 1, c, c + 1))


def sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The table twice, the columns with ``_a`` and ``_b`` behind their names."""
    return tuple(rows.select(*[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab")


def coordinate_pairs(rows: DataFrame) -> DataFrame:
    """``a`` < ``b``: at most 15 m apart, as many bedrooms (both null counts), prices within 5 %. Rows meet by grid cell, bedrooms and price band."""
    placed = rows.where("latitude <> 0 and longitude <> 0 and price_pcm > 0").where(F.abs("latitude") <= FARTHEST)
    placed = placed.withColumn("band", price_band(F.col("price_pcm"))).withColumn("row", F.floor(F.col("latitude") / CELL))
    # One width for all, that of the farthest latitude: neighbours by distance are neighbours by cell.
    placed = placed.withColumn("column", F.floor(F.col("longitude") * F.cos(F.radians(F.lit(FARTHEST))) / CELL))
    a, b = sides(placed, "id", "latitude", "longitude", "price_pcm", "bedrooms", "band", "row", "column")
    a = a.withColumn("band_a", around(F.col("band_a"))).withColumn("row_a", around(F.col("row_a"))).withColumn("column_a", around(F.col("column_a")))
    same = (F.col("row_a") == F.col("row_b")) & (F.col("column_a") == F.col("column_b")) & (F.col("band_a") == F.col("band_b")) & F.col("bedrooms_a").eqNullSafe(F.col("bedrooms_b"))
    h = F.sin(F.radians(F.col("latitude_b") - F.col("latitude_a")) / 2) ** 2 + F.cos(F.radians("latitude_a")) * F.cos(F.radians("latitude_b")) * F.sin(F.radians(F.col("longitude_b") - F.col("longitude_a")) / 2) ** 2
    metres = F.atan2(F.sqrt(h), F.sqrt(1 - h)) * (2 * 6371000)
    return a.join(b, same).where((F.col("id_a") < F.col("id_b")) & near_price(F.col("price_pcm_a"), F.col("price_pcm_b")) & (metres <= METRES)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def exact_pairs(rows: DataFrame) -> DataFrame:
    """``a`` < ``b``: one price, as many bedrooms, and the first 25 characters of ``normal`` (10 at least) alike."""
    a, b = sides(rows.where(F.length("normal") >= SHORTEST).withColumn("prefix", F.substring("normal", 1, PREFIX)), "id", "price_pcm", "bedrooms", "prefix")
    same = F.col("price_pcm_a").eqNullSafe(F.col("price_pcm_b")) & F.col("bedrooms_a").eqNullSafe(F.col("bedrooms_b")) & (F.col("prefix_a") == F.col("prefix_b"))
    return a.join(b, same).where("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def sequence_ratio(x: Column, y: Column, least: float = RATIO) -> Column:
    """The matching-blocks ratio of two texts; 0 where it is under ``least``, found by a cheaper bound if it tells."""

    def bound(x: list[str], y: list[str]) -> np.ndarray:
        """For each two texts what their ratio can be at most, by the letters they share; letters 128 apart count as one, which only raises it."""
        number = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
        lengths = np.array([len(t) for t in number], dtype=np.int64)
        letters = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 127
        counts = np.bincount(np.repeat(np.arange(len(number)), lengths) * 128 + letters, minlength=len(number) * 128).reshape(-1, 128).astype(np.int32)
        p, q = np.array([number[t] for t in x], dtype=np.int64), np.array([number[t] for t in y], dtype=np.int64)
        return 2.0 * np.minimum(counts[p], counts[q]).sum(axis=1) / np.maximum(lengths[p] + lengths[q], 1)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna("").tolist(), y.fillna("").tolist()
        out, m, last = np.zeros(len(x)), SequenceMatcher(None, "", ""), ""
        fair = np.flatnonzero(bound(x, y) >= least) if x else []
        for i in sorted(fair, key=lambda i: y[i]):  # the second text is prepared once for all its first ones
            if x[i] and y[i]:
                if y[i] != last:
                    m.set_seq2(last := y[i])
                m.set_seq1(x[i])
                out[i] = r if (r := m.ratio()) >= least else 0.0
        return pd.Series(out)

    return ratio(x, y)


def texts_of(rows: DataFrame, block: str) -> DataFrame:
    """``text``, a number for each ``normal`` of a block, with the price bands of its rows and whether some have no price."""
    by = rows.groupBy(block, "normal").agg(F.collect_set("band").alias("bands"), F.bool_or(F.col("band").isNull()).alias("free"))
    return lasting(by.withColumn("text", F.monotonically_increasing_id()))


def meeting_texts(texts: DataFrame, block: str, least: float) -> DataFrame:
    """``normal_a``, ``normal_b``, each two once: texts of one block whose rows could have prices near one another; also each with itself."""
    texts = texts.withColumn("wide", F.col("free") | (F.size("bands") > BANDS)).repartition(texts.sparkSession.sparkContext.defaultParallelism, "text")
    a, b = sides(texts, block, "normal", "bands", "wide")
    same = F.col(f"{block}_a").eqNullSafe(F.col(f"{block}_b"))
    one = a.where(~F.col("wide_a")).withColumn("band", F.explode("bands_a")).withColumn("band_a", around(F.col("band")))
    two = b.where(~F.col("wide_b")).withColumn("band_b", F.explode("bands_b"))
    found = a.where("wide_a").join(b, same), a.where(~F.col("wide_a")).join(b.where("wide_b"), same), one.join(two, same & (F.col("band_a") == F.col("band_b")))
    found = [x.select("normal_a", "normal_b").where(length_fits(least)) for x in found]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def length_fits(least: float) -> Column:
    """Whether two texts can be alike by their lengths, or one is within the other."""
    la, lb = F.length("normal_a"), F.length("normal_b")
    return (la > 0) & (lb > 0) & ((2 * F.least(la, lb) >= least * (la + lb)) | within())


def within() -> Column:
    return F.contains("normal_a", F.col("normal_b")) | F.contains("normal_b", F.col("normal_a"))


def alike_texts(texts: DataFrame, block: str, least: float = RATIO, parts: bool = False) -> DataFrame:
    """``text_a``, ``text_b``, ``similarity`` of texts of one block that are alike, in both orders, as the ratio depends on it.

    The sequence ratio; with ``parts`` equal texts are 1, one within the other 0.9, and only others have the ratio.
    Each two different texts are compared once, however many blocks and rows have them.
    """
    met = lasting(meeting_texts(texts, block, least))
    rest, found = met, []
    if parts:
        plain = met.where(within()).withColumn("similarity", F.when(F.col("normal_a") == F.col("normal_b"), 1.0).otherwise(0.9))
        rest, found = met.where(~within()), [plain.where(F.col("similarity") >= least)]
    rest = rest.repartition(texts.sparkSession.sparkContext.defaultParallelism, "normal_a", "normal_b")
    found.append(rest.withColumn("similarity", sequence_ratio(F.col("normal_a"), F.col("normal_b"), least)).where(F.col("similarity") >= least))
    alike = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    a, b = sides(texts, block, "normal", "text")
    out = alike.join(a, "normal_a").join(b, (b["normal_b"] == alike["normal_b"]) & F.col(f"{block}_a").eqNullSafe(F.col(f"{block}_b")))
    return lasting(out.select("text_a", "text_b", "similarity"))


def numbered(rows: DataFrame, texts: DataFrame, block: str, *columns: str) -> DataFrame:
    """The rows with their texts' numbers in the place of texts and blocks."""
    of = texts.select(F.col(block).alias("_block"), F.col("normal").alias("_normal"), "text")
    with_text = rows.join(of, (F.col("normal") == F.col("_normal")) & F.col(block).eqNullSafe(F.col("_block")))
    return lasting(with_text.select("text", "band", *columns).repartition(rows.sparkSession.sparkContext.defaultParallelism, "id"))


def fuzzy_pairs(rows: DataFrame, block: str) -> DataFrame:
    """``a``, ``b`` of one block in the order of price, then id: as many bedrooms, prices within 5 %, ``normal`` alike by 0.85 of the sequence ratio.

    Texts that are alike are found first; then rows meet by text, bedrooms and price band only. The rows of a
    text, bedrooms and band are few, so they are hashed; the many rows that look for them are shuffled, not sorted.
    """
    priced = rows.where("price_pcm > 0 and normal <> ''").withColumn("band", price_band(F.col("price_pcm")))
    priced = lasting(priced.select("id", block, "price_pcm", "bedrooms", "band", "normal"))
    texts = texts_of(priced, block)
    a, b = sides(numbered(priced, texts, block, "id", "price_pcm", "bedrooms"), "id", "price_pcm", "bedrooms", "band", "text")
    same = (F.col("text_b") == F.col("_text")) & (F.col("band_a") == F.col("band_b")) & F.col("bedrooms_a").eqNullSafe(F.col("bedrooms_b"))
    alike = alike_texts(texts, block).select("text_a", F.col("text_b").alias("_text"))
    pairs = a.join(alike.hint("merge"), "text_a").join(b.withColumn("band_b", around(F.col("band_b"))).hint("shuffle_hash"), same)
    first = F.struct("price_pcm_a", "id_a") < F.struct(F.col("price_pcm_b").alias("price_pcm_a"), F.col("id_b").alias("id_a"))
    return pairs.where(first & near_price(F.col("price_pcm_a"), F.col("price_pcm_b"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def matches(rows: DataFrame, block: str) -> DataFrame:
    """``a``, ``b``, ``reason``, ``order_a``, ``order_b``: pairs of one block, a before b by price and id, by the first of coords, exact, fuzzy."""
    found = [coordinate_pairs(rows).withColumn("k", F.lit(0)), exact_pairs(rows).withColumn("k", F.lit(1)), fuzzy_pairs(rows, block).withColumn("k", F.lit(2))]
    pairs = found[0].unionByName(found[1]).unionByName(found[2])
    place = rows.select("id", F.col(block).alias("_block"), F.struct("price_pcm", "id").alias("order"))
    x, y = (place.select(F.col("id").alias(f"_{s}"), F.col("_block").alias(f"_block_{s}"), F.col("order").alias(f"_order_{s}")) for s in "xy")
    pairs = pairs.join(x, F.col("a") == F.col("_x")).join(y, F.col("b") == F.col("_y")).where(F.col("_block_x").eqNullSafe(F.col("_block_y")))
    ahead = F.col("_order_x") < F.col("_order_y")
    turned = pairs.select(
        F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"),
        F.least("_order_x", "_order_y").alias("order_a"), F.greatest("_order_x", "_order_y").alias("order_b"), "k",
    )
    reason = F.element_at(F.array(*[F.lit(r) for r in CONFIDENCE]), F.min("k") + 1)
    return turned.groupBy("a", "b", "order_a", "order_b").agg(reason.alias("reason"))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """``leader``, ``member``, ``reason``: a scan in order, in which each row that is still free leads and takes the free rows that match it.

    A row leads if no earlier leader matches it, and follows the first that does. So rows without an earlier
    undecided match are decided in every round, all at once; rounds follow the longest chain of such matches.
    """
    pairs = lasting(pairs)
    open_, leaders = pairs.select("a", "b"), None
    while not open_.isEmpty():
        later = open_.select(F.col("b").alias("a")).distinct()
        lead = lasting(open_.select("a").distinct().join(later, "a", "left_anti"))
        leaders = lead if leaders is None else lasting(leaders.unionByName(lead))
        taken = open_.join(lead, "a").select(F.col("b").alias("a")).distinct()
        open_ = lasting(open_.join(lead.unionByName(taken), "a", "left_anti"))
    if leaders is None:
        return pairs.select(F.col("a").alias("leader"), F.col("b").alias("member"), "reason", "order_b")
    led = pairs.join(leaders, "a")
    return led.groupBy(F.col("b").alias("member"), "order_b").agg(F.min_by(F.struct("a", "reason"), "order_a").alias("x")).select(F.col("x.a").alias("leader"), "member", F.col("x.reason").alias("reason"), "order_b")


def group_reasons(groups: DataFrame) -> DataFrame:
    """``leader``, ``reason``, ``confidence``: the commonest reason of each group, of equals the first seen."""
    per = groups.groupBy("leader", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("order_b").alias("seen"))
    out = per.groupBy("leader").agg(F.min_by("reason", F.struct(-F.col("n"), F.col("seen"))).alias("reason"))
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return out.withColumn("confidence", F.element_at(sure, F.col("reason")))


def cross_matches(rows: DataFrame, *told: str, least: float = RATIO, unlike: str | None = None) -> DataFrame:
    """Pairs across sources with ``id``, ``source`` and the columns ``told`` of both rows (``_a``, ``_b``) and ``similarity``; only those that differ in ``unlike``, if given.

    Texts that are alike are found first; then rows meet by text and price band, rows without price by text.
    Nothing but ids and figures is carried, so that who needs no pairs can count or choose among them as they are found.
    """
    columns = dict.fromkeys(("id", "source", "price_pcm", "bedrooms", *told, *([unlike] if unlike else [])))
    rows = rows.where("normal <> '' and district is not null").withColumn("band", F.when(F.col("price_pcm") > 0, price_band(F.col("price_pcm"))))
    rows = lasting(rows.select("district", "normal", "band", *columns))
    texts = texts_of(rows, "district")
    rows = numbered(rows, texts, "district", *columns)
    alike = alike_texts(texts, "district", least, parts=True).withColumnRenamed("text_b", "_text")
    priced, free = rows.where("band is not null"), rows.where("band is null")

    def met(left: DataFrame, right: DataFrame, by_band: bool) -> DataFrame:
        a, b = sides(left, *columns, "text", "band")[0], sides(right, *columns, "text", "band")[1]
        same = F.col("text_b") == F.col("_text")
        if by_band:
            b, same = b.withColumn("band_b", around(F.col("band_b"))).hint("shuffle_hash"), same & (F.col("band_a") == F.col("band_b"))
        if unlike:
            same = same & (~F.col(f"{unlike}_a") == F.col(f"{unlike}_b"))
        return a.join(alike.hint("merge"), "text_a").join(b, same)

    pairs = met(priced, priced, True).where(near_price(F.col("price_pcm_a"), F.col("price_pcm_b")))
    pairs = pairs.unionByName(met(free, rows, False)).unionByName(met(priced, free, False))
    # The ratio depends on the order of two texts: the row of the first source by name stands first.
    return pairs.where("source_a < source_b").where("coalesce(bedrooms_a, 0) = 0 or coalesce(bedrooms_b, 0) = 0 or bedrooms_a = bedrooms_b")


def cross_pairs(rows: DataFrame, least: float = RATIO) -> DataFrame:
    """``a``, ``b``, ``similarity``, a of the first source by name: rows of two sources in one ``district``, prices within 5 % and bedrooms alike where both have them, ``normal`` alike.

    Equal texts are 1, one within the other 0.9, others by the sequence ratio.
    """
    return cross_matches(rows, least=least).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")


def forest(pairs: DataFrame) -> DataFrame:
    """Fewer pairs (a, b) that connect the same ids: of each lot of pairs a star for each component of the lot."""

    def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
        own = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[own]], pa.int64()), pa.array(ids[own], pa.int64())], ["a", "b"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if (n := n + batch.num_rows) >= PAIRS_AT_ONCE:
                # What is left of a lot goes on into the next while it is small.
                made = star(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [(made.column(0).to_numpy(), made.column(1).to_numpy())], made.num_rows
                if n > PAIRS_AT_ONCE // 2:
                    yield made
                    held, n = [], 0
        if held:
            yield star(*map(np.concatenate, zip(*held, strict=True)))

    return pairs.select("a", "b").mapInArrow(stars, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """``id``, ``root`` for each id in the pairs (a, b): the least id that it is connected to.

    Pairs become forests as they come, lot by lot, and once more by id; of what is left, labels go to
    neighbours and jump to their labels' labels, until none changes.
    """
    few = lasting(forest(pairs.where("a <> b")))
    one_way = lasting(forest(few.repartition("b")))
    both = lasting(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = lasting(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        found = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("root", "m").alias("now"), F.col("root").alias("was"))
        up = labels.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
        found = lasting(found.join(up, F.col("now") == F.col("_id"), "left").select("id", F.least("now", F.coalesce("_up", "now")).alias("root"), "was"))
        labels = found.select("id", "root")
        if found.where("root <> was").isEmpty():
            return labels
