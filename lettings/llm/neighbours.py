"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Equal vectors are one entry that carries its smallest ids, as many as an answer can need. Unit
vectors are put in lists by nearest centroid (k-means in numpy on a bounded sample; every
vector is indexed); what a vector differs from its centroid by is rotated at random and kept as
signs, with two correction scalars: its length, and its inner product with its own code. From
these a query estimates its inner product with every vector of the lists it probes, with an
error bound that holds with high probability. Vectors whose upper bound reaches the lower bound of
the k-th are reranked by exact cosine on the original vectors. Lists are cut into blocks of
bounded size for data and queries, so that a list with a third of all vectors is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, map_batches

#: Distinct vectors that k-means may see, chosen by a hash; error bound in standard deviations.
SAMPLE, EPSILON = 20_000, 3.0
DATA_BLOCK, QUERY_BLOCK = 512, 128


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their greatest components are from 0.5 to 1: cosines keep every bit, and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no overflow or underflow in squares
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """n centroids of unit vectors; empty clusters keep their centroid."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 4096] @ found.T).argmax(1) for i in range(0, len(sample), 4096)])
        for k in np.unique(of):
            found[k] = sample[of == k].mean(0)
    return found


def rotation(width: int, seed: int = 12) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(units: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, and per vector: length, product with its code, product with the centroid."""
    rest = units - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length, length, 1)[:, None]) @ turn.T
    bits = turned >= 0
    own = np.where(bits, turned, -turned).sum(1) / np.sqrt(turned.shape[1])
    scalars = np.stack([length, np.where(length > 0, own, 1), (rest * centre).sum(1)], 1).astype(np.float32)
    return np.packbits(bits, axis=1), scalars


def estimates(query: np.ndarray, centre: np.ndarray, turn: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and their error bounds."""
    width = turn.shape[0]
    rest = query - centre
    size = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1
    length, own, with_centre = scalars.T
    products = turned @ signs.T / np.sqrt(width) / own
    error = np.sqrt(np.maximum(0, 1 - own * own)) / own * (EPSILON / np.sqrt(max(1, width - 1)))
    return (query @ centre)[:, None] + length * products + with_centre, size[:, None] * (length * error) + 1e-5


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, probe_share: float = 0.6, least_probes: int = 24, sample: int = SAMPLE) -> DataFrame:
    """The k nearest to each query: ``query_id``, ``rank``, ``vec_id``, ``score`` (exact cosine, in doubles).

    ``vectors`` has vec_id and embedding; ``queries`` says which rows are queries; candidates are
    all rows but those of the query's own vec_id. Ties go to the smaller vec_id, and there are fewer
    rows only where there are fewer candidates. Vectors that are null, zero, hold null or non-finite
    components, or have another width than most (the smaller on a tie) take no part, nor do rows
    without vec_id. Repeated rows count once. Without vectors, or without queries, the result is
    empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width = widths["width"]
    rows = Cut(rows.where(F.size("embedding") == width).groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")), "vectors").df
    # Of equal vectors, the ids that an answer can need: ranking within tasks first leaves few of each to shuffle.
    few = rows.withColumn("_i", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_i") <= k + 1)
    # Ids repeat among entries if a vec_id has several vectors: an entry's key is a hash of both.
    entries = Cut(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64(F.col("ids")[0], "embedding").alias("entry"), "embedding", "ids"), "entries").df
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = Cut(asked.join(entries.select(F.col("embedding").alias("_same"), F.col("entry").alias("query")), F.col("embedding") == F.col("_same")).select("query_id", "query", "embedding"), "asked").df
    n = entries.count()
    some = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("entry", "embedding").toArrow()
    seen = np.asarray(some.column("embedding").combine_chunks().flatten()).reshape(-1, width)[np.argsort(np.asarray(some.column("entry")))]
    lists = max(1, min(round(n**0.5), len(seen) // 4 or 1))
    model = spark.sparkContext.broadcast((centroids(unit(seen), lists), rotation(width)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = model.value
        for batch in batches:
            if batch.num_rows:
                units = unit(matrix(batch, "embedding"))
                of = (units @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
                codes, scalars = encode(units, centres[of], turn)
                own = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (codes, scalars, matrix(batch, "embedding"))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int32)), *own, batch.column(2)], names=["entry", "list", "code", "scalars", "vector", "ids"])

    coded = Cut(map_batches(entries.select("entry", "embedding", "ids"), index, "entry long, list int, code binary, scalars binary, vector binary, ids array<long>"), "codes").df
    counts = coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["list"]: r["n"] for r in counts.collect()}  # as many rows as lists: bounded by the sample
    shared = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(lists)]))
    probes = max(least_probes, int(np.ceil(lists * probe_share)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = model.value
        for batch in batches:
            if batch.num_rows:
                units = unit(matrix(batch, "embedding"))
                order = np.argsort(-(units @ centres.T - 0.5 * (centres * centres).sum(1)), axis=1, kind="stable")
                enough = (np.cumsum(shared.value[order], axis=1) - shared.value[order] < k + 1) | (np.arange(lists) < probes)
                row, at = np.nonzero(enough & (shared.value[order] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[row]), pa.array(order[row, at].astype(np.int32)), batch.column(1).take(pa.array(row))], names=["query", "list", "embedding"])

    distinct = asked.groupBy("query").agg(F.first("embedding").alias("embedding"))
    probed = Cut(map_batches(distinct, probe, "query long, list int, embedding array<double>"), "probes").df

    def blocks(df: DataFrame, size: int, by: str, kept: list[str]) -> DataFrame:
        """One row per block of a list: its rows' columns as arrays."""
        many = checked_broadcast(df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n")))
        cut = df.join(many, "list").withColumn("block", F.pmod(F.xxhash64(by), F.col("_n")))
        return cut.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct(by, *kept))).alias("rows"))

    data = blocks(coded, DATA_BLOCK, "entry", ["code", "scalars", "vector", "ids"]).select("list", F.col("rows").alias("data"))
    ask = blocks(probed, QUERY_BLOCK, "query", ["embedding"]).select("list", F.col("rows").alias("ask"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = model.value
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                data, ask = batch.column(1)[i].values, batch.column(2)[i].values
                entry, ids = np.asarray(data.field("entry")), data.field("ids").to_pylist()
                code, scalars, vector = (np.frombuffer(b"".join(data.field(c).to_pylist()), t).reshape(len(entry), -1) for c, t in (("code", np.uint8), ("scalars", np.float32), ("vector", np.float64)))
                query, asking = np.asarray(ask.field("query")), np.asarray(ask.field("embedding").flatten()).reshape(-1, width)
                guess, error = estimates(unit(asking), centres[number], turn, code, scalars)
                vector, asking = scaled(vector), scaled(asking)
                lengths = np.sqrt((vector * vector).sum(1))
                for q, v, g, e in zip(query, asking, guess, error, strict=True):
                    floor = np.partition(g - e, -(k + 1))[-(k + 1)] if len(g) > k + 1 else -np.inf
                    near = np.flatnonzero(g + e >= floor)
                    score = (vector[near] * v).sum(1) / (lengths[near] * np.sqrt((v * v).sum()))
                    for j in np.lexsort(([ids[x][0] for x in near], -score))[: k + 1]:
                        out.append((int(q), float(score[j]), ids[near[j]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["query", "score", "ids"])

    found = map_batches(data.join(ask, "list").select("list", "data", "ask"), search, "query long, score double, ids array<long>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    found = Cut(found.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= k + 1), "found").df
    answers = asked.select("query_id", F.col("query").alias("_q")).join(found, F.col("_q") == F.col("query")).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    # A vec_id with several vectors, or a query with several, counts once, by the best.
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
