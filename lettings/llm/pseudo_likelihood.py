"""Documents scored by a masked language model: each word predicted from both sides.

The words of all documents are counted first, and each of them has a probability of its own. The
``HEAD`` most frequent words have a bucket each, the others share the rest of the ``VOCAB`` buckets
by hash. A word's context, the two before and the two after it, is embedded, each place with
weights of its own, summed and squashed; a softmax over classes of buckets and one over the buckets
of a class give the bucket's conditional probability, and the counts the word's share of its
bucket. That share is discounted: of the ``N`` occurrences of a bucket's ``T`` words, a word that
was seen ``n`` times has ``(n - DISCOUNT) / N``, which takes most from rare words, and what was not
seen ``DISCOUNT * T / N``, all of it together. The sum of the logarithms of bucket and share over all
words of a document is the document's pseudo-log-likelihood.

The table of counts grows with the distinct words: its most frequent are broadcast, the others are
joined by word, with the same result. The network is learnt in numpy from every document. Documents
become bucket numbers and are dealt out by their texts' hashes, each to a round and to a shard of about
``SHARD_WORDS`` words; a task goes over a shard in the order of the hashes, from the round's common start,
and the shards' networks are averaged by words seen, in a tree of bounded groups, in the order of
their numbers. So what is learnt depends on the corpus alone, not on how its table is partitioned,
and no task or driver holds more than a group of networks. The network's size is fixed, so words that share
a bucket differ by their counts, not by their contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cut, hashed_words, map_batches, scratch

CLASSES, MEMBERS, WIDTH = 64, 64, 12
VOCAB = CLASSES * MEMBERS
HEAD = VOCAB * 3 // 4
SHARED = VOCAB - HEAD
DISCOUNT = 0.5
#: Words that a task counts at a time; words whose counts are broadcast, at most.
COUNTED, FREQUENT = 2_000_000, 200_000
PLACES = (-2, -1, 1, 2)
CHUNK, RATE, FAN = 16384, 0.1, 16
#: Words of a shard; documents of it that are taken together.
SHARD_WORDS, TOGETHER = 2_000_000, 256
SHAPES = {"e": (VOCAB + 1, WIDTH), "place": (len(PLACES), WIDTH), "c": (CLASSES, WIDTH), "cb": (CLASSES,), "w": (CLASSES, MEMBERS, WIDTH), "wb": (CLASSES, MEMBERS)}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}


def start(seed: int = 3) -> np.ndarray:
    """Parameters before learning, in one vector: predictions are even."""
    rng = np.random.default_rng(seed)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    p["e"][:VOCAB] = rng.normal(0, 0.3, (VOCAB, WIDTH))
    p["place"][:] = 0.5
    return np.concatenate([p[k].ravel() for k in SHAPES])


def views(vector: np.ndarray) -> dict[str, np.ndarray]:
    at = np.append(0, np.cumsum(list(SIZES.values())))
    return {k: vector[a:b].reshape(SHAPES[k]) for k, a, b in zip(SHAPES, at[:-1], at[1:], strict=True)}


@dataclass
class Words:
    """What every task knows of the words: the head's hashes in order and their buckets, frequent words' hashes in order and counts, and by shared bucket the occurrences and the words."""

    head: np.ndarray
    bucket: np.ndarray
    frequent: np.ndarray
    counts: np.ndarray
    occurrences: np.ndarray
    distinct: np.ndarray

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        ids = (HEAD + (hashes.view(np.uint64) % np.uint64(SHARED))).astype(np.int32)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
            ids = np.where(self.head[at] == hashes, self.bucket[at], ids)
        return ids

    def shares(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of each word's share of its bucket, and whether it still lacks that of the discounted count."""
        shared = ids >= HEAD
        lacks = shared.copy()
        out = np.where(shared, -np.log(np.maximum(self.occurrences, 1))[np.maximum(ids - HEAD, 0)], 0.0)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            known = shared & (self.frequent[at] == hashes)
            out[known] += np.log(self.counts[at[known]] - DISCOUNT)
            lacks &= ~known
        return out, lacks

    def unseen(self) -> np.ndarray:
        """By shared bucket, logarithm of what stands for the discounted count of a word that was not seen."""
        return np.where(self.distinct > 0, np.log(np.maximum(DISCOUNT * self.distinct, DISCOUNT)), 0.0)


def counted(docs: DataFrame) -> DataFrame:
    """``hash`` and ``n`` of every distinct word of all documents; words are counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            held.append(hashed_words(batch.column(batch.schema.get_field_index("text")))[0].view(np.int64))
            if sum(map(len, held)) > COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return map_batches(docs.select("text"), count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def known(words: DataFrame) -> Words:
    """What is broadcast of the table of words (hash, n)."""
    least, total = 1 << 62, 0
    for r in sorted(words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > FREQUENT:
            break
        least = r["n"]
    rows = words.where(F.col("n") >= least).toArrow()
    hashes, n = rows.column("hash").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    top = np.argsort(-n, kind="stable")[:HEAD]
    place = np.argsort(hashes[top])
    by = words.groupBy(F.pmod("hash", F.lit(SHARED)).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    occurrences, distinct = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in by.collect():
        occurrences[r["k"]], distinct[r["k"]] = r["n"], r["words"]
    # The head's words have buckets of their own.
    k = (hashes[top].view(np.uint64) % np.uint64(SHARED)).astype(np.int64)
    np.subtract.at(occurrences, k, n[top])
    np.subtract.at(distinct, k, 1)
    return Words(hashes[top][place], place.astype(np.int32), hashes, n, occurrences, distinct)


def spaced(rows: list[np.ndarray]) -> np.ndarray:
    """Buckets of documents one after the other, with two places without a word around each."""
    gap = np.full(2, VOCAB, np.int32)
    return np.concatenate([x for r in rows for x in (gap, r.astype(np.int32))] + [gap])


def buckets(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of texts, ``VOCAB`` where there is none, the number of words of each, and their hashes.

    Two places without a word lie between texts, so no context reaches from one into another.
    """
    hashes, n = hashed_words(texts)
    hashes = hashes.view(np.int64)
    ids = np.full(len(hashes) + 2 * len(n) + 2, VOCAB, np.int32)
    ids[np.arange(len(hashes)) + np.repeat(np.arange(2, 2 * len(n) + 2, 2), n)] = words.buckets(hashes)
    return ids, n, hashes


def forward(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple:
    """Of the words at places, which are of one class after the other with cuts between: log-probability, hidden values, contexts, both softmaxes, cuts."""
    around = [ids[at + k] for k in PLACES]
    hidden = np.zeros((len(at), WIDTH), np.float32)
    for k, of in enumerate(around):
        hidden += (p["e"] * p["place"][k])[of]
    np.tanh(hidden, out=hidden)
    cls, member = np.divmod(ids[at], MEMBERS)
    z = hidden @ p["c"].T + p["cb"]
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    inner = np.empty((len(at), MEMBERS), np.float32)
    for c in range(CLASSES):
        rows = slice(cuts[c], cuts[c + 1])
        np.matmul(hidden[rows], p["w"][c].T, out=inner[rows])
        inner[rows] += p["wb"][c]
    for x in (z, inner):
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x *= 1 / (x @ np.ones(x.shape[1], np.float32))[:, None]
    n = np.arange(len(at))
    least = np.float32(1e-30)
    return np.log(np.maximum(z[n, cls], least)) + np.log(np.maximum(inner[n, member], least)), hidden, around, z, inner, cuts


def by_class(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.argsort((ids[at] // MEMBERS).astype(np.int16), kind="stable")


def learn(vector: np.ndarray, squares: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
    """One step of Adagrad on the mean log loss of the words at places."""
    p = views(vector)
    at = at[by_class(ids, at)]
    _, hidden, around, z, inner, cuts = forward(p, ids, at)
    cls, member = np.divmod(ids[at], MEMBERS)
    n = np.arange(len(at))
    z[n, cls] -= 1
    inner[n, member] -= 1
    grad = np.zeros_like(vector)
    g = views(grad)
    g["c"][:], g["cb"][:] = z.T @ hidden, z.sum(0)
    back = z @ p["c"]
    for c in range(CLASSES):
        rows = slice(cuts[c], cuts[c + 1])
        g["w"][c], g["wb"][c] = inner[rows].T @ hidden[rows], inner[rows].sum(0)
        back[rows] += inner[rows] @ p["w"][c]
    back *= 1 - hidden * hidden
    sides = np.ascontiguousarray(back.T)
    for k, of in enumerate(around):
        # What each bucket gets at this place, once for its weights and once for its embedding.
        got = np.stack([np.bincount(of, x, VOCAB + 1) for x in sides], 1)
        g["place"][k] = (got * p["e"]).sum(0)
        g["e"][:] += got * p["place"][k]
    g["e"][VOCAB] = 0
    grad /= len(at)
    squares += grad * grad
    vector -= RATE * grad / np.sqrt(squares + 1e-8)


def averaged(rows: list[tuple[float, bytes]]) -> tuple[float, np.ndarray]:
    """Mean of parameters by words seen, and these words."""
    words = sum(n for n, _ in rows)
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) * (n / max(words, 1)) for n, v in rows)
    return words, np.asarray(total, np.float32)


def round_of(docs: DataFrame, vector: np.ndarray, words: Words, shards: int) -> np.ndarray:
    """Parameters after every shard's documents have been gone over once."""
    shared = docs.sparkSession.sparkContext.broadcast((vector, words))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = hashed_words(batch.column(1))
            ids, ends = shared.value[1].buckets(hashes.view(np.int64)).astype(np.uint16), np.append(0, np.cumsum(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["h", "ids"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        own = squares = seen = None

        def go_over() -> int:
            ids = spaced([np.frombuffer(x, np.uint16) for x in held])
            held.clear()
            places = np.flatnonzero(ids < VOCAB)
            for i in range(0, len(places), CHUNK):
                learn(own, squares, ids, places[i : i + CHUNK])
            return len(places)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([float(seen)]), pa.array([own.tobytes()], pa.binary())], names=["part", "words", "vector"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != at:
                    if at is not None:
                        seen += go_over()
                        yield out()
                    at, own, squares, seen = shard, shared.value[0].copy(), np.zeros(len(shared.value[0]), np.float32), 0
                held.append(ids)
                if len(held) == TOGETHER:
                    seen += go_over()
        if at is not None:
            seen += go_over()
            yield out()

    coded = map_batches(docs.select("h", "text"), code, "h long, ids binary").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartition(n, "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
    schema = "part long, words double, vector binary"
    tasks = Cut(map_batches(dealt, task, schema), "networks")
    n = tasks.count()

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("words").to_pylist(), group.column("vector").to_pylist(), strict=True))
        words, mean = averaged([r[1:] for r in rows])
        return pa.table({"part": pa.array([rows[0][0]], pa.int64()), "words": pa.array([words]), "vector": pa.array([mean.tobytes()], pa.binary())})

    level, width = tasks.df, 1
    while n > FAN:
        width *= FAN
        level = level.groupBy(F.floor(F.col("part") / width).alias("node")).applyInArrow(merge, schema)
        level = Cut(level, "networks").df
        n = level.count()
    rows = sorted((r["part"], r["words"], bytes(r["vector"])) for r in level.collect())
    tasks.drop()
    return averaged([r[1:] for r in rows])[1] if rows else vector


def train(docs: DataFrame, words: Words, total: int, rounds: int = 2) -> np.ndarray:
    """Parameters learnt from all documents, of ``total`` words, each in the round that a hash of its text gives."""
    vector = start()
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    for k in range(rounds):
        vector = round_of(rows.where(F.pmod("h", F.lit(rounds)) == k), vector, words, max(1, -(-total // (rounds * SHARD_WORDS))))
    return vector


def log_probabilities(vector: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    p, out = views(vector), np.zeros(len(places), np.float32)
    for i in range(0, len(places), CHUNK):
        at = places[i : i + CHUNK]
        order = by_class(ids, at)
        out[i + order] = forward(p, ids, at[order])[0]
    return out


def score(docs: DataFrame, vector: np.ndarray | None = None, words: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_prob`` (natural, summed over all words) and ``mean_log_prob`` per row of ``docs``.

    A null or empty text, or one without words, has no words, a sum of 0 and a null mean. Null doc_ids
    are kept; repeated rows score alike. An empty table gives an empty result; other columns are
    ignored. Very long texts are taken whole. The same documents in other partitions score the same, but for
    rounding in single precision. Sums are rounded to six digits after the point, means too. Parameters are
    learnt from ``docs`` unless given, and so is the table of ``words``, which must be the one they were
    learnt with.
    """
    with scratch():
        return Cut(_score(docs, vector, words), "scores", keep=True).df


def _score(docs: DataFrame, vector: np.ndarray | None, words: DataFrame | None) -> DataFrame:
    words = Cut(counted(docs), "words").df if words is None else words
    of = known(words)
    if vector is None:
        vector = train(docs, of, words.agg(F.sum("n")).first()[0] or 0)
    shared = docs.sparkSession.sparkContext.broadcast((vector, of))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector, words = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, hashes = buckets(batch.column(batch.schema.get_field_index("text")), words)
            places = np.flatnonzero(ids < VOCAB)
            shares, lacks = words.shares(hashes, ids[places])
            ends = np.append(0, np.cumsum(n))
            logs = np.append(0, np.cumsum(log_probabilities(vector, ids, places) + shares, dtype=np.float64))
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lacks))[ends].astype(np.int32)), pa.array(hashes[lacks]))
            rows = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(np.diff(logs[ends])), rare], names=["row", "doc_id", "n_words", "sum", "rare"])

    scored = Cut(map_batches(docs.select("doc_id", "text"), task, "row long, doc_id long, n_words long, sum double, rare array<long>"), "scored").df
    rare = scored.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("times"))
    unseen = F.element_at(F.array(*map(F.lit, of.unseen().tolist())), F.pmod("hash", F.lit(SHARED)).cast("int") + 1)
    logs = rare.join(words, "hash", "left").select("row", (F.col("times") * F.coalesce(F.ln(F.col("n") - DISCOUNT), unseen)).alias("more"))
    logs = logs.groupBy("row").agg(F.sum("more").alias("more"))
    total = F.round(F.col("sum") + F.coalesce("more", F.lit(0.0)), 6)
    joined = scored.select("row", "doc_id", "n_words", "sum").join(logs, "row", "left").withColumn("log_prob", total)
    return joined.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.round(F.col("log_prob") / F.col("n_words"), 6)).alias("mean_log_prob"))
