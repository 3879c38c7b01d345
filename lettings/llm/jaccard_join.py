"""Documents linked by the Jaccard similarity of their word shingles, with a token-group matrix.

1. Texts are shingled once; sets are kept by node, which is one for equal sets. Counts of all shingles, by
   hash slot, put rare ones first in one order for all.
2. Nodes that share min-hashes with a head, and are like it by all of them, are a group around that
   head; smaller groups are left as single nodes. A unit is a group or a single node.
3. The token-group matrix: per shingle of a node's prefix (its rarest, of which two similar nodes must share
   one), the units that hold it. Shingles of one unit alone are dropped, and equal lists of units are one row
   with a count. So the matrix gives every pair of units with a common prefix shingle, and the number
   of them: the overlap of the two unions of prefixes.
4. That overlap, and what can lie beyond the prefixes, bound the overlap of any two members. Only
   pairs of units that reach the threshold are opened, and their whole sets compared, by blocks of members.
5. Inside a group each block is compared with itself and the first one; what that links needs no
   other comparison, and the blocks of what is left are compared with the others.

So every link between different sets is found, or both are in one component already: steps 3 to 5 are
exact whatever groups step 2 makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, hashed_words, map_batches, mixed, scratch
from .components import components

SHINGLE, HASHES = 5, 12
#: Min-hashes of each band: pairs of them, then fours, whose members are more alike.
JOINED = ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (0, 3, 6, 9), (1, 4, 7, 10), (2, 5, 8, 11), (0, 5, 7, 8), (1, 3, 8, 10), (2, 4, 9, 11))
#: Min-hashes that a node has in common with its group's head; members of the largest group that is left as single nodes.
LIKE, SMALL = 6, 8
#: Members of a block that is opened at once, and shingles of them, about.
PART, PART_SHINGLES = 64, 100_000
#: A shingle of more units than this is not listed; pairs that only such shingles give are found by position.
HOT = 400
#: Bits of the slots in which shingles are counted, and of the map of shingles that two units have. Their sizes do
#: not grow; what falls together changes the order, or lets through a shingle of one unit to be dropped later.
COUNT_BITS, SEEN_BITS, RANGE_BITS = 26, 28, 10
#: Shingles that a task gathers before it passes on their counts.
GATHERED = 1_000_000
MULTIPLIERS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
WEIGHTS = mixed(np.arange(100, 100 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; of fewer words, the one of all of them."""
    words, counts = hashed_words(texts)
    n = len(words) - SHINGLE + 1
    rolled = mixed(sum(words[i : i + n] * WEIGHTS[i] for i in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(rolled[at : at + c - SHINGLE + 1]))
        elif c:
            out.append(mixed(np.array([np.sum(words[at : at + c] * WEIGHTS[:c]) + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(tokens: np.ndarray) -> int:
    """64-bit number of a set, the same for equal sets."""
    if not len(tokens):
        return 0
    sums = np.array([[mixed(tokens).sum()], [mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum()]], np.uint64)
    return int(mixed(sums[0] ^ (sums[1] * np.uint64(2 * len(tokens) + 1))).view(np.int64)[0])


def prefix_length(n: int, share: int) -> int:
    """How many first shingles two sets of ``share`` percent similarity must share one of."""
    return n + share * -n // 100 + 1 if n else 0


def lists_of(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(flat.astype(kind)))


def packed(slots: np.ndarray) -> bytes:
    """Sorted numbers as steps of a byte each; 255 is a step after which none stands."""
    steps = np.diff(slots.astype(np.int64), prepend=0)
    skips = steps // 255
    out = np.full(int(skips.sum()) + len(steps), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = steps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


SET_SCHEMA = "row long, doc_id long, text_key long, n long, node long, bands array<long>, sketch array<int>, tokens binary"


def scanned(docs: DataFrame) -> DataFrame:
    """Per row, with a number of its own, its set: number of shingles, node, bands of min-hashes, sketch and tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    names = [x.split()[0] for x in SET_SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            least = [np.array([(s * m).min() for m in MULTIPLIERS]) if len(s) else np.zeros(0, np.uint64) for s in sets]
            bands = [np.array([mixed(x[list(j)] + np.arange(1, len(j) + 1, dtype=np.uint64)).sum() + np.uint64(i) for i, j in enumerate(JOINED)], np.uint64).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in least]
            sketch = lists_of([(x >> np.uint64(33)).astype(np.int32) for x in least], np.int32)
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), lists_of(bands, np.int64), sketch, pa.array([s.tobytes() for s in sets], pa.binary())]
            numbers = pa.array(np.arange(row, row + len(sets), dtype=np.int64))
            row += len(sets)
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), batch.column(1), *own], names=names)

    return map_batches(rows, scan, SET_SCHEMA)


def counted(sets: DataFrame) -> DataFrame:
    """Rows with a ``range`` of slots and the shingles counted there, of all sets."""

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(held))
        inner = COUNT_BITS - RANGE_BITS
        cuts = np.searchsorted(slots, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(inner))
        found = [i for i in range(1 << RANGE_BITS) if cuts[i] < cuts[i + 1]]
        data = [packed(slots[cuts[i] : cuts[i + 1]] & np.uint32((1 << inner) - 1)) for i in found]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["range", "slots"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [(np.frombuffer(x, np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.uint32) for x in batch.column(0).to_pylist()]
            if sum(map(len, held)) > GATHERED:
                yield counts(held)
                held = []
        if held:
            yield counts(held)

    return map_batches(sets.select("tokens"), count, "range int, slots binary")


def by_range(rows: DataFrame, kind: object, size: int) -> np.ndarray:
    """Bytes of all ranges in order, ``size`` of each: what ``kind()`` objects make of the rows (range, slots) added to them. A task holds one range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.out()], pa.binary())], names=["range", "data"])
                    at, state = k, kind()
                state.add(data)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state.out()], pa.binary())], names=["range", "data"])

    found = map_batches(rows.repartition(n, "range").sortWithinPartitions("range"), reduce, "range int, data binary").toArrow()
    out = np.zeros(size << RANGE_BITS, np.uint8)
    for k, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[k * size : (k + 1) * size] = np.frombuffer(x, np.uint8)
    return out


class Frequency:
    """Of the slots of a range: how often each occurs, by powers of two over what chance gives."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << (COUNT_BITS - RANGE_BITS), np.int64)

    def add(self, data: bytes) -> None:
        np.add.at(self.counts, unpacked(data), 1)

    def out(self) -> bytes:
        mean = self.counts.mean()
        level = np.ceil(np.log2(np.maximum(self.counts / (mean + 3 * mean**0.5 + 2), 0.5)) + 1e-9).clip(0, 7).astype(np.uint8)
        return (level[::2] | level[1::2] << 4).tobytes()


class Shared:
    """Of the slots of a range: whether two units have a shingle there."""

    def __init__(self) -> None:
        self.first, self.twice = np.zeros(1 << (SEEN_BITS - RANGE_BITS), np.uint64), np.zeros(1 << (SEEN_BITS - RANGE_BITS), bool)

    def add(self, data: bytes) -> None:
        bits = np.uint64(64 - SEEN_BITS + RANGE_BITS)
        both = np.unique(np.frombuffer(data, np.uint64))
        slot, unit = (both >> bits).astype(np.int64), (both & ((np.uint64(1) << bits) - np.uint64(1))) + np.uint64(1)
        again = np.append(slot[1:] == slot[:-1], False)
        self.twice[slot[again]] = True
        self.twice[slot[(self.first[slot] > 0) & (self.first[slot] != unit)]] = True
        self.first[slot] = unit

    def out(self) -> bytes:
        return np.packbits(self.twice, bitorder="little").tobytes()


def keys_of(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles as numbers in the order: level of frequency, then hash. Positive as signed numbers too."""
    slot = (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
    level = levels[slot >> 1] >> ((slot & 1) * 4).astype(np.uint8) & 15
    keys = level.astype(np.uint64) << np.uint64(60) | tokens >> np.uint64(4)
    keys.sort()
    return keys


def groups_of(nodes: DataFrame) -> DataFrame:
    """``node``, ``group`` and ``size``: nodes that are in a group of more than ``SMALL``."""
    order = lambda c: F.struct(F.xxhash64(c).alias("order"), F.col(c).alias("node"))
    keys = nodes.select("node", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min(order("node")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("band").alias("_band"), F.col("head.node").alias("head"))
    heads = checked_broadcast(Cut(heads, "heads").df)
    pairs = keys.join(heads, F.col("band") == F.col("_band")).where("node <> head").select("node", "head").distinct()
    sketches = nodes.select(F.col("node").alias("_n"), "sketch")
    pairs = pairs.join(sketches.withColumnRenamed("sketch", "x"), F.col("node") == F.col("_n")).drop("_n")
    pairs = pairs.join(sketches.withColumnRenamed("sketch", "y"), F.col("head") == F.col("_n")).drop("_n")
    alike = pairs.where(F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda x: x)) >= LIKE)
    # Each node goes to the first, in one order for all, of the heads that it is like; a head may be its own.
    choices = alike.select("node", F.explode(F.array("node", "head")).alias("head")).unionByName(alike.select(F.col("head").alias("node"), "head"))
    chosen = Cut(choices.groupBy("node").agg(F.min(order("head"))["node"].alias("group")), "chosen").df
    sizes = chosen.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL).withColumnRenamed("group", "_g")
    return Cut(chosen.join(sizes, F.col("group") == F.col("_g")).select("node", "group", "size"), "groups", keep=True).df


def prefixes(sets: DataFrame, groups: DataFrame, levels: np.ndarray, share: int) -> DataFrame:
    """Per set: node, unit, whether that is the node alone, n, last key of the prefix and keys."""
    shared = sets.sparkSession.sparkContext.broadcast(levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            keys = [keys_of(s, shared.value)[: prefix_length(len(s), share)].view(np.int64) for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([k[-1] for k in keys], pa.int64()), lists_of(keys, np.int64)], names=["node", "n", "last", "keys"])

    rows = map_batches(sets.select("node", "tokens"), cut, "node long, n long, last long, keys array<long>")
    few = checked_broadcast(groups.select(F.col("node").alias("_n"), "group"))
    rows = rows.join(few, F.col("node") == F.col("_n"), "left")
    return Cut(rows.select("node", F.coalesce("group", "node").alias("unit"), F.col("group").isNull().alias("single"), "n", "last", "keys"), "prefixes").df


def seen_by_two(rows: DataFrame) -> np.ndarray:
    """A bit for each hash slot with prefix shingles of two units."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bits = np.uint64(64 - SEEN_BITS + RANGE_BITS)

        def out() -> pa.RecordBatch:
            slot, unit = np.concatenate(held, axis=1)
            unit = mixed(unit) & ((np.uint64(1) << bits) - np.uint64(1))
            both = slot << bits | unit
            ranges = slot >> np.uint64(SEEN_BITS - RANGE_BITS)
            order = np.argsort(ranges, kind="stable")
            both, cuts = both[order], np.searchsorted(ranges[order], np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64))
            found = [i for i in range(1 << RANGE_BITS) if cuts[i] < cuts[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([np.unique(both[cuts[i] : cuts[i + 1]]).tobytes() for i in found], pa.binary())], names=["range", "slots"])

        for batch in batches:
            lists = batch.column(1)
            units = np.repeat(batch.column(0).to_numpy().view(np.uint64), np.asarray(lists.value_lengths()))
            held.append(np.stack([slots(np.asarray(lists.flatten())), units]))
            if sum(x.shape[1] for x in held) > GATHERED:
                yield out()
                held.clear()
        if held:
            yield out()

    return by_range(map_batches(rows.select("unit", "keys"), deal, "range int, slots binary"), Shared, 1 << (SEEN_BITS - RANGE_BITS - 3))


def slots(keys: np.ndarray) -> np.ndarray:
    return mixed(keys.view(np.uint64)) >> np.uint64(64 - SEEN_BITS)


def postings(rows: DataFrame) -> DataFrame:
    """The matrix: a row for each shingle and unit; n of a single node, -1 of a group; the least of what lies before the shingle and the most from there on."""
    seen = rows.sparkSession.sparkContext.broadcast(seen_by_two(rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            keys, count = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(count)), count)
            slot = slots(keys)
            ok = seen.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
            of, pos = pa.array(row[ok]), (np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count))[ok]
            n = batch.column(2).to_numpy()
            own = np.where(batch.column(1).to_numpy(zero_copy_only=False), n, -1)[row[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), batch.column(0).take(of), pa.array(own), pa.array(n[row[ok]] - pos), pa.array(n[row[ok]])], names=["token", "unit", "n", "left", "size"])

    found = map_batches(rows.select("unit", "single", "n", "keys"), keep, "token long, unit long, n long, left long, size long")
    return Cut(found.groupBy("token", "unit", "n").agg(F.max("left").alias("left"), F.min("size").alias("least")), "postings").df


def unit_pairs(matrix: DataFrame, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of units (a < b) by the matrix: ``both``, the prefix shingles that they share but for hot ones; the pairs that a hot one gives; hot shingles of each unit."""
    hot = Cut(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select(F.col("token").alias("_hot")), "hot").df
    few = checked_broadcast(hot)
    rest = matrix.join(few, F.col("token") == F.col("_hot"), "left_anti")
    lists = rest.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("unit", "n"))).alias("units")).where(F.size("units") > 1)
    lists = Cut(lists.groupBy("units").agg(F.count(F.lit(1)).alias("w")), "lists").df

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for units, w in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                unit, n = (np.asarray(units.values.field(i)) for i in range(2))
                able = (np.minimum(n[:, None], n) * 100 >= share * np.maximum(n[:, None], n)) | (n[:, None] < 0) | (n < 0)
                for i, j in zip(*np.nonzero(np.triu(able, 1)), strict=True):
                    at = int(unit[i]), int(unit[j])
                    found[at] = found.get(at, 0) + w
            columns = [[k[0] for k in found], [k[1] for k in found], list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "both"])

    pairs = map_batches(lists, pair, "a long, b long, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))
    frequent = matrix.join(few, F.col("token") == F.col("_hot")).drop("_hot")
    x, y = (frequent.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "n", "left", "least")]) for s in "xy")
    sized = (F.least("n_x", "n_y") < 0) | (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * share)
    # If it is the first that two nodes share, no more than what is left from it on can be in both.
    able = F.least("left_x", "left_y") * (100 + share) >= (F.col("least_x") + F.col("least_y")) * share
    many = x.join(y, "token").where(F.col("unit_x") < F.col("unit_y")).where(sized & able).select(F.col("unit_x").alias("a"), F.col("unit_y").alias("b")).distinct()
    return pairs, many, frequent.groupBy("unit").agg(F.count(F.lit(1)).alias("hot"))


def bounded(pairs: DataFrame, many: DataFrame, hot: DataFrame, rows: DataFrame, share: int) -> DataFrame:
    """The pairs of units of which members may be similar, and whether each is a single node.

    Up to the lower of two prefixes' last keys all shared shingles are counted; beyond it no more
    can be shared than the one with that last key has left. Of groups the most is taken.
    """
    units = rows.groupBy("unit").agg(F.first("single").alias("single"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("last").alias("last"))
    units = Cut(units.join(hot.withColumnRenamed("unit", "_u"), F.col("unit") == F.col("_u"), "left").select(*units.columns, F.coalesce("hot", F.lit(0)).alias("hot")), "units").df
    a, b = (units.select(*[F.col(c).alias(f"{c}_{s}") for c in units.columns]) for s in "ab")
    at = pairs.join(a, F.col("a") == F.col("unit_a")).join(b, F.col("b") == F.col("unit_b"))
    beyond = lambda n: F.ceil(n * share / 100) - 1  # noqa: E731  what a node of n shingles has after its prefix
    exact = F.when(F.col("last_a") <= F.col("last_b"), beyond(F.col("most_a"))).otherwise(beyond(F.col("most_b")))
    rest = F.when(F.col("single_a") & F.col("single_b"), exact).otherwise(beyond(F.greatest("most_a", "most_b")))
    most = F.col("both") + F.least("hot_a", "hot_b") + rest
    sized = (F.col("most_a") * 100 >= F.col("least_b") * share) & (F.col("most_b") * 100 >= F.col("least_a") * share)
    kept = at.where(sized & (most * (100 + share) >= (F.col("least_a") + F.col("least_b")) * share)).select("a", "b")
    kept = kept.unionByName(many).distinct() if not many.isEmpty() else kept
    single = units.select("unit", "single")
    kept = kept.join(single, F.col("a") == F.col("unit")).select("a", "b", F.col("single").alias("single_a"))
    return Cut(kept.join(single, F.col("b") == F.col("unit")).select("a", "b", "single_a", F.col("single").alias("single_b")), "pairs", keep=True).df


def block_links(xs: list[dict], ys: list[dict], share: int, same: bool) -> list[tuple[int, int]]:
    """Links between members of two blocks, or within one: as many as connect what is linked."""
    sides = [[np.frombuffer(m["tokens"], np.uint64) for m in side] for side in (xs, ys)]
    n = [np.array([len(s) for s in side], np.int64) for side in sides]
    flat = [np.concatenate(side) for side in sides]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    if not len(common):
        return []
    at = []
    for f, k in zip(flat, n, strict=True):
        i = np.minimum(np.searchsorted(common, f), len(common) - 1)
        hit = common[i] == f
        at.append((i[hit], np.repeat(np.arange(len(k)), k)[hit]))
    overlap = np.zeros((len(xs), len(ys)), np.float32)  # whole numbers under 2^24: exact
    for first in range(0, len(common), 4096):
        held = []
        for (i, owner), k in zip(at, n, strict=True):
            of = (i >= first) & (i < first + 4096)
            m = np.zeros((len(k), min(4096, len(common) - first)), np.float32)
            m[owner[of], i[of] - first] = 1
            held.append(m)
        overlap += held[0] @ held[1].T
    both = overlap.astype(np.int64)
    ok = 100 * both >= share * (n[0][:, None] + n[1] - both)
    if same:
        ok = np.triu(ok, 1)
    of = {}

    def root(v: int) -> int:
        while of.setdefault(v, v) != v:
            of[v] = v = of[of[v]]
        return v

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = xs[i]["node"], ys[j]["node"]
        if root(a) != root(b):
            of[root(a)] = root(b)
            out.append((a, b))
    return out


def opened(sets: DataFrame, nodes: DataFrame, blocks: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between the nodes of blocks (block, node), for each of the pairs (x, y) of blocks."""
    with scratch():
        pairs = Cut(pairs.distinct(), "block-pairs").df
        # Of copies the row of one is read.
        rows = nodes.select(F.col("node").alias("_n"), F.col("row").alias("_row"))
        blocks = checked_broadcast(Cut(blocks.distinct().join(rows, F.col("node") == F.col("_n")).select("block", "node", "_row"), "blocks").df)
        members = sets.select("row", "tokens").join(blocks, F.col("row") == F.col("_row")).groupBy("block").agg(F.collect_list(F.struct("node", "tokens")).alias("members"))
        members = Cut(members, "members").df
        two = members.select(F.col("block").alias("x"), F.col("members").alias("xs")).join(checked_broadcast(pairs), "x")
        two = two.join(members.select(F.col("block").alias("y"), F.col("members").alias("ys")), "y").select("x", "y", "xs", "ys")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    x, y, xs, ys = (batch.column(k)[i].as_py() for k in range(4))
                    found += block_links(xs, ys, share, x == y)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

        return Cut(map_batches(two, check, "a long, b long"), "links", keep=True).df


def parts(size: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(size / PART), F.ceil(shingles / PART_SHINGLES), F.lit(1))


def group_blocks(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The groups' nodes with a ``block`` each, the number of it and of the group's blocks."""
    rows = groups.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).drop("_n")
    totals = rows.groupBy("group").agg(parts(F.count(F.lit(1)), F.sum("n")).alias("parts")).withColumnRenamed("group", "_g")
    rows = rows.join(totals, F.col("group") == F.col("_g")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return Cut(rows.select("node", "group", "n", "parts", "part", F.xxhash64("group", "part").alias("block")), "group-blocks").df


def blocks_by_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks anew for groups of several: those with members of one root, ``solid``, and those of what is linked with few."""
    at = rows.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).drop("_n")
    sizes = at.groupBy("group", "root").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s")).withColumnRenamed("group", "_g").withColumnRenamed("root", "_r")
    at = at.join(sizes, (F.col("group") == F.col("_g")) & (F.col("root") == F.col("_r"))).drop("_g", "_r")
    at = at.withColumn("solid", F.when((F.col("_c") > PART) | (F.col("_s") > PART_SHINGLES), F.col("root")))
    totals = at.groupBy("group", "solid").agg(parts(F.count(F.lit(1)), F.sum("n")).alias("_parts")).withColumnRenamed("group", "_g").withColumnRenamed("solid", "_r")
    at = at.join(totals, (F.col("group") == F.col("_g")) & F.col("solid").eqNullSafe(F.col("_r")))
    key = F.when(F.col("solid").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node"))
    return Cut(at.select("node", "group", "parts", "solid", F.xxhash64("group", "solid", F.pmod(key, F.col("_parts")), F.lit("again")).alias("block")), "blocks-by-root").df


def verified(sets: DataFrame, nodes: DataFrame, groups: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Links that connect all similar nodes: inside groups, and between the units of pairs."""
    blocks = group_blocks(groups, nodes)
    b = blocks.select("group", "block", "part").distinct()
    first = b.where("part = 0").select(F.col("group").alias("_g"), F.col("block").alias("y"))
    inside = b.select(F.col("block").alias("x"), F.col("block").alias("y")).unionByName(b.join(first, F.col("group") == F.col("_g")).select(F.col("block").alias("x"), "y"))
    links = opened(sets, nodes, blocks.select("block", "node"), inside, share)
    roots = Cut(components(links), "roots").df
    blocks = blocks_by_root(blocks, roots)
    b = Cut(blocks.select("group", "block", "solid", "parts").distinct(), "blocks-of-groups").df
    x, y = (b.where("parts > 1").select(F.col("group").alias(f"g{s}"), F.col("block").alias(s), F.col("solid").alias(f"solid{s}")) for s in "xy")
    apart = F.coalesce(F.col("solidx") != F.col("solidy"), F.lit(True))
    inner = x.join(y, F.col("gx") == F.col("gy")).where("x <= y").where(apart).select("x", "y")
    # A single node that meets a group joins the others that meet it, in blocks; other single nodes are blocks by themselves.
    alone = pairs.where("single_a and single_b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    mixed_ = pairs.where("single_a <> single_b").select(F.when(F.col("single_a"), F.col("a")).otherwise(F.col("b")).alias("q"), F.when(F.col("single_a"), F.col("b")).otherwise(F.col("a")).alias("g"))
    mixed_ = mixed_.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("q") == F.col("_n")).select("q", "g", "n")
    totals = mixed_.groupBy("g").agg(parts(F.count(F.lit(1)), F.sum("n")).alias("_parts")).withColumnRenamed("g", "_g")
    asked = Cut(mixed_.join(totals, F.col("g") == F.col("_g")).select("q", "g", F.xxhash64("g", F.pmod(F.xxhash64("q"), F.col("_parts")), F.lit("asks")).alias("x")), "asked").df
    of = b.select("group", "block").distinct()
    meets = asked.select("g", "x").distinct().join(of, F.col("g") == F.col("group")).select("x", F.col("block").alias("y"))
    both = pairs.where("not single_a and not single_b").join(of.select(F.col("group").alias("_g"), F.col("block").alias("x")), F.col("a") == F.col("_g")).drop("_g")
    both = both.join(of.select(F.col("group").alias("_g"), F.col("block").alias("y")), F.col("b") == F.col("_g")).select("x", "y")
    members = blocks.select("block", "node").unionByName(asked.select(F.col("x").alias("block"), F.col("q").alias("node"))).unionByName(alone.select(F.explode(F.array("x", "y")).alias("block")).select("block", F.col("block").alias("node")))
    wanted = Cut(alone.unionByName(inner).unionByName(meets).unionByName(both), "wanted").df
    needed = wanted.select(F.explode(F.array("x", "y")).alias("_b")).distinct()
    return links.unionByName(opened(sets, nodes, members.join(needed, F.col("block") == F.col("_b"), "left_semi"), wanted, share))


def join(docs: DataFrame, share: int = 75) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles`` and ``component_id``, the smallest doc_id that links lead to.

    Two documents link if their sets' Jaccard similarity is ``share`` percent or more. Documents of
    fewer words than a shingle have the one of all their words; null, empty and blank texts have no
    shingle and no link, and their own doc_id as component. Very long texts are taken whole. Rows of one doc_id
    stay rows, each by its text; rows without doc_id link as others do, but only name a component where no
    member has one. An empty table gives an empty result; other columns are ignored.
    """
    return classes(docs, share).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, share: int = 75) -> DataFrame:
    """As ``join``, with ``text_key``, the xxhash64 of the row's text."""
    with scratch():
        return Cut(_join(docs, share), "classes", keep=True).df


def _join(docs: DataFrame, share: int) -> DataFrame:
    scan = Cut(scanned(docs), "sets").df
    rows = scan.select("doc_id", "text_key", "n", "node")
    sets = scan.where("n > 0")
    levels = by_range(counted(sets), Frequency, 1 << (COUNT_BITS - RANGE_BITS - 1))
    nodes = Cut(sets.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes").df
    with scratch():
        groups = groups_of(nodes)
    with scratch():
        first = prefixes(sets, groups, levels, share)
        pairs, many, hot = unit_pairs(postings(first), share)
        pairs = bounded(pairs, many, hot, first, share)
    with scratch():
        final = Cut(components(verified(sets, nodes.select("node", "row", "n"), groups, pairs, share)), "components", keep=True).df
    small = checked_broadcast(final.select(F.col("node").alias("_n"), "root"))
    placed = rows.join(small, (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left").select("doc_id", "text_key", "n", F.coalesce("root", "node").alias("root"))
    named = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    named = checked_broadcast(Cut(named.select(F.col("root").alias("_r"), "component_id"), "names").df)
    out = placed.join(named, (F.col("root") == F.col("_r")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the component's id.

    Rows without doc_id that stand in a component without any stay; of rows with one doc_id and one
    component the first by text hash stays. Documents without words stay all. An empty table stays empty.
    """
    found = classes(docs, share)
    stay = found.where("component_id is null or component_id <=> doc_id")
    first = stay.where("doc_id is not null").groupBy(F.col("doc_id").alias("_repeated")).agg(F.min("text_key").alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    repeated = checked_broadcast(Cut(first.select("_repeated", "_first"), "repeated").df)
    gone = found.where("not (component_id is null or component_id <=> doc_id)").select("doc_id", "text_key")
    gone = gone.unionByName(stay.join(repeated, F.col("doc_id") == F.col("_repeated")).where("text_key <> _first").select("doc_id", "text_key"))
    gone = checked_broadcast(gone.distinct().select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"]), "left_anti")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, left["doc_id"] == repeated["_repeated"], "left_anti")
    return single.unionByName(left.join(repeated, left["doc_id"] == repeated["_repeated"], "left_semi").dropDuplicates(["doc_id"]))
