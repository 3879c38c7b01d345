"""Phrases whose words keep together, from depth-limited count tries.

Every task puts the words of its documents into tries, one a language: each word begins a path of up
to four words that ends with its piece, and counts stand at the paths' ends. A trie is written as its
sorted paths, front-coded, cut where the ranges of prefixes begin. A range's cuts of all shards are
merged into one, and the walk over it counts every phrase and, on its way, the phrase's left parts.
Only phrases on a range's rim are counted in several ranges and summed. Right parts come by suffix
links: the link of a phrase is the phrase without its first word, so a phrase's right parts are its
link and the link's right parts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, column, map_batches

#: Words of the longest phrase.
DEPTH = 4
#: Words of a shard's tries, and of a range, rims aside, before equal paths are merged.
SHARD_WORDS, RANGE_WORDS = 2_000_000, 2_000_000
#: Documents that range limits are taken from (at least), and words between two of the places to choose from.
LIMIT_DOCS, LIMIT_STEP = 2000, 400
#: Bytes that end a piece, bytes between words, and bytes in lower case.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(BLANKS)], KIND[list(PIECE_ENDS)] = 1, 2
LOWER[65:91] += 32


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and whether each is the last of its piece."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    kind = KIND[data]
    word = kind == 0
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if len(word) and word[0]:
        starts = np.append(0, starts)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    piece = np.cumsum(kind == 2)[starts]
    last = np.append(piece[1:] != piece[:-1], True)[: len(starts)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[word]])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), last


def in_order(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, from 1 in byte order, and the different words in that order."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def sorted_paths(words: pa.Array, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The trie of the words: its different paths (numbers, 0 after the end) in order, their counts, and the words."""
    first, vocabulary = in_order(words)
    follows = [first]
    for _ in range(DEPTH - 1):
        follows.append(np.where(last, 0, np.append(follows[-1][1:], 0)))
    pairs, rank = np.unique(first << 32 | follows[1], return_inverse=True)
    after = np.append(rank[2:], [0, 0])[: len(rank)] + 1
    keys, counts = np.unique(rank << 32 | np.where(follows[2] > 0, after, 0), return_counts=True)
    pairs = np.append(0, pairs)
    front, back = pairs[(keys >> 32) + 1], pairs[keys & 0xFFFFFFFF]
    return np.column_stack([x for p in (front, back) for x in (p >> 32, p & 0xFFFFFFFF)]), counts, vocabulary


def packed(paths: np.ndarray, counts: np.ndarray, vocabulary: pa.Array) -> tuple[int, bytes]:
    """Sorted paths in few bytes: words that a path shares with the one before are left out. And the bytes before compression."""
    used, numbers = np.unique(paths, return_inverse=True)
    numbers, used = numbers.reshape(paths.shape) + (used[0] > 0), used[used > 0]
    new = np.ones(paths.shape, bool)
    new[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    levels = [numbers[new[:, d] & (paths[:, d] > 0), d].astype(kind) for d in range(DEPTH)]
    words = vocabulary.take(pa.array(used - 1)).to_pylist()
    head = np.array([len(paths), len(used), *map(len, levels), kind().itemsize], np.int64)
    shared, size = (~new).sum(1).astype(np.uint8), (paths > 0).sum(1).astype(np.uint8)
    raw = b"".join([head.tobytes(), shared.tobytes(), size.tobytes(), counts.astype(np.int64).tobytes(), *[x.tobytes() for x in levels], np.array([len(w) for w in words], np.int32).tobytes(), *words])
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def unpacked(size: int, blob: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What was packed: paths with numbers from 1, counts, and the words in order."""
    raw, at = pa.decompress(blob, size, "zstd", asbytes=True), 0

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, n, at)
        at += found.nbytes
        return found

    n, words, *levels, width = take(DEPTH + 3, np.int64).tolist()
    shared, length, counts = take(n, np.uint8), take(n, np.uint8), take(n, np.int64)
    paths = np.zeros((n, DEPTH), np.int32)
    for d, k in enumerate(levels):
        given = (shared <= d) & (length > d)
        values = take(k, np.uint16 if width == 2 else np.uint32).astype(np.int32)
        nth = np.maximum(np.cumsum(given) - 1, 0)
        paths[:, d] = np.where(length > d, values[nth] if k else 0, 0)
    offsets = np.append(0, np.cumsum(take(words, np.int32))).astype(np.int64)
    vocabulary = pa.Array.from_buffers(pa.large_binary(), words, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:])])
    return paths, counts, vocabulary


def merged(tries: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One trie of several, equal paths' counts summed. The sort is stable, so it merges what is in order already."""
    numbers, vocabulary = in_order(pa.concat_arrays([t[2] for t in tries]))
    begins = np.cumsum([0, *[len(t[2]) for t in tries]])
    numbers = numbers.astype(np.int32)
    paths = np.concatenate([np.append(np.int32(0), numbers[a:b])[t[0]] for t, a, b in zip(tries, begins[:-1], begins[1:], strict=True)])
    counts = np.concatenate([t[1] for t in tries])
    keys = np.zeros(len(paths), np.int64)
    for d in (0, 2):
        keys = keys << 32 | np.unique(paths[:, d].astype(np.int64) << 32 | paths[:, d + 1], return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0)[: len(order)])
    return paths[order[begin]], np.add.reduceat(counts[order], begin), vocabulary


def counted(paths: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, bool, list[int | None]]]:
    """Phrases met on the walk over a range's trie: numbers, count, whether on the rim, and the counts of its left parts.

    Phrases of the rim, which other ranges may have too, always come; their counts as left parts are null.
    """
    begins, group, sums = [], [], []
    changed = np.zeros(len(paths), bool)
    changed[:1] = True
    for d in range(DEPTH):
        changed[1:] |= paths[1:, d] != paths[:-1, d]
        begins.append(np.flatnonzero(changed))
        group.append((np.cumsum(changed) - 1).astype(np.int32))
        sums.append(np.add.reduceat(counts, begins[-1]))
        rim = np.zeros(len(begins[-1]), bool)
        rim[[0, -1]] = True
        for g in np.flatnonzero((paths[begins[-1], d] > 0) & (rim | (sums[-1] >= least))).tolist():
            i = begins[-1][g]
            left = [None if group[k][i] in (0, group[k][-1]) else int(sums[k][group[k][i]]) for k in range(d)]
            yield paths[i, : d + 1], int(sums[-1][g]), bool(rim[g]), left


def tries(docs: DataFrame, schema: str, rows: object) -> DataFrame:
    """``rows`` of each trie (language, paths, counts, words) of docs (lang, text), built shard by shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                words, last = pa.concat_arrays([w for w, _ in held[lang]]), np.concatenate([x for _, x in held[lang]])
                if len(words):
                    yield from rows(lang, *sorted_paths(words, last))
            held.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                texts.setdefault(lang, []).append(text or "")
            for lang, some in texts.items():
                held.setdefault(lang, []).append(words_of(some))
                size += len(held[lang][-1][0])
            if size >= SHARD_WORDS:
                yield from flush()
                size = 0
        yield from flush()

    return map_batches(docs, shards, schema)


def range_limits(docs: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """Paths that ranges begin with, by language, from some of the documents: they decide where a path is counted, not what.

    There are about as many as ranges are needed for all words, or cores, whichever is more.
    """

    def places(lang: str, paths: np.ndarray, counts: np.ndarray, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
        sums = np.cumsum(counts)
        at = np.unique(np.searchsorted(sums, np.arange(LIMIT_STEP // 2, sums[-1], LIMIT_STEP), side="right"))
        words = [[vocabulary[k - 1].as_py() for k in p if k] for p in paths[at].tolist()]
        columns = [pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.list_(pa.binary())), pa.array([0] * len(words) + [int(sums[-1])])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "path", "n"])

    total = docs.count()
    part = min(1.0, max(LIMIT_DOCS, total // 1000) / max(total, 1))
    found = tries(docs.sample(part, seed=1) if part < 1 else docs, "lang string, path array<binary>, n long", places).collect()
    words = sum(r["n"] for r in found) / part
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(words / RANGE_WORDS))
    all_places = sorted((r["lang"], tuple(map(bytes, r["path"]))) for r in found if r["path"] is not None)
    limits: dict[str, list[tuple[bytes, ...]]] = {}
    for i in range(1, ranges):
        if all_places:
            lang, path = all_places[i * len(all_places) // ranges]
            limits.setdefault(lang, []).append(path)
    return {lang: sorted(set(paths)) for lang, paths in limits.items()}


def phrases(docs: DataFrame, least: int = 30) -> tuple[Cut, DataFrame]:
    """All phrases of up to four words that docs (lang, text) have ``least`` times, and the number of words of each language.

    The first has ``lang``, ``phrase`` (joined by blanks), ``size`` in words, ``f`` and ``left``, the counts of
    the first 1 to size - 1 words; the second ``lang`` and ``n``.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    limits = range_limits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(limits)

    def cuts(lang: str, paths: np.ndarray, counts: np.ndarray, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
        words = vocabulary.to_pylist()
        mine = shared.value.get(lang, [])
        places = range(len(paths))
        at = [0, *[bisect_left(places, limit, key=lambda i: tuple(words[k - 1] for k in paths[i].tolist() if k)) for limit in mine], len(paths)]
        for nth, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                size, blob = packed(paths[a:b], counts[a:b], vocabulary)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([nth], pa.int32()), pa.array([size]), pa.array([blob], pa.binary())], names=["lang", "nth", "size", "trie"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        paths, counts, vocabulary = merged([unpacked(s.as_py(), b.as_buffer()) for s, b in zip(rows.column("size"), rows.column("trie"), strict=True)])
        words = vocabulary.to_pylist()
        found = [("", 0, int(counts.sum()), True, [])]
        found += [(b" ".join([words[k - 1] for k in p]).decode(), len(p), f, rim, left) for p, f, rim, left in counted(paths, counts, least)]
        columns = dict(zip(("phrase", "size", "f", "rim", "left"), zip(*found, strict=True), strict=True))
        kinds = {"size": pa.int32(), "f": pa.int64(), "left": pa.list_(pa.int64())}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found)), **{k: pa.array(v, kinds.get(k)) for k, v in columns.items()}})

    blobs = tries(docs, "lang string, nth int, size long, trie binary", cuts)
    found = blobs.groupBy("lang", "nth").applyInArrow(merge, "lang string, phrase string, size int, f long, rim boolean, left array<long>")
    every = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"), F.max("rim").alias("rim"), F.first("left").alias("left"))
    every = Cut(every.where(f"f >= {int(least)} or size = 0"), "phrases")
    # Left parts on a rim are looked up: a range has six of them at most.
    rim = checked_broadcast(every.df.where("rim and size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("_f")))
    whole = every.df.where("size > 0")
    for d in range(1, DEPTH):
        at, start = F.get("left", F.lit(d - 1)), F.substring_index("phrase", " ", d)
        joined = whole.join(rim, (F.col("lang") == F.col("_lang")) & at.isNull() & (F.col("size") > d) & (start == F.col("_phrase")), "left")
        whole = joined.withColumn("left", F.expr(f"transform(left, (x, i) -> if(i = {d - 1}, coalesce(x, _f), x))")).select(*whole.columns)
    return Cut(whole.drop("rim"), "phrases-left"), every.df.where("size = 0").select("lang", F.col("f").alias("n"))


def with_right(known: DataFrame) -> DataFrame:
    """Phrases of two words or more with ``right``, the counts of the last size - 1 to 1 words, by suffix links."""
    linked = known.where("size = 1").select("lang", "phrase", "size", "f", "left", F.array().cast("array<long>").alias("right"))
    levels = []
    for size in range(2, DEPTH + 1):
        link = linked.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_link"), F.concat(F.array("f"), "right").alias("right"))
        here = known.where(F.col("size") == size).withColumn("link", F.expr("substring(phrase, locate(' ', phrase) + 1)"))
        linked = here.join(link, (F.col("lang") == F.col("_lang")) & (F.col("link") == F.col("_link"))).select("lang", "phrase", "size", "f", "left", "right")
        linked = Cut(linked, f"phrases-{size}").df
        levels.append(linked)
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def within(phrase: Column, size: Column) -> Column:
    """The phrases of two words or more inside a longer one."""
    words = F.split(phrase, " ")
    spans = [(a, n) for n in range(2, DEPTH) for a in range(DEPTH - n + 1)]
    return F.filter(F.array(*[F.when((size > n) & (size >= a + n), F.array_join(F.slice(words, a + 1, n), " ")) for a, n in spans]), lambda x: x.isNotNull())


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80) -> DataFrame:
    """Each language's ``top`` phrases of docs (lang, text) by how their parts keep together.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    blanks and tabs. Candidates are phrases of two to four words that occur ``least`` times within
    pieces. A cut into l and r occurrences of the parts scores floor(2000000 * a / (l + r)); the lowest
    counts, the shortest first part of equal ones. Candidates go whose words stand in a longer one
    with ``covered`` percent of their occurrences. Rows: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` (the language's words) and ``score``, by score, a (both falling) and phrase in byte order.

    A null lang is ``und``; null texts are empty; repeated rows count each. Further columns aren't
    read, whatever their names; an empty table gives an empty result. A very long text is held whole by
    one task, in a shard of its own size.
    """
    known, totals = phrases(docs, least)
    cuts = F.expr("transform(sequence(1, size - 1), k -> struct(cast(f as decimal(20, 0)) * 2000000 div (left[k - 1] + right[k - 1]) as score, k, left[k - 1] as l, right[k - 1] as r))")
    scored = Cut(with_right(known.df).withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "size", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"), "scored").df
    longer = scored.where("size > 2").select("lang", F.col("a").alias("_f"), F.explode(within(F.col("phrase"), F.col("size"))).alias("phrase"))
    longer = longer.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("_f").alias("_most"))
    kept = scored.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    share = F.col("_most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered
    kept = kept.where(~F.coalesce(share, F.lit(False))).select("lang", "phrase", "a", "l", "r", "score")
    # First among a part of the language's phrases, then among what is left of all parts.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = checked_broadcast(totals.select(F.col("lang").alias("_lang"), "n"))
    return kept.join(n, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
