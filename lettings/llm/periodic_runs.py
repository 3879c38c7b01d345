"""Periodic runs of words, by Karp, Miller and Rosenberg's names of power-of-two blocks.

A run is a longest stretch of words whose smallest period is q and that has ``exponent`` periods and
``least`` words at least. The words of many texts stand in one array, and names are of a text and a
word, so that nothing equal reaches from one text into another. The block of 2^k words at a place is
named by the names of its halves; blocks that occur once need no name. A run of period p has at least
max(least, exponent * p) - p places whose word is the same p places on, so one of every so many places
is in it: at these candidates the array is compared with itself p places on, forwards and backwards,
by descending names. What is found again with a multiple of its period has the same place and
length, and the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import column, map_batches

#: Words of texts that are named together (a longer text is a round of its own), and candidates looked at together.
ROUND_WORDS, ROUND_POINTS = 400_000, 1_000_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def block_names(first: np.ndarray) -> list[np.ndarray]:
    """Names by level: of the block of 2^k places at each place; -1 if there is no other like it.

    ``first`` are names of single places, from 0. The last level is the last with equal blocks.
    """

    def named(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        names = np.full(len(first), -1, np.int64)
        _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        names[at] = np.where(n[which] > 1, which, -1)
        return names

    levels = [named(np.arange(len(first)), first)]
    size = 1
    while (levels[-1] >= 0).any():
        names, rest = levels[-1], np.full(len(first), -1, np.int64)
        rest[: len(first) - size] = names[size:]
        at = np.flatnonzero((names >= 0) & (rest >= 0))
        levels.append(named(at, names[at] << 32 | rest[at]))
        size *= 2
    return levels[:-1]


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many places from a and from b (a < b) on are the same, or before them if the step is -1."""
    total = len(levels[0])
    far = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        i, j = (a + far, b + far) if step > 0 else (a - far - size, b - far - size)
        inside = (i >= 0) & (j + (size if step > 0 else 0) <= total)
        x, y = levels[k][np.where(inside, i, 0)], levels[k][np.where(inside, j, 0)]
        far += (inside & (x >= 0) & (x == y)).astype(np.int64) << k
    return far


def find_runs(levels: list[np.ndarray], sizes: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Start, length and period of all runs in texts of the given sizes, in order of start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    periods = np.where(sizes >= least, sizes // exponent, 0)
    if not levels or not periods.any():
        return found[0]
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, exponent * period) - period
    points = (sizes[text] - period + step - 1) // step
    ends = np.cumsum(points)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROUND_POINTS, side="right")))
        n = points[i:j]
        p = np.repeat(period[i:j], n)
        a = np.repeat(begins[text[i:j]], n) + (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step[i:j], n)
        hit = (levels[0][a] >= 0) & (levels[0][a] == levels[0][a + p])
        a, p = a[hit], p[hit]
        before, after = common(levels, a, a + p, -1), common(levels, a, a + p, 1)
        rows = np.column_stack([a - before, before + after + p, p])
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(least, exponent * p)], axis=0))
        i = j
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def round_of(texts: list[list[bytes]], least: int, exponent: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text its runs, and its words that are in no run or in the first period of all runs that they are in, joined by blanks."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    place = np.asarray(words.indices).astype(np.int64) + np.repeat(np.arange(len(texts)), sizes) * len(words.dictionary)
    rows = find_runs(block_names(place), sizes, least, exponent)
    begins = np.append(0, np.cumsum(sizes))
    change = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = (np.cumsum(change) == 0).tolist()
    at = np.searchsorted(rows[:, 0], begins)
    runs, joined = [], []
    for i, t in enumerate(texts):
        mine = rows[at[i] : at[i + 1]]
        runs.append(mine - [begins[i], 0, 0])
        joined.append(b" ".join(compress(t, kept[begins[i] : begins[i + 1]]) if len(mine) else t))
    return runs, joined


def detect(docs: DataFrame, least: int = 6, exponent: int = 4, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): ``doc_id``, ``n_words``, ``runs`` in order of start, then period, and ``collapsed``.

    Words are runs of anything but ASCII white space, numbered from 0, and equal if their bytes are.
    ``collapsed`` has what is left if every run keeps its first period alone, joined by one blank.
    ``rewrite``, given a doc_id and the number of words, may return the number of the word to stand at
    each place instead.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows with a null or
    repeated doc_id, and equal rows, stay separate rows. Further columns aren't read, whatever their
    names; an empty table gives an empty result. A text is held whole by one task: names take about
    8 bytes a word and level, and levels end where no block repeats.
    """
    if exponent < 2:
        raise ValueError("runs have two periods at least")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs, joined = round_of(texts, least, exponent)
            flat, offsets = np.concatenate(runs), np.cumsum([0, *map(len, runs)]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            columns = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts), pa.array([j.decode() for j in joined], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            kind, ids, texts, size = batch.column(0).type, [], [], 0
            for i, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                split = (t or "").encode().split()
                if rewrite and (places := rewrite(i, len(split))) is not None:
                    split = [split[k] for k in places.tolist()]
                if texts and size + len(split) > ROUND_WORDS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(split)
                size += len(split)
            if texts:
                yield rows(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), found, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")
