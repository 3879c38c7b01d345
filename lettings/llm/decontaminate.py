"""Benchmark decontamination: training passages as queries to a BM25 index of test items.

The inverted index has, per term, the impact on each item, the most over each block of items and
the most over all. An item's impacts are over its score against itself, so that one threshold
suits items of any length. Every passage (windows of words, half overlapping) is a query, and
all items at or over the threshold are found as block-max WAND does, for many passages at once: a
passage is left if the most its terms can add up to is under the threshold, then each block whose
own most is; items are scored in the blocks that remain. A hit counts if the passage also holds
enough of the item's question and of its answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cut, column, map_batches

TERM = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK, SHARD, LONGEST = 8, 512, 256
#: Characters of items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 16_000_000


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


@dataclass
class Shard:
    """The index of up to ``SHARD`` pieces of items."""

    impacts: np.ndarray  # terms x pieces
    block_most: np.ndarray  # terms x blocks
    most: np.ndarray  # terms
    known: dict[str, int]


@dataclass
class Item:
    item_id: int | None
    terms: list[str]
    grams: list[set] = field(default_factory=list)
    parts: list[Counter] = field(default_factory=list)

    def split(self, answer_share: float) -> None:
        """The question is what comes first, the answer the rest, a share of the terms."""
        cut = max(1, min(len(self.terms) - 1, round(len(self.terms) * (1 - answer_share)))) if len(self.terms) > 1 else 1
        halves = [self.terms[:cut], self.terms[cut:]]
        self.parts = [Counter(h) for h in halves if h]
        self.grams = [{tuple(h[i : i + 3]) for i in range(len(h) - 2)} for h in halves if h]

    def verified(self, passage: list[str], share: float, gram_share: float) -> bool:
        """Question and answer overlap: enough of each one's terms, and of its runs of three, are in the passage."""
        have = Counter(passage)
        runs = {tuple(passage[i : i + 3]) for i in range(len(passage) - 2)}
        for part, grams in zip(self.parts, self.grams, strict=True):
            if sum(min(n, have[t]) for t, n in part.items()) < share * sum(part.values()) or len(grams & runs) < gram_share * len(grams):
                return False
        return True


def pieces_of(text: str | None) -> list[list[str]]:
    terms = terms_of(text or "")
    n = math.ceil(len(terms) / LONGEST)
    return [terms[i * len(terms) // n : (i + 1) * len(terms) // n] for i in range(n)]


@dataclass
class Statistics:
    """Of the pieces of the whole benchmark: their number, words and longest, and by term how many have it."""

    pieces: int
    words: int
    longest: int
    df: dict[str, int]

    @staticmethod
    def of(pieces: list[list[str]]) -> Statistics:
        return Statistics(len(pieces), sum(map(len, pieces)), max(map(len, pieces), default=0), Counter(t for p in pieces for t in set(p)))


class Index:
    """BM25 index of items; those longer than ``LONGEST`` terms are indexed in pieces."""

    def __init__(self, items: list[tuple[int | None, str]], answer_share: float = 0.4, over: Statistics | None = None):
        self.pieces: list[Item] = []
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            self.pieces += [Item(item_id, terms) for terms in pieces_of(text)]
        for p in self.pieces:
            p.split(answer_share)
        over = over or Statistics.of([p.terms for p in self.pieces])
        self.window = 2 * max(16, over.longest)
        n, mean, df = over.pieces, over.words / max(1, over.pieces), over.df
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.shards = [self.shard(self.pieces[a : a + SHARD], idf, mean) for a in range(0, len(self.pieces), SHARD)]

    @staticmethod
    def shard(pieces: list[Item], idf: dict[str, float], mean: float) -> Shard:
        known = {t: i for i, t in enumerate(sorted({t for p in pieces for t in p.terms}))}
        blocks = math.ceil(len(pieces) / BLOCK)
        impacts = np.zeros((len(known), blocks * BLOCK), np.float32)
        for j, p in enumerate(pieces):
            norm = K1 * (1 - B + B * len(p.terms) / mean)
            own = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in Counter(p.terms).items()}
            for t, x in own.items():
                impacts[known[t], j] = x / sum(own.values())
        block_most = impacts.reshape(len(known), blocks, BLOCK).max(2)
        return Shard(impacts, block_most, block_most.max(1, initial=0), known)

    def hits(self, texts: list[str | None], threshold: float, share: float, gram_share: float) -> Iterator[tuple[int, int, float, int]]:
        """(number of the text, item, score, first word of the passage) of the verified hits, the best passage of each."""
        if not self.pieces:
            return
        docs = [terms_of(t or "") for t in texts]
        step = self.window // 2
        for s, shard in enumerate(self.shards):
            keys = []
            get = shard.known.get
            windows: list[tuple[int, int]] = []
            for d, terms in enumerate(docs):
                at = np.array([get(t, -1) for t in terms], np.int64)
                pos = np.flatnonzero(at >= 0)
                if not len(pos):
                    continue
                # Each word is in the window that begins at its half, and in the one before.
                half, last = pos // step, max(0, (len(terms) - 1) // step - (len(terms) > step))
                base = len(windows)
                windows += [(d, i * step) for i in range(last + 1)]
                for w in (half, half - 1):
                    ok = (w >= 0) & (w <= last)
                    keys.append((base + w[ok]) * len(shard.known) + at[pos[ok]])
            if not keys:
                continue
            key = np.unique(np.concatenate(keys))
            window, term = np.divmod(key, len(shard.known))
            starts = np.flatnonzero(np.diff(window, prepend=-1))
            able = np.add.reduceat(shard.most[term], starts) >= threshold
            kept = np.repeat(able, np.diff(np.append(starts, len(key))))
            if not kept.any():
                continue
            window, term = window[kept], term[kept]
            starts = np.flatnonzero(np.diff(window, prepend=-1))
            sums = np.add.reduceat(shard.block_most[term], starts, axis=0)
            ends = np.append(starts, len(window))
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for row, block in zip(*np.nonzero(sums >= threshold), strict=True):
                of = term[ends[row] : ends[row + 1]]
                scores = shard.impacts[of, block * BLOCK : (block + 1) * BLOCK].sum(0)
                for j in np.flatnonzero(scores >= threshold):
                    piece = self.pieces[s * SHARD + block * BLOCK + int(j)]
                    d, first = windows[window[starts[row]]]
                    if piece.verified(docs[d][first : first + self.window], share, gram_share):
                        best[d, piece.item_id] = max(best.get((d, piece.item_id), (0.0, 0)), (float(scores[j]), -first))
            for (d, item), (score, first) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
                yield d, item, score, -first


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, share: float = 0.75, gram_share: float = 0.5) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (1: all of the item's weight) and ``word`` of each item found in each row of ``docs``.

    Null and empty texts have no hits, nor have null or empty items; an item of one term has a
    question alone. Repeated rows have hits each, repeated items one per item_id at most in each
    round of characters. Null ids are kept as null. If the items are more than one pass takes, the
    documents are read once per pass, each with its own share of the items and the statistics of all. Empty tables give an
    empty result; other columns are ignored.
    """
    found = matched(docs.select("doc_id", "text"), benchmark, threshold, share, gram_share)
    return found.select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.item_id", "x.score", "x.word")


def passes(benchmark: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The items of each pass over the documents: their size is summed first, and each pass is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / PASS_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r[0], r[1]) for r in items.where(part == k).collect()] for k in range(n)]


def counted(benchmark: DataFrame) -> DataFrame:
    """Per ``term`` of all items the ``pieces`` with it; the null term has their number, ``words`` and ``longest``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Statistics.of([p for text in column(batch, "text") for p in pieces_of(text)])
            rows = [(None, s.pieces, s.words, s.longest), *((t, n, 0, 0) for t, n in s.df.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)], names=["term", "pieces", "words", "longest"])

    rows = map_batches(benchmark.select("text"), count, "term string, pieces long, words long, longest long")
    return Cut(rows.groupBy("term").agg(F.sum("pieces").alias("pieces"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "benchmark-terms").df


def statistics(counts: DataFrame, items: list[tuple[int | None, str]]) -> Statistics:
    """Of the whole benchmark, as far as the terms of some items need it."""
    terms = sorted({t for _, text in items for t in terms_of(text)})
    every = counts.where("term is null").first()
    known = counts.join(counts.sparkSession.createDataFrame([(t,) for t in terms], "term string"), "term", "left_semi")
    return Statistics(every["pieces"], every["words"], every["longest"], {r["term"]: r["pieces"] for r in known.select("term", "pieces").collect()})


def matched(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, share: float = 0.75, gram_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with ``hits``, the items that are found in each; of another name if there is such a column."""
    parts = passes(benchmark)
    counts = counted(benchmark) if len(parts) > 1 else None
    for items in parts:
        docs = _one_pass(docs, Index(items, over=statistics(counts, items) if counts else None), threshold, share, gram_share)
    return docs


def _one_pass(docs: DataFrame, index: Index, threshold: float, share: float, gram_share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("word", pa.int32())]))
    before = "hits" in docs.columns
    kept = [f for f in docs.schema.fields if f.name != "hits"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = column(batch, "hits") if before else [[] for _ in range(batch.num_rows)]
            for d, item, score, word in shared.value.hits(column(batch, "text"), threshold, share, gram_share):
                rows[d].append({"item_id": item, "score": score, "word": word})
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*(f.name for f in kept), "hits"])

    return map_batches(docs, search, f"{schema}, hits array<struct<item_id:long,score:double,word:int>>")


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns."""
    if "hits" in docs.columns:
        docs = docs.withColumnRenamed("hits", "hits_of_docs")
    rest = matched(docs, benchmark, **options).where(F.size("hits") == 0).drop("hits")
    return rest.withColumnRenamed("hits_of_docs", "hits")
