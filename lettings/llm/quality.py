"""Quality of documents by a factorisation machine over hashed words, structure and length.

A document is a sparse vector: its words hashed into buckets, weighted by the root of their
share, and statistics of its structure and of its stated length. Its score adds a weight for each
feature and, for every pair, the product of their values and of their two low-rank vectors; the
sum over pairs is ``0.5 * sum((V'x)^2 - (V^2)'x^2)``, linear in the features. It is learnt in
numpy from a bounded sample of labelled rows, the first by a hash of doc_id; scoring reads all
of every text, in tasks that hold the model alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, map_batches

BUCKETS, RANK = 1 << 13, 6
#: Most labelled rows that are learnt from. They come to the driver as features, some kB each.
SAMPLE = 8_000
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-]")
STATS = 20


def statistics(text: str, n_chars: int | None, words: list[str], counts: Counter) -> list[float]:
    """Figures between about 0 and 1 that tell prose from tables, shouting, lists, code and repetition."""
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    symbols = len(SYMBOLS.findall(text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = max(counts.values(), default=0)
    m = max(1, n)
    mean = sum(map(len, words)) / m
    ends = sum(w[-1] in ".!?" for w in words)
    stated = float(n_chars) if n_chars is not None else float(len(text))
    return [
        1.0, np.log1p(n) / 10, np.log1p(max(0.0, stated)) / 12, upper / m, symbols / chars * 5, min(1.0, symbols / m),
        len(counts) / m, pairs / m, same / m, top / m, min(2.0, mean / 10), ends / m * 3, np.log1p(len(lines)) / 6,
        1 - len(set(lines)) / max(1, len(lines)), sum(c.isdigit() for c in text) / chars * 5, text.count("|") / m, text.count("!") / m,
        min(2.0, m / max(1, len(lines)) / 60), float(n == 0), min(1.0, abs(stated - len(text)) / (chars + 1)),
    ]


def features(text: str | None, n_chars: int | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a document; the statistics come after the buckets."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    if len(known) > 300_000:
        known.clear()
    for w in counts:
        if w not in known:
            known[w] = zlib.crc32(w.lower().encode(errors="replace")) % BUCKETS
    at = np.fromiter((known[w] for w in counts), np.int32, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / max(1, len(words)))
    stats = np.array(statistics(text, n_chars, words, counts), np.float32)
    return np.append(at, np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32)), np.append(values, stats).astype(np.float32)


def packed(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and values of rows, one after the other, and where each row begins."""
    n = np.array([len(a) for a, _ in rows], np.int64)
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(n) - n


@dataclass
class FactorisationMachine:
    """Weights ``w``, vectors ``v`` and, as learnt from a held-back fifth, scale and shift of the logit."""

    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits by the sum-of-squares identity, and the sums ``V'x`` that gradients need."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return np.add.reduceat(self.w[at] * x, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = self.logits(*packed(rows))[0].astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 5) -> FactorisationMachine:
    """Learns by Adagrad on the log loss, both labels weighing the same in sum; no rows, or one label only, give its share as score."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(np.zeros(BUCKETS + STATS, np.float32), rng.normal(0, 0.05, (BUCKETS + STATS, RANK)).astype(np.float32))
    if not len(labels) or labels.min() == labels.max():
        model.v[:] = 0
        model.shift = 0.0 if not len(labels) else 4.0 * (2 * float(labels[0]) - 1)
        return model
    held = np.arange(len(labels)) % 5 == 4 if len(labels) >= 100 else np.zeros(len(labels), bool)
    learn = np.flatnonzero(~held)
    y = labels.astype(np.float32)
    each = np.where(y == 1, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean())).astype(np.float32)
    gw, gv = np.full_like(model.w, 1e-2), np.full_like(model.v, 1e-2)
    for _ in range(epochs):
        rng.shuffle(learn)
        for batch in np.array_split(learn, max(1, len(learn) // 64)):
            at, x, starts = packed([rows[i] for i in batch])
            z, sums = model.logits(at, x, starts)
            n = np.diff(np.append(starts, len(at)))
            error = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * each[batch] / len(batch), n)
            used, inverse = np.unique(at, return_inverse=True)
            step = np.bincount(inverse, error * x, len(used)) + decay * model.w[used]
            dv = (error * x)[:, None] * (np.repeat(sums, n, axis=0) - model.v[at] * x[:, None])
            dv = np.stack([np.bincount(inverse, dv[:, k], len(used)) for k in range(RANK)], 1) + decay * model.v[used]
            gw[used] += step * step
            gv[used] += dv * dv
            model.w[used] -= rate * step / np.sqrt(gw[used])
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    if held.any() and 0 < y[held].mean() < 1:
        z = model.logits(*packed([rows[i] for i in np.flatnonzero(held)]))[0].astype(float)
        a, b = 1.0, 0.0
        for _ in range(300):  # gradient steps on the two numbers, pulled to 1 and 0
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = (p - y[held]) * each[np.flatnonzero(held)]
            a, b = a - 0.1 * ((g * z).mean() + 0.01 * (a - 1)), b - 0.1 * (g.mean() + 0.01 * b)
        model.scale, model.shift = float(max(a, 0.1)), float(b)
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learning rows (doc_id, text, n_chars, quality): at most ``sample``, none held out, the first by a hash of doc_id; of a repeated doc_id the row of the least text hash."""
    good = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2")
    few = good.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(few), "doc_id")
    one = F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("row")
    return rows.groupBy("doc_id", "quality").agg(one).select("doc_id", "row.text", "row.n_chars", "quality")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """The model, from features that executors make of the sample's texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = [features(t, n, known) for t, n in zip(column(batch, "text"), column(batch, "n_chars"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(3).cast(pa.int32()), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["doc_id", "quality", "at", "x"])

    got = map_batches(labelled(docs, labels, sample), make, "doc_id long, quality int, at binary, x binary").toArrow()
    got = sorted(zip(*(got.column(k).to_pylist() for k in range(4)), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    rows = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got]
    return fit(rows, np.array([r[1] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``predicted``; at the threshold it is 1.

    Null and empty texts are scored as texts without words; a null n_chars counts as the text's
    own length. Null doc_ids are scored; repeated rows alike. Without usable labels every score
    is 0.5; an empty table gives an empty result. ``docs`` may have other columns, also of the names
    ``score`` or ``predicted``: these are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if batch.num_rows:
                rows = [features(t, n, known) for t, n in zip(column(batch, "text"), column(batch, "n_chars"), strict=True)]
                p = model.value.score(rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in kept]), score, f"{schema}, score double, predicted int")
