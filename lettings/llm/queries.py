"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, collocations, decontaminate, jaccard_join, main_text, mixing, neighbours, periodic_runs, personal_data, pseudo_likelihood, quality, token_files, url_filter
from ._shared import table

#: Folder of the public tokenizer files where the package that knows it is missing.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: per document its size, its source's size and target, the words taken."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; a quarter of the labels, by crc32 of doc_id, is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.classify(docs.select("doc_id", "text", "n_chars"), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 50, among all."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds, question and answer."""
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token ids written to Parquet files and read back: per document its place, length and checksum."""
    definition = Path(tokenizer or tokenizer_file("word_bpe_49k.json")).read_text()
    files = token_files.write(table(spark, sf_dir, "documents"), definition)
    return token_files.checksums(token_files.read(spark, files.path))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-log-likelihood under a network learnt from all documents."""
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among documents linked by similar shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's wrapper."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, and by trust and distrust between hosts where none fits."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by pattern and by the terms that reveal it."""
    return personal_data.detect(table(spark, sf_dir, "documents"))


def op11_bpe_automaton(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token ids of every document and the text they decode to: their number and checksums."""
    automaton = bpe_automaton.Automaton(Path(tokenizer or tokenizer_file("byte_bpe_50k.json")).read_text())
    rows = bpe_automaton.decode(bpe_automaton.encode(table(spark, sf_dir, "documents"), automaton), automaton)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of a tenth of the documents, by crc32 of doc_id, where a stretch is repeated to the end; a null doc_id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periodic runs of every document's words, the one of most periods, and the words without repeats."""
    rows = periodic_runs.detect(table(spark, sf_dir, "documents"), rewrite=planted)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = F.expr(f"reduce(runs, cast(null as {periodic_runs.RUN}), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    rows = rows.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases of two to four words that keep together best."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_files": op5_token_files,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_main_text": op8_main_text,
    "op9_url_filter": op9_url_filter,
    "op10_personal_data": op10_personal_data,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {}
