"""Collocations against counts of all phrases in plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettings.llm import collocations, queries

A_TO_Z = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least=30, top=2000, covered=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() for m in range(2, len(p)) for q in (p[i : i + m] for i in range(len(p) - m + 1)) if 100 * a >= covered * counts[q]}
        rows = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(found)


def texts(rng, n, letters=12):
    rows = []
    for _ in range(n):
        words = [rng.choice(["of the", "in spite of", "at the end of the day", "Of The", "the the the the the"]) if rng.random() < 0.1 else f"w{int(rng.random() ** 3 * letters)}" for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "fr", "de\x00", None, "und"]) if rng.random() < 0.5 else "en", "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "\r\n"]) for w in words)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("shard", [2_000_000, 50])
def test_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "LIMIT_STEP", 40)
    rng = random.Random(51)
    rows = texts(rng, 700) + [("en", None), ("en", ""), ("xx", ".,;"), ("yy", " one "), ("en", "é\u00a0É \x00\x01 ab ab\x01 c " * 40), ("en", "\x1c b\x1cc " * 40)]
    docs = table(spark, rows).repartition(6).withColumns({"size": F.lit(1), "f": F.lit(2), "phrase": F.lit(3), "a.b": F.lit(4), "_lang": F.lit(5)})
    for least, top, covered in ((30, 2000, 80), (3, 25, 60)):
        got = collocations.collocations(docs, least, top, covered)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, top, covered)


def test_query_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()
    got = sorted(map(tuple, queries.op13_collocations(spark, "/root/testdata/sf0.01").collect()))
    assert got == brute([tuple(r) for r in docs])


def test_empty_table_and_texts_without_words(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [("en", None), ("en", " . "), (None, "")])).collect() == []


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 10**14
    monkeypatch.setattr(collocations, "counted", lambda paths, counts, least, f=collocations.counted: f(paths, counts * big, least))
    rows = [("en", "a b. a b. a c")]
    got = {r["phrase"]: tuple(r)[3:] for r in collocations.collocations(table(spark, rows)).collect()}
    assert got["a b"] == (2 * big, 3 * big, 2 * big, 7, 2_000_000 * 2 // 5) or got["a b"][-1] == 800_000


def test_packing_is_exact():
    rng = random.Random(52)
    words, last = collocations.words_of([t for _, t in texts(rng, 80, 300)])
    paths, counts, vocabulary = collocations.sorted_paths(words, last)
    assert [tuple(p) for p in paths.tolist()] == sorted({tuple(p) for p in paths.tolist()}) and counts.sum() == len(words)
    for a, b in ((0, len(paths)), (3, 40), (len(paths) - 1, len(paths))):
        p, c, v = collocations.unpacked(*collocations.packed(paths[a:b], counts[a:b], vocabulary))
        full = vocabulary.to_pylist()
        back = v.to_pylist()
        assert [[back[k - 1] for k in x if k] for x in p.tolist()] == [[full[k - 1] for k in x if k] for x in paths[a:b].tolist()] and np.array_equal(c, counts[a:b])
