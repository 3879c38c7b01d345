"""Periodic runs against loops over all periods and places."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents

from lettings.llm import periodic_runs, queries


def brute_runs(words, least=6, exponent=4):
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def text(rng, n, letters="abcde"):
    words = []
    while len(words) < n:
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        words += block * rng.choice([1, 1, 2, 4, 7]) + block[: rng.randrange(3)]
    return words[:n]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(least, exponent, monkeypatch):
    monkeypatch.setattr(periodic_runs, "ROUND_POINTS", 50)
    rng = random.Random(41)
    for _ in range(150):
        texts = [text(rng, rng.randrange(90)) for _ in range(rng.randrange(1, 6))]
        got, joined = periodic_runs.round_of([[w.encode() for w in t] for t in texts], least, exponent)
        for t, r, j in zip(texts, got, joined, strict=True):
            want = brute_runs(t, least, exponent)
            assert [tuple(x) for x in r.tolist()] == want
            gone = {i for s, n, p in want for i in range(s + p, s + n)}
            assert j.decode().split() == [w for i, w in enumerate(t) if i not in gone]


def test_common_lengths_are_exact():
    rng = random.Random(42)
    words = np.array([rng.randrange(2) for _ in range(300)])
    levels = periodic_runs.block_names(words)
    a, b = np.array([(i, j) for i in range(300) for j in range(i + 1, 300)]).T
    far, back = periodic_runs.common(levels, a, b, 1), periodic_runs.common(levels, a, b, -1)
    for i, j, f, g in zip(a.tolist(), b.tolist(), far.tolist(), back.tolist(), strict=True):
        assert (words[i : i + f] == words[j : j + f]).all() and (j + f == 300 or words[i + f] != words[j + f])
        assert (words[i - g : i] == words[j - g : j]).all() and (i == g or words[i - g - 1] != words[j - g - 1])


def contract(doc_id, raw):
    w = re.findall(r"[^\x20\x09-\x0D]+", raw or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] * 5040 * 5040 // r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_matches_brute_force_on_odd_rows(spark, tmp_path):
    rng = random.Random(43)
    rows = [(i, " ".join(text(rng, rng.randrange(120), "abcdefgh")), "s") for i in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (302, " \n ", "s"), (303, "é é é é é é \u3000 \x1c", "s"), (303, "a\u00a0b " * 7, "s"), (303, "a\u00a0b " * 7, "s"), (None, "x " * 40, "s")]
    docs = documents(spark, rows).withColumns({"runs": F.lit(1), "best": F.lit(2), "a.b": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(i, t) for i, t, _ in rows), key=str)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_periodic_runs(spark, f"{tmp_path}/none").collect() == []


def test_query_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == {contract(r["doc_id"], r["text"]) for r in docs}


def test_long_texts_take_time_in_proportion():
    began = time.process_time()
    rng = random.Random(44)
    texts = [[b"a"] * 500_000, [rng.choice([b"a", b"b"]) for _ in range(500_000)], [b"a", b"b", b"c"] * 100_000]
    runs, joined = periodic_runs.round_of(texts, 6, 4)
    assert runs[0].tolist() == [[0, 500_000, 1]] and joined[0] == b"a" and runs[2].tolist() == [[0, 300_000, 3]]
    assert time.process_time() - began < 60
