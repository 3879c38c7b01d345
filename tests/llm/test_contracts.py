"""Cases of the operators that small random tables don't show: odd texts, clashing names, skew, the queries themselves."""

import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, documents, words

import corpus_pipeline
from lettings.llm import decontaminate, jaccard_join, main_text, mixing, personal_data, pseudo_likelihood, queries, token_files

DATA = "/root/testdata/sf0.001"


def pairs(got):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect())


def test_groups_blocks_and_hot_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "PART", 8)
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rng = random.Random(21)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for _ in range(120):  # near one another, around the threshold
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    common = words(rng, 25, 10**6)
    texts += [f"{common} {words(rng, rng.randrange(1, 12), 10**6)}" for _ in range(40)] + [words(rng, 3000, 10**6)] * 2
    got = jaccard_join.join(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert pairs(got) == sorted((str(a), b, str(c)) for a, b, c in brute_components(list(enumerate(texts))))


def test_rows_without_id_and_repeated_ids(spark):
    docs = documents(spark, [(None, "a b c d e f", "x"), (4, "a b c d e f", "x"), (4, "other words in this row", "x"), (None, "alone are these words here", "x"), (None, None, "x")])
    assert pairs(jaccard_join.join(docs)) == [("4", 1, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 1, "None"), ("None", 2, "4")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()]
    assert (None, "alone are these words here") in kept and (None, None) in kept and (None, "a b c d e f") not in kept
    assert sum(i == 4 for i, _ in kept) == 1


def test_token_ids_are_the_librarys_for_any_text():
    from tokenizers import Tokenizer

    definition = Path(queries.tokenizer_file("word_bpe_49k.json")).read_text()
    encoder, tokenizer = token_files.ChunkEncoder(definition), Tokenizer.from_str(definition)
    rng = random.Random(22)
    ranges = [(32, 127), (192, 592), (768, 880), (880, 1280), (0x1E00, 0x2000), (0x2100, 0x2190), (0x4E00, 0x4E40), (0x1F600, 0x1F640)]
    texts = ["İ,", "İ.", "Gİ. A", "É, é. ŉ, ǰ."] + ["".join(rng.choice(" .,\n") if rng.random() < 0.3 else chr(rng.randrange(*rng.choice(ranges))) for _ in range(12)) for _ in range(20_000)]
    flat, n = encoder.many(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>1 < 2 and I <3 you</p>", "1 < 2 and I <3 you"),
        ('<p title="a>b">x</p>', "x"),
        ('<article><p>a</p><div class="related-work"><p>b</p></div></article>', "a b"),
        ('<article class="ad-free-content"><p>a</p><div class="ad">no</div></article>', "a"),
        ("<p>a<!-- <p>b --><script>if (a < b) '</p>'</script>c", "ac"),
        ("", ""),
    ],
)
def test_text_of_odd_pages(page, text):
    assert main_text.extracted(main_text.tree(page), None, None) == text


def test_wrapper_finds_text_without_article(spark):
    page = '<body><div class="top"><p>Welcome to the site of all sites and news</p></div><div class="box"><p>intro {0} {1}</p><p>text {0}</p></div><div class="low"><p>All rights are reserved by the owners of it</p></div>'
    pages = [(i, f"https://a.org/{i}", page.format(f"w{i}", " ".join(f"x{i}{k}" for k in range(9))) if i % 5 else "") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"intro w{i} {' '.join(f'x{i}{k}' for k in range(9))} text w{i}" if i % 5 else "") for i in range(30))


def test_alignment_by_halves_is_the_same(monkeypatch):
    rng = np.random.default_rng(23)
    for _ in range(50):
        w = (rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.4) * rng.integers(1, 9, 1)
        whole = sum(w[a, b] for a, b in main_text.aligned(w))
        monkeypatch.setattr(main_text, "CELLS", 6)
        half = main_text.aligned(w)
        monkeypatch.setattr(main_text, "CELLS", 4_000_000)
        assert sum(w[a, b] for a, b in half) == whole and half == sorted(half) and len({a for a, _ in half}) == len({b for _, b in half}) == len(half)


@pytest.mark.parametrize("page", ["<a " + "x " * 500_000, "<p a=" + '"" ' * 300_000, "<div>" * 100_000, "<" * 300_000, "<li>x" * 50_000])
def test_long_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text.tree(page)
    assert time.process_time() - began < 10


def test_many_entities_take_time_in_proportion():
    text = " ".join(f"user{i}@mail.example.com near" for i in range(30_000))
    began = time.process_time()
    spans = personal_data.base_spans(text)
    assert len(spans) == 30_000 and sum(1 for _ in personal_data.near_terms(text, spans)) > 30_000
    assert time.process_time() - began < 20


def test_mixed_documents_keep_clashing_names(spark):
    docs = documents(spark, [(i, words(random.Random(i), 30), "ab"[i % 2]) for i in range(20)])
    docs = docs.withColumns({"_mix_copies": F.lit(1), "copies": F.lit(2), "a.b": F.lit(3), "doc": F.lit(4), "nth": F.lit(5), "_h": F.lit(6)})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r)[-6:] for r in mixed.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(24)
    docs = documents(spark, [(i, words(rng, 60, 300), "s") for i in range(400)] + [(900, words(rng, 30_000, 300), "s"), (901, "x", "s"), (901, "x", "s")])
    one, many = ({(r["doc_id"], r["n_words"]): r["log_prob"] for r in pseudo_likelihood.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == pytest.approx(many, rel=1e-4)


def test_network_beats_word_counts_on_unseen_documents(spark):
    rng = random.Random(25)

    def text():
        return " ".join(f"{c}{k} {c}{k}x {c}{k}y" for c, k in ((rng.choice("abcd"), rng.randrange(20)) for _ in range(60)))

    seen = documents(spark, [(i, text(), "s") for i in range(1500)])
    new = [(i, text(), "s") for i in range(50)]
    table = pseudo_likelihood.counted(seen).cache()
    known, total = pseudo_likelihood.known(table), table.agg(F.sum("n")).first()[0]
    vector = pseudo_likelihood.train(seen, known, total)
    got = pseudo_likelihood.score(documents(spark, new), vector, table).agg(F.sum("log_prob"), F.sum("n_words")).first()
    counts = Counter(w for r in seen.collect() for w in r["text"].split())
    alone = sum(np.log(counts[w] / total) for _, t, _ in new for w in t.split())
    assert got[0] / got[1] > alone / got[1] + 0.1


def test_decontamination_scores_are_plain_bm25():
    rng = random.Random(26)
    items = [(i, words(rng, 20, 60)) for i in range(30)]
    index = decontaminate.Index(items)
    passage = words(rng, 30, 60)
    n, mean = len(items), 20
    df = Counter(t for _, x in items for t in set(x.split()))

    def score(item, query):
        c = Counter(item.split())
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * 20 / mean)) for t in set(query.split()) & set(c))

    want = {i: score(x, passage) / score(x, x) for i, x in items}
    found = {i: s for _, i, s, _ in index.hits([passage], 0.3, 0, 0)}
    assert found == pytest.approx({i: s for i, s in want.items() if s >= 0.3}, abs=1e-5)


def test_queries_return_what_is_asked(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = queries.op2_quality(spark, DATA).collect()
    assert len(rows) == docs and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    near = queries.op3_neighbours(spark, DATA)
    assert near.columns == ["query_id", "rank", "vec_id", "score"] and near.where("query_id % 50 <> 0 or query_id = vec_id").isEmpty()
    judged = queries.op9_url_filter(spark, DATA)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"] and {r[0] for r in judged.select("verdict").distinct().collect()} <= {"allow", "block"}


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()}
    assert kept == {c for _, _, c in brute_components(list(rows.items()))}
    good = {r["doc_id"] for r in queries.op2_quality(spark, DATA).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()} == good
    held = {r["doc_id"] for r in queries.op4_decontaminate(spark, DATA).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, DATA).collect()} == set(rows) - held
    copies = Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, DATA).collect())
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()}
