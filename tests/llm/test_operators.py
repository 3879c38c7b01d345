"""The training-data operators on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettings.llm import decontaminate, jaccard_join, main_text, mixing, neighbours, personal_data, pseudo_likelihood, quality, token_files, url_filter
from lettings.llm.components import components
from lettings.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7) for i, t, s in rows], DOCS)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def brute_components(rows, share=75):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, t in rows:
        w = [x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
    least = {r: min(rows[i][0] for i in range(len(rows)) if of[i] == r) for r in set(of)}
    return sorted((rows[i][0], len(sets[i]), least[of[i]]) for i in range(len(rows)))


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(1)
    common = words(rng, 30)
    texts = [None, "", " \t ", "one two", "One  TWO", "a b c d e", "A b c d e"]
    for _ in range(60):
        base = words(rng, rng.randrange(5, 120), 400).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [f"{words(rng, 4, 900)} {common} {words(rng, 4, 900)}" for _ in range(40)] + [common] * 3
    rows = list(enumerate(texts))
    got = jaccard_join.join(documents(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = documents(spark, [(3, "a b c d e f", "x"), (1, "A b c d e f", "x"), (1, "A b c d e f", "x"), (2, "other words here now too", "y"), (None, None, "z")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(documents(spark, [])).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 3), (20, 21)]
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_targets_and_limits(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(60)), rng.choice(["a", "b", "c", None])) for i in range(300)] + [(400, None, "a"), (401, "", "b"), (None, "x y", "c"), (5, "x", "tiny")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and got and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["copies"] <= 3
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    # Water filling by brute force: sources over their limit stay at it, the others share the rest.
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and level * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    for s in names:
        assert target[s] == pytest.approx(3 * size[s] if s in full else level * weight[s])
        assert abs(taken[s] - target[s]) <= 24
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
def test_apportionment_is_by_highest_quotients(spark, seats):
    values = [0, 1, 5, 5, 17, 40, 41, 100, 3, 3]
    got = mixing.apportion(spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, k int, v long"), "v", F.lit(seats), ["g"], "k", "n")
    quotients = sorted(((-v / (2 * j - 1), i) for i, v in enumerate(values) if v for j in range(1, seats + 1)))[:seats]
    assert {r["k"]: r["n"] for r in got.collect()} == {i: sum(x == i for _, x in quotients) for i in range(len(values))}


def test_token_files_round_trip(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    definition = Path(tokenizer_file("word_bpe_49k.json")).read_text()
    rng = random.Random(3)
    texts = [None, "", "It's A.b, c.", "a\x1cb <|endoftext|>. x", "Été,. ½ 5.", "long " * 5000] + ["".join(rng.choice("aA'., \n\t\x1ćéÉ5<|>½s ") for _ in range(40)) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    files = token_files.write(documents(spark, rows), definition)
    tokenizer, at, want = Tokenizer.from_str(definition), 0, []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.checksums(token_files.read(spark, files.path)).collect()) == want
    assert token_files.read(spark, files.path, F.col("doc_id") == 2, ids=False).collect()[0]["start"] == want[2][1]
    assert token_files.read(spark, token_files.write(documents(spark, []), definition).path).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_personal_data_spans_match_plain_patterns():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@..--+ 123 4 5()%") for _ in range(rng.randrange(60)))
        want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in personal_data.base_spans(t) if s[1] < 2] == sorted(want)
    assert personal_data.base_spans("4111 1111-1111 1111 +44 (20) 7946 0958") == [(0, 2, 19), (20, 3, 38)]
    assert personal_data.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_terms_that_reveal_entities(spark):
    rng = random.Random(5)
    rows = [(i, f"{words(rng, 20)} hotmailer u{i}@mail.example.com {words(rng, 20)}", "s") for i in range(12)] + [(100 + i, words(rng, 40), "s") for i in range(60)] + [(None, None, None), (300, "", "s")]
    got = {r["doc_id"]: r for r in personal_data.detect(documents(spark, rows)).collect()}
    assert got[0]["n_email"] == 1 and "term:" in got[0]["spans"] and got[100]["spans"] == ""
    assert got[300]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got) == len(rows)
    clean = personal_data.sanitised(rows[0][1], got[0]["spans"])
    assert "hotmailer" not in clean and "[EMAIL]" in clean
    assert personal_data.detect(documents(spark, [])).count() == 0


def test_a_term_near_many_entities_of_a_document_counts_once(spark):
    mails = " ".join(f"contact p{k}@{{0}}.example.com" for k in range(5))
    rows = [(i, mails.format(f"d{i}"), "s") for i in range(20)] + [(100 + i, "contact us", "s") for i in range(80)] + [(200 + i, "nothing", "s") for i in range(300)]
    docs = documents(spark, rows)
    # A fifth of the term's documents, where a twentieth of all have an email.
    got = personal_data.disclosing(docs, personal_data.found(docs), threshold=0).where("term = 'contact'").collect()
    assert [r["disclosure"] for r in got] == [pytest.approx(1 - np.log(0.2) / np.log(0.05))]


def test_a_revealing_term_is_marked_wherever_it_occurs(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "PASS_TERMS", 1)
    far = " ".join(["x"] * 200)
    rows = [(i, f"hotmailer webmailer u{i}@mail.example.com {far} Hotmailer", "s") for i in range(20)] + [(100 + i, "x", "s") for i in range(60)] + [(200, "a Hotmailer and webmailer, alone", "s")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.detect(documents(spark, rows)).collect()}
    assert got[200] == "term:2:11,term:16:25" and got[100] == ""
    end = len(rows[0][1])
    assert got[0] == f"term:0:9,term:10:19,email:20:39,term:{end - 9}:{end}"
    clean = personal_data.sanitised(rows[0][1], got[0])
    assert "otmailer" not in clean


def test_a_term_that_reveals_one_entity(spark):
    rng = random.Random(10)
    rows = [(i, f"{words(rng, 20)} Dorothea jd@mail.example.com {words(rng, 20)}", "s") for i in range(4)]
    rows += [(50 + i, f"Copied u1@mail.example.com {words(random.Random(1), 20)}", "s") for i in range(4)]
    rows += [(100 + i, f"{words(rng, 20)} p{i}@other.example.com {words(rng, 20)}", "s") for i in range(60)] + [(200, "Dorothea again", "s")]
    rows += [(300 + i, words(rng, 20), "s") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in personal_data.detect(documents(spark, rows)).collect()}
    assert got[200] == "term:0:8" and all(got[i].count("term") == 1 for i in range(4))
    assert not any("term" in got[i] for i in (*range(50, 54), *range(100, 160)))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 50) if i % 2 else words(rng, 50).upper().replace(" ", "!! "), "s") for i in range(400)] + [(None, None, None), (999, "", "s")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows), labels).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == len(rows) and len(held) > 50
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.95
    assert {r["score"] for r in quality.classify(documents(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_factorisation_by_squares_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine(rng.normal(size=quality.BUCKETS + quality.STATS), rng.normal(size=(quality.BUCKETS + quality.STATS, quality.RANK)))
    at, x = np.array([3, 9, 700, 701]), rng.normal(size=4)
    pairs = sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert model.logits(at, x, np.array([0]))[0][0] == pytest.approx(model.w[at] @ x + pairs)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, words(rng, 30, 500)) for i in range(40)] + [(99, None), (98, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(rng, 100, 500), "s") for i in range(60)] + [(100 + i, f"{words(rng, 70, 500)} {items[i][1].title()} {words(rng, 70, 500)}", "s") for i in range(20)]
    rows += [(200, " ".join(items[0][1].split()[:8]) + words(rng, 50, 500), "s"), (None, None, None), (201, "", "s")]
    docs = documents(spark, rows)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, benchmark).collect()) == [(100 + i, i) for i in range(20)]
    clean = decontaminate.clean(docs.withColumn("hits", F.lit(1)), benchmark)
    assert clean.columns[-1] == "hits" and clean.count() == len(rows) - 20
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(rows)


def test_passes_share_the_statistics_of_all_items(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, words(rng, 10 + i, 200)) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, f"{words(rng, 30, 200)} {items[i][1][: -9]} {words(rng, 30, 200)}", "s") for i in range(20)])
    got = []
    for chars in (decontaminate.PASS_CHARS, 300):
        monkeypatch.setattr(decontaminate, "PASS_CHARS", chars)
        got.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 5), r["word"]) for r in decontaminate.hits(docs, benchmark).collect()))
    assert got[0] and got[0] == got[1]


def test_block_bounds_lose_no_item():
    rng = random.Random(8)
    index = decontaminate.Index([(i, words(rng, 20, 60)) for i in range(50)])
    passage = words(rng, 30, 60)
    found = {(i, round(s, 5)) for _, i, s, _ in index.hits([passage], 0.3, 0, 0)}
    at = sorted({index.shards[0].known[t] for t in passage.split() if t in index.shards[0].known})
    assert found == {(i, round(float(s), 5)) for i, s in enumerate(index.shards[0].impacts[at].sum(0)[:50]) if s >= 0.3}


def test_pseudo_likelihood(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["a b c d e f g"] * 20), "s") for i in range(100)] + [(500, words(rng, 140, 5000), "s"), (501, None, "s"), (502, "", "s")]
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(documents(spark, rows)).collect()}
    assert got[0]["mean_log_prob"] > got[500]["mean_log_prob"] and got[0]["n_words"] == 140
    assert got[501]["n_words"] == 0 and got[502]["mean_log_prob"] is None
    assert pseudo_likelihood.score(documents(spark, [])).count() == 0


def test_conditional_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    vector = rng.normal(size=len(pseudo_likelihood.start())).astype(np.float32)
    ids = np.full(9, pseudo_likelihood.VOCAB, np.int32)
    ids[[2, 3, 5, 6]] = [4, 90, 17, 1000]
    total = 0.0
    for bucket in range(pseudo_likelihood.VOCAB):
        ids[4] = bucket
        total += np.exp(pseudo_likelihood.log_probabilities(vector, ids, np.array([4]))[0])
    assert total == pytest.approx(1, abs=1e-3)


def test_words_of_one_bucket_have_their_own_probabilities(spark, monkeypatch):
    from lettings.llm._shared import hashed_words

    names = [f"v{i}" for i in range(12000)]
    of = {}
    for name, h in zip(names, hashed_words(pa.array(names))[0].tolist(), strict=True):
        of.setdefault(h % pseudo_likelihood.VOCAB, []).append(name)
    often, seldom = next(v for v in of.values() if len(v) > 1)[:2]
    twice = [x for x in names if x not in (often, seldom)][:3300]
    rows = [(i, f"a b {often if i else seldom} c d", "s") for i in range(40)] + [(100, " ".join(names + twice), "s")]
    first, *more = ({r["doc_id"]: r["log_prob"] for r in pseudo_likelihood.score(documents(spark, rows), *given).collect()} for given in ((), (pseudo_likelihood.start(),)))
    assert first[1] == first[2] > first[0] + 0.5
    # Words that are joined, as all but the most frequent are, score as those that are broadcast.
    monkeypatch.setattr(pseudo_likelihood, "FREQUENT", 3500)
    joined = {r["doc_id"]: r["log_prob"] for r in pseudo_likelihood.score(documents(spark, rows), pseudo_likelihood.start()).collect()}
    assert joined == pytest.approx(more[0])


def test_shares_of_a_bucket_sum_to_one(spark):
    table = spark.createDataFrame([(h, 1 + h % 7) for h in range(12000)], "hash long, n long")
    words = pseudo_likelihood.known(table)
    hashes = np.arange(12000)
    ids = words.buckets(hashes)
    log, lacks = words.shares(hashes, ids)
    assert not lacks.any() and len(set(ids[ids < pseudo_likelihood.HEAD])) == pseudo_likelihood.HEAD
    sums = np.bincount(ids, np.exp(log), pseudo_likelihood.VOCAB)
    sums[pseudo_likelihood.HEAD :] += np.exp(words.unseen()) / words.occurrences
    assert sums == pytest.approx(1)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:180] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (3, x[3].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        s = np.round(u @ u[q], 6)
        s[q] = -9
        hit += len(set(mine) & set(np.lexsort((np.arange(400), -s))[:5].tolist()))
        assert len(mine) == 5
    assert hit >= 0.9 * 40
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [7, 101, 102, 103, 104]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


PAGE = '<html><head><title>t</title></head><body><nav><a href="/x">menu {0}</a></nav><div class="top">Site name</div><div class="ad">buy {0}</div><div class="story"><h1>T{0} &amp; more</h1><p><b>first {0}<br>line<p>second{0}</p></div><div class="comments">me too {0}</div><footer>&copy; {0}</footer>'


def test_main_text_by_host(spark):
    pages = [(i, f"https://www.a.org/{i}", PAGE.format(i)) for i in range(12)] + [(50, None, "<p>plain &lt;text"), (51, "nohost", None), (52, "https://b.org/", ""), (53, "https://c.org/", "<article>x<script>var a='</p>'</script>y</article><p>z")]
    got = {r["page_id"]: r["text"] for r in main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i} & more first {i} line second{i}" for i in range(12))
    assert (got[50], got[51], got[52], got[53]) == ("plain <text", "", "", "xy")


def test_simple_tree_matching_finds_most_pairs():
    a, b = main_text.tree("<div><ul><li>1<li>2</ul><p>x</div>"), main_text.tree("<div><p>0<ul><li>9</ul><p>y</div>")
    assert main_text.match(a, b)[0] == len(main_text.match(a, b)[1]) == 5  # html, div, ul, li, p


def test_url_rules_and_host_ranks(spark):
    rows = [(1, "HTTPS://WWW.Example.com/en/1", None), (2, "https://sub.example.com/en/", None), (3, "http://x.net/es/1?q", None), (4, "http://x.net/es/2", '<a href="http://bad.org/">'), (5, "http://y.org/1", '<a href="http://x.net/">'), (6, "http://z.org/", ""), (7, None, None), (8, "nothing", ""), (9, "https://a.com", None)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(1, 10)] == ["allow", "block", "block", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[1]["rule"], got[2]["rule"], got[5]["rule"], got[7]["host"], got[9]["rule"]) == ("www.example.com/en/", "example.com/en/", None, "", None)


def test_rank_matches_power_iteration(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("d", "a", 1)]
    got = {r["host"]: r["score"] for r in url_filter.rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 1), ("d", 3)], "host string, weight long"), rounds=4).collect()}
    seeds = {"a": 0.25, "d": 0.75}
    ranks = dict(seeds)
    out = Counter()
    for s, _, n in edges:
        out[s] += n
    for _ in range(4):
        new = Counter({h: 0.15 * w for h, w in seeds.items()})
        for s, d, n in edges:
            new[d] += 0.85 * ranks.get(s, 0) * n / out[s]
        ranks = new
    assert got == pytest.approx({h: x for h, x in ranks.items() if h in got})


def test_rank_goes_on_until_it_converges(spark):
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(15)] + [("h15", "h14", 1)]
    got = {r["host"]: r["score"] for r in url_filter.rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("h0", 1)], "host string, weight long")).collect()}
    m = np.zeros((16, 16))
    for s, d, _ in edges:
        m[int(d[1:]), int(s[1:])] = 0.85
    want = np.linalg.solve(np.eye(16) - m, np.eye(16)[0] * 0.15)
    assert len(got) == 16 and [got[f"h{i}"] for i in range(16)] == pytest.approx(want.tolist(), abs=1e-5)


def test_bucketed_hashes_tell_words_apart():
    from lettings.llm._shared import hashed_words

    texts = [None, "", " a  B\tb\x0b", "é É x", "x" * 3_000_000 + " b"]
    hashes, n = hashed_words(pa.array(["zz", *texts]).slice(1))
    assert n.tolist() == [0, 0, 3, 3, 2] and hashes[1] == hashes[2] == hashes[-1] and len(set(hashes.tolist())) == 6
