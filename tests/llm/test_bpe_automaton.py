"""The tokenization automaton against the tokenizers library."""

import hashlib
import json
import pickle
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents

from lettings.llm import bpe_automaton, queries

DEFINITION = Path(queries.tokenizer_file("byte_bpe_50k.json")).read_text()


@pytest.fixture(scope="module")
def automaton():
    return pickle.loads(pickle.dumps(bpe_automaton.Automaton(DEFINITION)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(DEFINITION)


def same(automaton, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    flat, n = automaton.encode_many(texts)
    assert [t for t, w, got in zip(texts, want, np.split(flat, np.cumsum(n)[:-1]), strict=True) if got.tolist() != w] == []
    assert [t for t, w in list(zip(texts, want, strict=True))[:200] if automaton.encode(t) != w] == []


def test_every_code_point_is_split_as_by_the_library(automaton, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(automaton, library, ["a".join(f"{c} {c}\n {c}  " for c in points[i : i + 50]) for i in range(0, len(points), 50)])


def test_random_texts(automaton, library):
    rng = random.Random(31)
    letters = "aabbcdeehiinnoorsttu  .'-\n\t1<|>é\u3000"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["a" * k for k in range(150)] + ["ab" * k for k in range(80)] + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(40)) for _ in range(2000)]
    texts += ["<|endoftext|>" * 3, "x <|endoftext|>  y ", "  <|endoftext|> \n", "<|endoftext", "", " ", "  ", " a", "a ", " \x1c b"]
    same(automaton, library, texts)


def small(merges):
    d = json.loads(DEFINITION)
    letters = list(bpe_automaton.byte_letters())
    d["model"] |= {"vocab": {t: i for i, t in enumerate([*letters, *(a + b for a, b in merges)])}, "merges": [list(m) for m in merges]}
    d["added_tokens"] = []
    return json.dumps(d)


def test_random_merges_on_all_short_words():
    from itertools import product

    from tokenizers import Tokenizer

    rng = random.Random(32)
    for _ in range(40):
        tokens, merges = ["a", "b"], []
        while len(merges) < 9:
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                tokens.append(pair[0] + pair[1])
                merges.append(pair)
        automaton, library = bpe_automaton.Automaton(small(merges)), Tokenizer.from_str(small(merges))
        same(automaton, library, ["".join(w) for n in range(10) for w in product("ab", repeat=n)])


@pytest.mark.parametrize("merges", [[("ab", "c"), ("a", "b")], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]])
def test_merges_out_of_order_or_made_twice_are_refused(merges):
    d = json.loads(small([("a", "b")]))
    for t in ("ab", "bc", "abc"):
        d["model"]["vocab"].setdefault(t, len(d["model"]["vocab"]))
    d["model"]["merges"] = [list(m) for m in merges]
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(json.dumps(d))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(Path(queries.tokenizer_file("word_bpe_49k.json")).read_text())


def test_long_words_take_time_in_proportion(automaton):
    began = time.process_time()
    rng = random.Random(33)
    assert automaton.encode("a" * 300_000) and automaton.encode("".join(rng.choice("aehinorst") for _ in range(300_000)))
    assert time.process_time() - began < 20


def test_query_equals_the_library_on_odd_rows(spark, library, tmp_path):
    texts = [None, "", " ", "plain text, as usual.", "plain text, as usual.", "<|endoftext|>", "é\u2028x", "long " * 30_000]
    docs = documents(spark, [(i if i != 4 else 3, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s")])
    docs = docs.withColumns({"ids": F.lit(1), "a.b": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_bpe_automaton(spark, str(tmp_path)).collect())
    rows = [(str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_bpe_automaton(spark, f"{tmp_path}/none").collect() == []


def test_decoding_takes_any_ids(spark, automaton, library):
    rng = random.Random(34)
    ids = [[rng.randrange(50_257) for _ in range(rng.randrange(12))] for _ in range(300)]
    rows = spark.createDataFrame([*enumerate(ids), (300, [99_999]), (301, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe_automaton.decode(rows, automaton).collect()}
    assert [got[i] for i in range(300)] == [library.decode(x, skip_special_tokens=False) for x in ids] and got[300] == got[301] == ""
