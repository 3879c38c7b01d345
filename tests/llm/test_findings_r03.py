"""What a reviewer found in round 3."""

import hashlib
import random
import re
import zlib

from pathlib import Path

from lettings.llm import main_text, personal_data, queries, token_files

ENTITIES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_entity(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data_counts_each_kind_by_itself(spark):
    """every count was that of the entities whose kind's number was their place in the text."""
    rng = random.Random(31)
    parts = ["me@x.example.org", "10.0.0.1", "4111 1111 1111 1111", "+44 (20) 7946 0958", "300.1.1.1", "4111 1111 1111 1112", "+1 2", "word", "a@b", "\U0001f600"]
    texts = [" ; ".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(120)] + [parts[k] for k in range(4)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.detect(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(ENTITIES.items()) for m in re.finditer(p, text or "") if is_entity(kind, m[0]))
        assert [got[i][f"n_{kind}"] for kind in ENTITIES] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{[*ENTITIES][k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_a_template_block_of_few_pages_is_found_among_all_pages(spark):
    """the frame came from eight pages of a host, so a block that none of them had was never known to be constant."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, want = [], {}
    for i in range(240):
        paragraphs = [" ".join(word() for _ in range(30)) for _ in range(2 + i % 3)]
        box = "<div class='kit'>Read this in our other series</div>" if i % 40 == 7 else ""
        inner = f"<h1>{(head := word())}</h1>{box}" + "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"https://one.example.com/{i}", f"<html><body><div class='top'><div>Site {i % 2}</div></div><div class='story'>{inner}</div></body></html>"))
        want[i] = " ".join([head, *paragraphs])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in main_text.extract(pages).collect()} == want


def test_token_ids_of_words_in_all_their_forms():
    """Finding of op5: each form of a word was encoded anew, and a capital was lower-cased before a mark that composes with the small letter alone."""
    from tokenizers import Tokenizer

    definition = Path(queries.tokenizer_file("word_bpe_49k.json")).read_text()
    encoder, tokenizer = token_files.ChunkEncoder(definition), Tokenizer.from_str(definition)
    encoder.many(["Word, word! WORD's\nwOrd"])
    assert set(encoder.words) == {"word", ",", "!", "'s"}
    rng = random.Random(33)
    texts = ["H\u0331", "J\u030c,", "T\u0308a. W\u030a", "Y\u030a!", "a\u00d7b. \u00d7", "\u0130. I\u0307.", "<|ENDOFTEXT|> A<|endoftext|>.", "x\ty's. 's'S", "\u0181 \u023a, \u023e", ""]
    texts += ["".join(rng.choice("aHT\u00c9\u00e9\u0130\u00d7\u01c5\u023f\u0240\u0331\u0308.,'!|<>7s \n\t\u00a0\u1e96\u5b57\u00b5") for _ in range(rng.randrange(30))) for _ in range(5000)]
    flat, n = encoder.many(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_structures_are_matched_once_for_all_their_pages(monkeypatch):
    """Finding of op8: every page was parsed and matched twice over; sums of a structure's pages must give the frame what the pages gave one by one."""
    rng = random.Random(34)
    word = lambda: "".join(rng.choices("abc", k=2))
    block = lambda: rng.choice([f"<p>{word()} {word()}</p>", f"<ul><li>{word()}<li></ul>", f"<div class='ad'>no<p>{word()}</p></div>", f"<div>{word()}<p>x</p>y</div>"])
    pages = [f"<body><div class='story'>{''.join(block() for _ in range(rng.randrange(4)))}</div></body>" for _ in range(120)] + ["", "plain"]
    frame = main_text.tree("<body><div class='story'><p>1</p><div class='ad'></div><ul><li></ul></div></body>")
    plain: dict = {}
    sums: dict = {}
    for page in pages:
        t = main_text.tree(page)
        of = {p.index: f.index for f, p in main_text.match(frame, t)[1]}
        stack = [(t, of.get(t.index, 0))]
        while stack:
            n, around = stack.pop()
            around = of.get(n.index, around)
            s = plain.setdefault(around, [0, 0, set()])
            if n.index in of or not n.never:
                s[0] += len(n.own().split())
            if n.index in of:
                s[1] += 1
                s[2].add(zlib.crc32(n.own().encode()))
            stack += [(k, around) for k in n.kids if not n.never]
        of = sums.setdefault(main_text.skeleton(t), [0, [[0, 1 << 40, -1] for _ in range(t.size)]])
        of[0] += 1
        main_text.counted(t, of[1])
    got: dict = {}
    assert len(sums) < len(pages)
    for structure, (n, nodes) in sums.items():
        for at, own, partners in main_text.placed(frame, main_text.framed(structure)):
            s = got.setdefault(at, [0, 0, 1 << 40, -1])
            s[0] += nodes[own][0]
            if partners:
                s[1], s[2], s[3] = s[1] + n, min(s[2], nodes[own][1]), max(s[3], nodes[own][2])
    assert got == {k: [w, n, min(c, default=1 << 40), max(c, default=-1)] for k, (w, n, c) in plain.items()}
    wrapper = (next(n.index for n in main_text.preorder(frame) if n.label == "div.story"), {2})
    want = [main_text.extracted(main_text.tree(p), frame, wrapper) for p in pages]
    calls, match, known = [], main_text.match, {}
    monkeypatch.setattr(main_text, "match", lambda a, b: calls.append(b.shape) or match(a, b))
    assert [main_text.extracted(main_text.tree(p), frame, wrapper, known) for p in pages] == want
    assert len(calls) == len(set(calls)) < len(pages)
