"""Personal data: spans by pattern, and terms that reveal them by corpus co-occurrence.

Entities of four kinds are found by pattern. A term that stands near entities of a kind tells
of them as far as its presence in a document makes the kind likely: with ``p`` the share of the
term's documents in which it stands near the kind, and ``q`` the share of all documents with
the kind, its disclosure is ``1 - log(p) / log(q)``: the part of the kind's information content
that the term gives away, 1 if it never comes without. So also of each single entity: ``p`` is then
the share of the term's documents in which it stands near that entity, and ``q`` the share of all
documents with the entity. Terms at or over a threshold that stand near enough different entities,
or near one entity in enough different texts, become spans too, wherever they occur in any document, and are generalised
or removed as the entities are.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, column, map_batches

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Between digits none of these patterns can begin, but where a match has just ended, which none does there.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
NEAR_WORDS, NEAR_CHARS = 5, 120
#: Words of a task that are counted in memory before they are passed on.
COUNTED = 200_000
#: Disclosing terms that one pass over the texts looks for; more terms take more passes.
PASS_TERMS = 200_000


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what is before an at sign reaches as far back as it can, to the match before at most."""
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the entities by pattern, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def whole(text: str, m: re.Match) -> bool:
    """Whether a match is a whole run of letters, and so a term that ``document_counts`` counts."""
    return not (m.start() and TERM.match(text, m.start() - 1, m.start()) or TERM.match(text, m.end(), m.end() + 1))


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, str, int, int]]:
    """(kind, entity, term, start, end) of the words next to each entity that are in no entity; spans are in order."""
    starts, ends = [], []  # of what entities cover, apart from one another
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, kind, b in spans:
        lo, hi = max(0, a - NEAR_CHARS), min(len(text), b + NEAR_CHARS)
        before = [m for m in TERM.finditer(text, lo, a) if whole(text, m)][-NEAR_WORDS:]
        after = [m for m in TERM.finditer(text, b, hi) if whole(text, m)][:NEAR_WORDS]
        for m in before + after:
            at = bisect_left(starts, m.end()) - 1
            if at < 0 or ends[at] <= m.start():
                yield kind, text[a:b], m[0].lower(), m.start(), m.end()


SPAN = "struct<start:long,kind:int,end:long>"
FOUND = f"row long, doc_id long, digest long, base array<{SPAN}>, entities array<struct<kind:int,entity:string>>, near array<struct<kind:int,entity:string,term:string,start:long,end:long>>"


def name_of(entity: str) -> str:
    return hashlib.blake2b(entity.encode(errors="replace"), digest_size=8).hexdigest()


def found(docs: DataFrame) -> DataFrame:
    """Entities and the terms near them, with a number for each row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        kind = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        entity = pa.struct([("kind", pa.int32()), ("entity", pa.string())])
        term = pa.struct([("kind", pa.int32()), ("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            base, near, entities, digests = [], [], [], []
            for text in column(batch, "text"):
                base.append(spans := base_spans(text or ""))
                seen = set(near_terms(text, spans)) if spans else ()
                near.append([(k, name_of(e), *rest) for k, e, *rest in sorted(seen)])
                entities.append(sorted({(k, name_of(text[a:b])) for a, k, b in spans}))
                digests.append(int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "little", signed=True) if spans else 0)
            names = lambda rows, keys: [[dict(zip(keys, x, strict=True)) for x in r] for r in rows]
            columns = [pa.array(range(row, row + len(base)), pa.int64()), batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(digests, pa.int64())]
            columns += [pa.array(names(base, ("start", "kind", "end")), pa.list_(kind)), pa.array(names(entities, ("kind", "entity")), pa.list_(entity)), pa.array(names(near, ("kind", "entity", "term", "start", "end")), pa.list_(term))]
            row += len(base)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "digest", "base", "entities", "near"])

    return map_batches(docs.select("doc_id", "text"), scan, FOUND)


def document_counts(docs: DataFrame) -> DataFrame:
    """``term`` and ``docs``, the number of documents with it, over all documents; counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "docs"])
        for batch in batches:
            for text in column(batch, "text"):
                if text:
                    # Only terms near an entity matter, and these are runs of letters.
                    counts.update({w.lower() for w in set(TERM.findall(text))})
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    return map_batches(docs.select("text"), count, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def disclosing(docs: DataFrame, scanned: DataFrame, threshold: float = 0.75, entities: int = 3) -> DataFrame:
    """``term``, ``kind`` and ``disclosure`` of the terms that reveal a kind of entity, or an entity of that kind; the most of both.

    They stand near ``entities`` different entities of the kind at least, or near one entity in two
    different texts: a word that comes in one text only, or in its exact copies, is not known to
    come with anything.
    """
    # A row's pairs are made distinct inside the row, so all counts are sums that tasks begin, however common the term.
    pairs = lambda *keys: F.array_distinct(F.transform("near", lambda x: F.struct(*(x[k].alias(k) for k in keys))))
    with_kind = scanned.select(F.explode(pairs("term", "kind")).alias("x")).groupBy("x.term", "x.kind").agg(F.count(F.lit(1)).alias("both"))
    one = scanned.select("digest", F.explode(pairs("term", "kind", "entity")).alias("x")).groupBy("x.term", "x.kind", "x.entity")
    one = Cut(one.agg(F.count(F.lit(1)).alias("both"), (F.min("digest") != F.max("digest")).alias("apart")), "near-entities").df
    by = one.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= entities)
    by = by.join(with_kind, ["term", "kind"]).select("term", "kind", F.lit(None).cast("string").alias("entity"), "both")
    by = Cut(by.unionByName(one.where("apart").select("term", "kind", "entity", "both")), "near-terms").df
    of = document_counts(docs).join(checked_broadcast(by.select("term").distinct()), "term", "left_semi")
    every = scanned.agg(F.count(F.lit(1)).alias("all"))
    kinds = scanned.select(F.explode(F.array_distinct(F.transform("base", lambda x: x["kind"]))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    single = scanned.select(F.explode("entities").alias("x")).groupBy("x.kind", "x.entity").agg(F.count(F.lit(1)).alias("of_kind"))
    rows = by.where("entity is null").drop("entity").join(F.broadcast(kinds), "kind")
    rows = rows.unionByName(by.where("entity is not null").join(single, ["kind", "entity"]).drop("entity"))
    rows = rows.join(of, "term").crossJoin(F.broadcast(every))
    p, q = F.col("both") / F.col("docs"), F.col("of_kind") / F.col("all")
    disclosure = F.when(q >= 1, F.lit(0.0)).otherwise(1 - F.ln(p) / F.ln(q))
    return rows.groupBy("term", "kind").agg(F.max(disclosure).alias("disclosure")).where(F.col("disclosure") >= threshold)


def marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, more) with every occurrence of the terms that is in no entity added to ``more``.

    All texts are read whole, once for each ``PASS_TERMS`` terms.
    """
    terms = terms.select("term").distinct()
    n = math.ceil(terms.count() / PASS_TERMS)
    for k in range(n):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()
        docs = _one_pass(docs, frozenset(r["term"] for r in some))
    return docs


def _one_pass(docs: DataFrame, terms: frozenset[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text, base, more in zip(column(batch, "text"), column(batch, "base"), column(batch, "more"), strict=True):
                rows.append(more)
                i = reach = 0
                for m in TERM.finditer(text or ""):
                    if m[0].lower() in shared.value:
                        while i < len(base) and base[i]["start"] < m.end():
                            reach = max(reach, base[i]["end"])
                            i += 1
                        if reach <= m.start():
                            more.append({"start": m.start(), "kind": 4, "end": m.end()})
            names = ["doc_id", "text", "base", "more"]
            columns = [pa.array(rows, kind) if x == "more" else batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, mark, f"doc_id long, text string, base array<{SPAN}>, more array<{SPAN}>")


def based(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the entities by pattern, and room for ``more``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("start", "kind", "end"), x, strict=True)) for x in base_spans(text or "")] for text in column(batch, "text")]
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(batch.schema.get_field_index("text")), pa.array(spans, kind), pa.array([[]] * len(spans), kind)], names=["doc_id", "text", "base", "more"])

    return map_batches(docs.select("doc_id", "text"), scan, f"doc_id long, text string, base array<{SPAN}>, more array<{SPAN}>")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def detect(docs: DataFrame, threshold: float = 0.75, entities: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts by kind, ``base_sha256``, and ``spans``, all spans in order.

    Offsets are code points, ends exclusive. A null or empty text has no spans: its ``spans`` is
    empty and its digest that of an empty string. Null doc_ids are kept, repeated rows each have a
    result, an empty table an empty one. Texts of any length are read whole in time proportional
    to it. Terms with equal figures are treated alike; other columns are ignored.
    """
    scanned = Cut(found(docs), "entities").df
    terms = Cut(disclosing(docs, scanned, threshold, entities), "terms").df
    # Without a term, the entities that were found are all; else the texts are read again, for the terms' occurrences.
    joined = scanned.select("doc_id", "base", F.array().cast(f"array<{SPAN}>").alias("more")) if terms.isEmpty() else marked(based(docs), terms)
    # The lambda has one parameter only: Spark fills a second one with the place in the array.
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    of = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return joined.select("doc_id", *of, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "more")).alias("spans"))


def sanitised(text: str, spans: str, general: dict[str, str] | None = None) -> str:
    """A text with its spans generalised: replaced by the kind's name, or what ``general`` has for it ('' removes)."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) >= at:
            out += [text[at : int(a)], (general or {}).get(kind, f"[{kind.upper()}]")]
        at = max(at, int(b))
    return "".join([*out, text[at:]])
