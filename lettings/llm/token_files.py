"""Token ids of whole documents in Parquet files that can be read in part.

A file holds documents in ascending doc_id order: ``doc_id``, ``n_tokens``, ``part`` and
``part_start`` (where the document begins among the ids of its part) and ``ids``, a list
column. Ids are dictionary-encoded (bit-packed indexes); the number columns too. Row groups
and pages are of stated size and pages carry an index, so that a reader of a few documents,
or of the metadata alone, reads just their pages. The global start of a document is the
number of ids in all parts before its own, plus ``part_start``.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, map_batches

SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1000
#: Characters of texts that a file, and the task that writes it, has at most, about.
PART_CHARS = 256_000_000


#: Bytes of ASCII letters and of U+00C0 to U+023F, of which the signs of multiplication and division and the dotted
#: capital I are no plain letters.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True


class ChunkEncoder:
    """Ids of a text, remembering those of chunks between blanks and line feeds.

    Only for tokenizers whose pre-tokens never span white space: then the ids of a text are those
    of its chunks, one after the other. A chunk that begins with a plain word and goes on with an ASCII
    character other than a letter is taken apart there: the first split never joins the two. Plain words are
    letters of ASCII and of U+00C0 to U+023F that stay letters in lower case and are composed already; they are one
    pre-token each, so the tokenizer's model encodes them by itself, and their ASCII capitals are lower-cased before
    they are looked up. What is not plain takes the whole tokenizer, and other tokenizers get whole texts.
    """

    def __init__(self, definition: str, bound: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bound = Tokenizer.from_str(definition), bound
        self.chunked = self.local(json.loads(definition))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in {chr(c).lower() for c in range(0xC0, 0x240) if c != 0x130}}
        self.clear()

    @staticmethod
    def local(d: dict) -> bool:
        """Texts are lower-cased, white space is dropped by the first split, bytes are the model's letters, and nothing is put before or after."""
        norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        steps = [x for x in norm.get("normalizers", [norm]) if x]
        first, *others = pre.get("pretokenizers", [pre])[:3] or [{}]
        apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and (first["pattern"].get("Regex") or "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        level = len(others) == 1 and others[0]["type"] == "ByteLevel" and not others[0].get("add_prefix_space") and not others[0].get("use_regex", True)
        blanks = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x["type"] == "Replace")
        plain = "Lowercase" in (kinds := [x["type"] for x in steps]) and blanks and all(x in ("NFC", "Lowercase", "Replace") for x in kinds)
        # An added token is found before all else: none may begin in a plain word or span chunks.
        added = all(re.match(r"[^\w\s]", x["content"]) and not re.search(r"[ \n]", x["content"]) and not x.get("lstrip") and not x.get("rstrip") for x in d.get("added_tokens", []))
        return bool(apart and level and plain and added and (d.get("model") or {}).get("type") == "BPE" and not d["model"].get("dropout") and not d.get("truncation") and not d.get("padding"))

    def clear(self) -> None:
        """Place of each known word among ``lengths`` and ``starts``, which tell where in ``flat`` its ids are."""
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.lengths = [np.zeros((0,), t) for t in (np.uint32, np.int64, np.int64)]

    @staticmethod
    def apart(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The plain words of all texts and what is between them, in order; which are plain; how many come before each text and at the end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
        inside = (data != 32) & (data != 10)
        before, after = np.append(True, ~inside[:-1]), np.append(~inside[1:], True)
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        # Where the plain word at the front of a chunk ends.
        odd = ~PLAIN[data]
        odd[:-1] |= (data[:-1] == 0xC3) & (data[1:] | 0x20 == 0xB7) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        after = np.minimum.accumulate(np.where(odd, np.arange(len(data)), len(data))[::-1])[::-1]
        cut = np.minimum(after[starts], ends)
        plain = (cut > starts) & ((cut == ends) | (np.append(data, 0)[cut] < 0x80))
        cut = np.where(plain, cut, ends)
        more = cut < ends
        at = np.cumsum(1 + more) - 1 - more
        first, n, words = [np.zeros(len(at) + more.sum(), t) for t in (np.int64, np.int64, bool)]
        first[at], n[at], words[at] = starts, cut - starts, plain
        first[at[more] + 1], n[at[more] + 1] = cut[more], (ends - cut)[more]
        kept = data[inside]
        kept += ((kept >= 65) & (kept <= 90) & np.repeat(words, n)).view(np.uint8) << 5
        array = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.append(0, np.cumsum(n))), pa.py_buffer(kept))
        return array, words, np.searchsorted(first, offsets)

    def learn(self, new: list[str], plain: list[bool]) -> None:
        model = self.tokenizer.model
        easy = (w if w.isascii() else w.lower().translate(self.level) for w, p in zip(new, plain, strict=True) if p)
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        found = [[t.id for t in model.tokenize(next(easy))] if p else next(rest).ids for p in plain]
        n = np.array([len(x) for x in found], np.int64)
        at = len(self.lengths)
        self.words.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(n) - n)
        self.lengths, self.flat = np.append(self.lengths, n), np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, n.sum()))

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given by their places, one after the other, and the number of each."""
        n = self.lengths[words]
        first = np.repeat(self.starts[words] - (np.cumsum(n) - n), n)
        return self.flat[first + np.arange(len(first))], n

    def many(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and the number of each."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not self.chunked:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        array, plain, offsets = self.apart(texts)
        if not len(array):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = array.dictionary_encode()
        # No word holds a blank, and taking one string apart is quicker than taking each from Arrow.
        one = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))
        chunks, words = np.asarray(coded.indices), one[0].as_py().split(" ")
        if len(self.words) > self.bound or len(self.flat) > 10 * self.bound:
            self.clear()
        places = np.array([self.words.get(w, -1) for w in words], np.int64)
        if len(new := np.flatnonzero(places < 0)):
            easy = np.zeros(len(words), bool)
            easy[chunks] = plain
            places[new] = len(self.lengths) + np.arange(len(new))
            self.learn([words[i] for i in new.tolist()], easy[new].tolist())
        flat, n = self.gather(places[chunks])
        ends = np.append(0, np.cumsum(n))[offsets]
        return flat, np.diff(ends)


ENCODER: list = []


def encoder_of(definition: str) -> ChunkEncoder:
    """The encoder of this worker process, kept from one task to the next."""
    if not ENCODER or ENCODER[0][0] != definition:
        ENCODER[:] = [(definition, ChunkEncoder(definition))]
    return ENCODER[0][1]


#: Bytes of texts that are encoded together, about.
ROUND_BYTES = 1_000_000


def write(docs: DataFrame, definition: str, end_id: int = 1, path: str | None = None) -> Cut:
    """Writes the documents' ids, each with the end id after it, and returns the files.

    Documents are range-partitioned by (doc_id, text hash), so that one doc_id on many rows is
    split too, and sorted within parts. Null texts are empty: such a document has the end id
    alone. Null doc_ids come first. Rows with one doc_id stay separate documents, in the order of
    their texts' hashes; equal rows are interchangeable. An empty table gives files without rows.
    Further columns aren't read. Files go to the shared folder unless a path is given.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, at = encoder_of(shared.value), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        texts: list[pa.Array] = []
        held = 0

        def rows(at: int) -> pa.RecordBatch:
            flat, n = encoder.many(pa.concat_arrays(texts))
            flat = np.insert(flat, np.cumsum(n), end_id).astype(np.int32)
            n += 1
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))
            columns = [pa.concat_arrays(keys), pa.array(np.full(len(n), part, np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n.astype(np.int32)), lists]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])

        for batch in batches:
            keys.append(batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()))
            texts.append(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null(""))
            held += texts[-1].nbytes
            if held >= ROUND_BYTES:
                yield (out := rows(at))
                at += len(out.column(4).flatten())
                keys, texts, held = [], [], 0
        if texts:
            yield rows(at)

    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_CHARS))
    key = F.xxhash64("text")
    ranged = docs.select("doc_id", "text").withColumn("_h", key).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "compression": "zstd"}
    return Cut(map_batches(ranged.drop("_h"), encode, SCHEMA), "token-ids", path, **{k.replace(".", "__"): v for k, v in options.items()})


def read(spark: SparkSession, path: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """The documents of written files with ``start``, the number of ids before each in all files.

    ``where`` on doc_id is pushed down to row groups and pages; without ``ids`` only metadata is read.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    base = F.sum("_all").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("_all")
    totals = checked_broadcast(totals.select(F.col("part").alias("_part"), base.alias("_base")))
    rows = (rows if where is None else rows.where(where)).join(totals, F.col("part") == F.col("_part"))
    keep = ["doc_id", (F.col("_base") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens")]
    return rows.select(*keep, "ids") if ids else rows.select(*keep)


def checksums(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = np.asarray(lists.flatten()).astype("<u4"), np.append(0, np.cumsum(np.asarray(batch.column(2))))
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
