"""Byte-pair encoding by a deterministic automaton, compiled from a tokenizer's merges.

The automaton reads tokens, and its paths are exactly the results of the merges. It begins with one
state that every byte leads back to. Each merge (u, v), in order, puts in a gadget: the state that u
leads to is copied, the copy loses its arc v, all arcs u lead to the copy, and wherever there was an
arc u there is now an arc uv too, to where v led. So all arcs of one label lead to one state, and the
state of a label is told by its gadgets: those on the label itself and, from before it was made, those
on its right part. An arc is missing if one of these gadgets took it, or took its left part before
it was made. Arcs are looked up in a table of each state that is filled as states are met.

A word has one path, and so has every prefix. Decoding puts the labels of the arcs together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._shared import column, map_batches

#: Fixed value: how byte-level tokenizers split texts into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII characters.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words, and as many strings between blanks, that a worker remembers, and the longest of them in characters.
WORDS, LETTERS = 500_000, 64
#: Ids that are decoded together.
ROUND_IDS = 1_000_000
#: Pairs of state and label that a worker remembers.
PAIRS = 4_000_000
#: The state that reading begins in.
START = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it shows, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Store:
    """Ids of known strings: ``place`` tells where in ``starts`` and ``lengths`` each stands, these where in ``flat`` its ids are."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, new: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        at = len(self.lengths)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(n) - n)
        self.lengths, self.flat = np.append(self.lengths, n), np.append(self.flat, flat.astype(np.int32))

    def places(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings, one after the other, and the number of each."""
        n = self.lengths[places]
        return self.flat[np.repeat(self.starts[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Automaton:
    """Compiled merges.

    Raises ValueError for what it doesn't take: other models than byte-level BPE with the usual
    split, merges of tokens that are made later or twice, dropout, options of added tokens.
    """

    def __init__(self, definition: str):
        d = json.loads(definition)
        model, pre, special = d["model"], d.get("pre_tokenizer") or {}, d.get("added_tokens") or []
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or not split or d.get("normalizer") or any(x.get(k) for x in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain byte-level BPE can be compiled")
        letters, vocab = byte_letters(), model["vocab"]
        if any(x not in vocab for x in letters):
            raise ValueError("a byte has no token")
        self.labels = {i: bytes(map(letters.__getitem__, t)) for t, i in vocab.items() if all(map(letters.__contains__, t))}
        self.special = {x["content"]: x["id"] for x in special}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        #: Parts of each made token, and the number of its merge.
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        #: Number of the gadget that took an arc (its label) from a label's state.
        self.taken: dict[tuple[int, int], int] = {}
        merges = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        order = {a + b: n for n, (a, b) in enumerate(merges)}
        if len(order) < len(merges) or any(order.get(x, -1) >= n for n, p in enumerate(merges) for x in p):
            raise ValueError("a token is made twice, or merged before it is made")
        alive = {vocab[x] for x in letters}
        for n, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if u in alive and v in alive and self.leads(u, v):  # else the two never meet
                self.taken[u, v] = n
                self.left[uv], self.right[uv], self.made[uv] = u, v, n
                alive.add(uv)
        #: Tree of the labels' bytes: a node holds its children by byte, and at -1 the label that ends there.
        self.root: dict[int, object] = {}
        for t in alive:
            node = self.root
            for byte in self.labels[t]:
                node = node.setdefault(byte, {})
            node[-1] = t
        #: The same in arrays: edges as node * 256 + byte in order, where they lead, the label that ends at each node, and labels' lengths.
        nodes, edges = [self.root], []
        for n, node in enumerate(nodes):  # grows meanwhile
            for byte, child in node.items():
                if byte >= 0:
                    edges.append((n << 8 | byte, len(nodes)))
                    nodes.append(child)
        self.edges, self.child = np.array(sorted(edges), np.int64).T.copy()
        self.ends = np.array([node.get(-1, -1) for node in nodes], np.int64)
        self.lengths = np.zeros(max(self.labels) + 1, np.int64)
        for i, label in self.labels.items():
            self.lengths[i] = len(label)
        self.clear()

    def clear(self) -> None:
        self.arcs: dict[int, dict[int, bool]] = {}
        self.pairs, self.there = np.array([-1], np.int64), np.array([False])
        self.words, self.chunks = Store(), Store()
        self.any_split, self.ascii_split = regex.compile(SPLIT), re.compile(ASCII_SPLIT, re.ASCII)
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "pairs", "there", "words", "chunks", "any_split", "ascii_split", "apart")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def leads(self, state: int, label: int) -> bool:
        """Whether the label's state has an arc of the other label."""
        y, before = state, len(self.made) + len(self.labels)
        while y != START and y is not None:
            x, until = label, len(self.made) + len(self.labels)
            while x is not None:
                if self.taken.get((y, x), until + 1) <= until and self.taken[y, x] < before:
                    return False
                until, x = self.made.get(x, 0), self.left.get(x)
            before, y = self.made.get(y, 0), self.right.get(y)
        return True

    def path(self, word: bytes) -> list[int]:
        """The labels of a word's path.

        Longer arcs are tried first. Every place is reached by one path at most, so none is left twice.
        """
        n, i, state, root, labels = len(word), 0, START, self.root, self.labels
        path: list[int] = []
        left: list[list[int]] = []
        while i < n:
            node, found = root, []
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                if -1 in node:
                    found.append(node[-1])
            while True:
                known = self.arcs.get(state)
                if known is None:
                    known = self.arcs[state] = {}
                while found:
                    label = found.pop()
                    there = known.get(label)
                    if there is None:
                        there = known[label] = self.leads(state, label)
                    if there:
                        break
                else:  # nothing goes on from here
                    i -= len(labels[path.pop()])
                    found, state = left.pop(), path[-1] if path else START
                    continue
                break
            path.append(label)
            left.append(found)
            i += len(labels[label])
            state = label
        return path

    def lead(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """``leads`` of many, from a sorted table of the pairs met before."""
        keys = (states + 1) << 32 | labels
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        new = np.unique(keys[self.pairs[at] != keys])
        if len(new):
            if len(self.pairs) > PAIRS:
                self.pairs, self.there = self.pairs[:1], self.there[:1]
                return self.lead(states, labels)
            found = [self.leads((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.there = np.insert(self.pairs, place, new), np.insert(self.there, place, found)
            at = np.searchsorted(self.pairs, keys)
        return self.there[at]

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The paths of many words, one after the other, and the length of each; all words go one arc on, or back, at a time."""
        data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        begin, at = end - size, end - size
        #: By byte: the label that ends with it, and the most bytes of one that begins with it.
        into, most = np.full(len(data), START, np.int64), np.full(len(data), len(data), np.int64)
        live = np.flatnonzero(size)
        while len(live):
            place, stop, walk = at[live], end[live], np.arange(len(live))
            bound, node, found = most[place], np.zeros(len(live), np.int64), []
            while len(walk := walk[(place[walk] < stop[walk]) & (bound[walk] > len(found))]):
                keys = node[walk] << 8 | data[place[walk]]
                edge = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
                on = self.edges[edge] == keys
                walk, edge = walk[on], edge[on]
                node[walk] = self.child[edge]
                place[walk] += 1
                label = self.ends[node[walk]]
                found.append((walk[label >= 0], label[label >= 0]))
            state = np.where(at[live] > begin[live], into[at[live] - 1], START)
            chosen = np.full(len(live), -1, np.int64)
            for walk, label in reversed(found):
                open_ = chosen[walk] < 0
                walk, label = walk[open_], label[open_]
                on = self.lead(state[walk], label)
                chosen[walk[on]] = label[on]
            back, live, chosen = live[chosen < 0], live[chosen >= 0], chosen[chosen >= 0]
            at[live] += self.lengths[chosen]
            into[at[live] - 1] = chosen
            long = self.lengths[into[at[back] - 1]]  # this arc leads nowhere: shorter ones are next
            at[back] -= long
            most[at[back]] = long - 1
            live = np.append(live[at[live] < end[live]], back)
        word, labels, live = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.flatnonzero(size)
        while len(live):
            word.append(live)
            labels.append(into[at[live] - 1])
            at[live] -= self.lengths[labels[-1]]
            live = live[at[live] > begin[live]]
        of = np.concatenate(word)
        return np.concatenate(labels)[::-1][np.argsort(of[::-1], kind="stable")], np.bincount(of, minlength=len(words))

    def split(self, text: str) -> list[str]:
        return (self.ascii_split if text.isascii() else self.any_split).findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library gives them; added tokens in it are one id each."""
        at = 0
        ids: list[int] = []
        for m in [*(self.apart.finditer(text) if self.apart else ()), None]:
            for word in self.split(text[at : m.start()] if m else text[at:]):
                ids += self.path(word.encode())
            if m:
                ids.append(self.special[m.group()])
                at = m.end()
        return ids

    def learn(self, parts: list[str]) -> None:
        """Remembers what stands between blanks, with the blank before it, and its words."""
        split = [self.split(" " + part) for part in parts]
        words = list(chain.from_iterable(split))
        new = list({w for w in words if w not in self.words.place})
        self.words.add(new, *self.paths([w.encode() for w in new]))
        flat, n = self.words.gather(self.words.places(words))
        ends = np.cumsum(np.array([len(x) for x in split], np.int64))
        self.chunks.add(parts, flat, np.diff(np.append(0, np.cumsum(n))[ends], prepend=0))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and the number of each.

        A word begins at each blank that another character follows, so what stands between blanks is
        remembered. Texts with other blanks, added tokens or long words go word by word.
        """
        for store in ("chunks", "words"):
            if len(getattr(self, store).place) > WORDS:
                setattr(self, store, Store())
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded, ends = lists.flatten().dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
        parts, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        head = np.zeros(len(code), bool)
        head[ends[:-1]] = True
        plain = np.array([bool(p) and len(p) < LETTERS and not p[0].isspace() for p in parts], bool)
        odd = np.add.reduceat(~plain[code] & ~head, ends[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        if self.apart:
            odd |= np.array([self.apart.search(t) is not None for t in texts], bool)
        used = np.zeros(len(parts), bool)
        used[code[~head & ~np.repeat(odd, np.diff(ends))]] = True
        known = self.chunks.place
        needed = [p for p, u in zip(parts, used.tolist(), strict=True) if u]
        self.learn([p for p in needed if p not in known])
        place = np.zeros(len(parts), np.int64)
        place[used] = self.chunks.places(needed)
        # Firsts and odd texts are put in between.
        whole = [self.encode(t) if o else self.encode(t.partition(" ")[0]) for t, o in zip(texts, odd.tolist(), strict=True)]
        use = ~head & used[code] & ~np.repeat(odd, np.diff(ends))
        flat, n = self.chunks.gather(place[code[use]])
        text = np.repeat(np.arange(len(texts)), np.diff(ends))[use]
        rest = np.bincount(text, n, len(texts)).astype(np.int64)
        first = np.array([len(w) for w in whole], np.int64)
        out = np.empty(int(first.sum() + rest.sum()), np.int32)
        begin = np.cumsum(first + rest) - rest - first
        is_first = np.zeros(len(out), bool)
        is_first[np.repeat(begin - (np.cumsum(first) - first), first) + np.arange(first.sum())] = True
        out[is_first] = np.fromiter(chain.from_iterable(whole), np.int32, int(first.sum()))
        out[~is_first] = flat
        return out, first + rest


def encode(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """``doc_id`` and ``ids``, those of the whole text, for every row of docs (doc_id, text).

    Null and empty texts have no ids. Rows with a null or repeated doc_id stay separate rows. Further
    columns aren't read, whatever their names. An empty table gives an empty result. A text is
    held whole by one task, whose time grows with its length, also where it is one long word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = shared.value.encode_many([t or "" for t in column(batch, "text")])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), ids, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """``doc_id``, ``ids`` and ``text``: the labels of the ids, put together and read as UTF-8.

    Bytes that aren't UTF-8 become U+FFFD; ids without a label give nothing; null ids an empty text.
    """
    ids = np.array(sorted(automaton.labels), np.int64)
    labels = b"".join([automaton.labels[i] for i in ids.tolist()])
    size, start = np.zeros(ids.max() + 2, np.int64), np.zeros(ids.max() + 2, np.int64)
    size[ids] = [len(automaton.labels[i]) for i in ids.tolist()]
    start[ids] = np.cumsum(size[ids]) - size[ids]
    shared = rows.sparkSession.sparkContext.broadcast((np.frombuffer(labels, np.uint8), size, start))

    def joined(flat: np.ndarray) -> bytes:
        labels, size, start = shared.value
        flat = np.where((flat >= 0) & (flat < len(size)), flat, len(size) - 1)
        out = []
        for i in range(0, len(flat), ROUND_IDS):
            some = flat[i : i + ROUND_IDS]
            n = size[some]
            out.append(labels[np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten()), np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
            n = np.append(0, np.cumsum(shared.value[1][np.where((flat >= 0) & (flat < len(shared.value[1])), flat, len(shared.value[1]) - 1)]))[ends]
            data = joined(flat)
            found = [data[a:b].decode(errors="replace") for a, b in zip(n[:-1].tolist(), n[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["doc_id", "ids", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "ids"), texts, f"doc_id {kind}, ids array<int>, text string")
