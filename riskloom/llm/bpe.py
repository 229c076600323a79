"""Byte-pair encoding and decoding of texts by a deterministic automaton over tokens.

The automaton reads token sequences and accepts just those that the merges produce. It begins with one state that reads
every byte and returns to itself. The merges are then put in one after another. The gadget of a merge (u, v) -> w:
wherever a state can read u, and v after it, it can now read w, which leads to the state after u and v; and the state after u becomes a
state of its own that can't read v any more, as u before v would have been merged. A state that only u leads to is
changed, one that other tokens share is copied. For u = v the new state can't read w either: of three, the first
two merge. Every state accepts. In the end tokens that lead to states with the same transitions share a state, and tokens
that the same states can read share a class, so the automaton is a bit for each state and class and the state of each token.

A word has one accepted token sequence, and so has each of its beginnings. So going through a word from left to right, at
each place one state is known; the tokens that begin there and that the state can read lead to later places. The
tokens of the word are the arcs of the way to its end. Decoding emits the labels of arcs, which are bytes.

The size of the automaton follows from the vocabulary, not from the texts (19 MB for 50,000 merges, 8 MB when it is sent).
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import combined

#: Words kept with their tokens in a Python worker, by an estimate of their bytes; the store is emptied beyond that.
STORE_BYTES = 128 << 20
_SPACE = {9, 10, 11, 12, 13, 32}


def pattern(letter: str = r"\p{L}", number: str = r"\p{N}", space: str = r"\s") -> str:
    """How byte-level vocabularies split text into words before merging; a fixed rule that belongs to them."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class Store(dict):
    """Words and their tokens as bytes; a missing word is encoded."""

    def __init__(self, tokens: Callable[[str], list[int]]):
        self.tokens, self.held = tokens, 0

    def __missing__(self, word: str) -> bytes:
        self[word] = found = array.array("i", self.tokens(word)).tobytes()
        self.held += 200 + 6 * len(word)
        return found


@dataclass(frozen=True)
class Automaton:
    """``reads``: a bit for each state (row) and class of tokens; ``state_after`` and ``class_of`` by token, -1 for none;
    ``labels``: bytes of each arc; ``whole``: texts that are tokens by themselves, wherever they occur."""

    reads: bytes
    row: int
    state_after: np.ndarray
    class_of: np.ndarray
    labels: tuple[bytes, ...]
    whole: dict[str, int]


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if it can be seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def within_words(label: bytes) -> bool:
    """False for tokens that can only begin a word: a space before anything but white space. The split puts it there."""
    return len(label) == 1 or label[0] != 32 or label[1] in _SPACE or label[1] >= 0x80


def compiled(labels: dict[int, bytes], merges: list[tuple[int, int, int]], whole: dict[str, int]) -> Automaton:
    """The automaton of ``merges`` (left, right, merged), in order. All single bytes must be tokens."""
    size = max([*labels, *whole.values()]) + 1
    inside = [t for t in sorted(labels) if within_words(labels[t])]
    place = np.full(size, -1)
    place[inside] = np.arange(len(inside))
    bit = lambda c: (c >> 3, np.uint8(1 << (c & 7)))
    reads = np.zeros((1024, -(-len(inside) // 8)), np.uint8)
    states = 1  # 0: the first, which reads all tokens
    after, users = np.full(size, -1), [1]
    for t, label in labels.items():
        if len(label) == 1:
            after[t] = 0
            users[0] += 1
            at, mask = bit(place[t])
            reads[0, at] |= mask
    for u, v, w in merges:
        at, mask = bit(place[v])
        if after[u] < 0 or place[v] < 0 or not reads[after[u], at] & mask:
            continue  # u is never before v, as parts of them merge sooner: no state reads w
        after[w] = after[v]
        users[after[v]] += 1
        if place[w] >= 0:
            (at_u, mask_u), (at_w, mask_w) = bit(place[u]), bit(place[w])
            reads[:states, at_w] |= np.where(reads[:states, at_u] & mask_u, mask_w, np.uint8(0))
        s = after[u]
        if users[s] > 1:
            if states == len(reads):
                reads = np.concatenate([reads, np.zeros_like(reads)])
            reads[states] = reads[s]
            users[s] -= 1
            users.append(1)
            after[u] = s = states
            states += 1
        for t in (v, w) if u == v else (v,):
            at, mask = bit(place[t])
            reads[s, at] &= ~mask
    # states and classes that can't be told apart become one
    columns = np.packbits(np.unpackbits(reads[:states], axis=1, bitorder="little")[:, : len(inside)].T, axis=1, bitorder="little")
    names: dict[bytes, int] = {}
    klass = np.array([names.setdefault(c.tobytes(), len(names)) for c in columns])
    few = columns[np.unique(klass, return_index=True)[1]]
    rows = np.packbits(np.unpackbits(few, axis=1, bitorder="little")[:, :states].T, axis=1, bitorder="little")
    names = {}
    kind = np.array([names.setdefault(r.tobytes(), len(names)) for r in rows])
    rows = rows[np.unique(kind, return_index=True)[1]]
    class_of = np.full(size, -1)
    class_of[inside] = klass
    state_after = np.where(after >= 0, kind[after], -1)
    every = [labels.get(t, b"") for t in range(size)]
    for text, t in whole.items():
        every[t] = text.encode()
    return Automaton(rows.tobytes(), rows.shape[1], state_after.astype(np.int32), class_of.astype(np.int32), tuple(every), whole)


@functools.lru_cache(maxsize=4)
def from_file(path: str) -> Automaton:
    """Reads a byte-level vocabulary of the tokenizers library (its ``merges``, ``vocab`` and added tokens) and compiles it."""
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    model, names = kept["model"], byte_names()
    if model["type"] != "BPE" or (kept.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or kept.get("normalizer"):
        raise ValueError("not a byte-level vocabulary")
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    whole = {t["content"]: t["id"] for t in kept.get("added_tokens", [])}
    labels = {i: bytes(names[c] for c in t) for t, i in vocab.items() if t not in whole}
    return compiled(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], whole)


class Encoder:
    """Encodes and decodes in a task. Words already met are kept, up to ``STORE_BYTES``."""

    def __init__(self, automaton: Automaton):
        import regex

        self.a, self.store = automaton, Store(self.tokens)
        self.words = regex.compile(pattern()).findall
        latin = "".join(map(chr, range(256)))
        self.latin_words = re.compile(pattern(*("".join(regex.findall(kind, latin)) for kind in (r"\p{L}", r"\p{N}", r"\s")))).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(automaton.whole, key=len, reverse=True)) + ")").split if automaton.whole else lambda text: [text]
        self.state_after, self.class_of = automaton.state_after.tolist(), automaton.class_of.tolist()
        # a tree of the labels: 256 * node + byte to the next node, and the token that ends in a node
        self.tree, self.ends = {}, [-1]
        for token, label in enumerate(automaton.labels):
            if self.state_after[token] >= 0:
                node = 0
                for b in label:
                    node = self.tree.setdefault(node << 8 | b, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = token
        # code points that this machine's Unicode lacks, but the splitter knows as letters or numbers: they may be neither
        import unicodedata

        known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000))
        self.unsure = {c for c in known if unicodedata.category(c) == "Cn"}

    def split(self, text: str) -> list[str]:
        """The words of ``text``. The library's own splitter decides about code points whose class versions of Unicode differ in."""
        try:
            text.encode("latin-1")
            return self.latin_words(text)
        except UnicodeEncodeError:
            pass
        if self.unsure.isdisjoint(text):
            return self.words(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:z] for _, (a, z) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def tokens(self, word: str) -> list[int]:
        """The arcs of the one way through ``word``: the longest are tried first, and no place is reached twice."""
        raw = word.encode()
        reads, row, after, klass, step, ends = self.a.reads, self.a.row, self.state_after, self.class_of, self.tree.get, self.ends
        n, j = len(raw), 0
        came = [-1] * (n + 1)  # the arc that leads to each place
        open_arcs: list[tuple[int, int, int]] = []
        while j < n:
            node, base = 0, (after[came[j]] * row if j else -1)
            for i in range(j, n):
                node = step(node << 8 | raw[i])
                if node is None:
                    break
                if ends[node] >= 0:
                    open_arcs.append((base, i + 1, ends[node]))
            while True:
                base, j, token = open_arcs.pop()
                if came[j] < 0:
                    if base < 0:
                        break
                    c = klass[token]
                    if c >= 0 and reads[base + (c >> 3)] >> (c & 7) & 1:
                        break
            came[j] = token
        out = []
        while j:
            out.append(came[j])
            j -= len(self.a.labels[came[j]])
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        store, pieces = self.store, []
        for k, piece in enumerate(self.cut(text)):
            if k % 2:
                pieces.append(self.a.whole[piece].to_bytes(4, "little"))
                continue
            pieces += map(store.__getitem__, self.split(piece))
            if store.held > STORE_BYTES:
                store.clear()
                store.held = 0
        return np.frombuffer(b"".join(pieces), "<i4")


_ready: dict[int, Encoder] = {}


def _sent(df: DataFrame, automaton: Automaton):
    """A function that gives a task its encoder; each Python worker unpacks the automaton once."""
    shared = df.sparkSession.sparkContext.broadcast((zlib.compress(automaton.reads, 1), automaton.row, automaton.state_after, automaton.class_of, automaton.labels, automaton.whole))
    key = hash((automaton.labels, automaton.row, zlib.crc32(automaton.reads)))

    def ready() -> Encoder:
        if key not in _ready:
            packed, *rest = shared.value
            _ready.clear()
            _ready[key] = Encoder(Automaton(zlib.decompress(packed), *rest))
        return _ready[key]

    return ready


def encode(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, tokens (array of int).

    Texts are whole; null counts as empty and has no tokens. The texts of added tokens are those tokens, as they are
    without special treatment. Ids may be null, repeated and of any type; an empty table gives no rows; other columns
    are not read. Nothing is shuffled.
    """
    rows, ready = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), _sent(docs, automaton)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready()
        for part in parts:
            for batch in (part.slice(i, 256) for i in range(0, part.num_rows, 256)):
                found = [encoder.encode(t) for t in combined(batch, "text").to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([combined(batch, "id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))], names=["id", "tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("tokens", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, automaton: Automaton, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Adds ``decoded``: the labels of the arcs in ``tokens``, read as UTF-8 (bytes that aren't become the replacement character).

    Returns id, tokens, decoded. A null list counts as empty; numbers that are no token fail the job.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col), F.array().cast("array<int>")).alias("tokens"))
    shared = encoded.sparkSession.sparkContext.broadcast(automaton.labels)  # decoding needs no more of the automaton

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        for part in parts:
            for batch in (part.slice(i, 256) for i in range(0, part.num_rows, 256)):
                texts = []
                for ids in combined(batch, "tokens"):
                    arcs = ids.values.to_numpy(zero_copy_only=False)
                    if len(arcs) and not 0 <= arcs.min() <= arcs.max() < len(labels):
                        raise ValueError("no such token")
                    texts.append(b"".join([labels[t] for t in arcs.tolist()]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([combined(batch, "id"), combined(batch, "tokens"), pa.array(texts, pa.string())], names=["id", "tokens", "decoded"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
