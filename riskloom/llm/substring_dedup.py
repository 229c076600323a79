"""Substring dedup by suffix automata: words in runs that occur earlier are removed.

The corpus is its own reference. Segments that share an anchor (see ``anchors``) go to one bucket, and the bucket's
segments are the reference shards: each shard's suffix automaton is built once, and the bucket's later segments
stream through it for their matching statistics. A position where the match is at least ``length`` words long ends a
run that occurs earlier; the maximal spans of such runs are removed. A reference of proven small size can be
broadcast instead (``against_reference``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .shared import combined, staged

GRAM = 6
BUCKET_BYTES = 2 << 20
#: More variants of one anchor than this are searched by hash instead, spread over all tasks.
MOST_VARIANTS = 20_000
#: States of one automaton; a longer reference is cut into shards.
SHARD_STATES = 400_000


class SuffixAutomaton:
    """All substrings of the sequences added so far; runs across two sequences are not substrings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _new(self, size: int, out: dict, link: int) -> int:
        self.next.append(out)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """State for the longest string of ``q`` that ends the path over ``p``; ``q`` itself if that is all of it."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: Sequence) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, q, symbol)
                continue
            here, p = self._new(self.size[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = here
                p = self.link[p]
            self.link[here] = 0 if p < 0 else self._split(p, self.next[p][symbol], symbol)
            last = here

    def matching(self, sequence: Sequence) -> Iterator[int]:
        """For each position, the length of the longest substring that ends there."""
        state, length = 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            else:
                length = 0
            yield length


def _resolve(mixed: DataFrame, unit: anchors.Unit, shard_states: int) -> DataFrame:
    def search(table: pa.Table) -> pa.Table:
        seen, shards, out = set(), [SuffixAutomaton()], []
        rows = sorted(table.to_pylist(), key=lambda r: (r["id0"], r["fp"], r["start"]))
        for r in rows:
            if (key := (r["anchor"], r["digest"])) in seen:
                continue
            seen.add(key)
            sequence = r["payload"].split(b" ")
            hit = np.zeros(r["runs"], bool)
            for shard in shards:
                for i, n in enumerate(shard.matching(sequence)):
                    if n >= unit.length:
                        hit[i - unit.length + 1] = True
            out += [(r["id0"], r["fp"], r["start"] + a, n) for a, n in anchors.runs_of(hit)]
            if len(shards[-1].size) > shard_states:
                shards.append(SuffixAutomaton())
            shards[-1].add(sequence)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id0", "fp", "start", "runs"])

    return mixed.groupBy("bucket").applyInArrow(search, "id0 long, fp long, start int, runs int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, most_variants: int = MOST_VARIANTS, bucket_bytes: int = BUCKET_BYTES, shard_states: int = SHARD_STATES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the remaining words joined by one space), spans.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A word goes if a run of ``length`` consecutive words over it
    also starts earlier: in a document with a smaller id, or earlier in the same one. Runs are judged on the
    input. Null and empty texts have no words. Rows that repeat an id and its text count as one document, with equal
    results. A null id sorts first. Of the input only the two named columns are read.
    """
    unit = anchors.Unit("words", length, min(GRAM, length))
    rows = anchors.keyed(docs, id_col, text_col)
    spans = anchors.repeats(rows, unit, lambda mixed: _resolve(mixed, unit, shard_states), True, bucket_bytes, most_variants)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in (part.slice(i, 500) for i in range(0, part.num_rows, 500)):
                out = []
                for text, ss in zip(combined(batch, "text").to_pylist(), combined(batch, "spans").to_pylist(), strict=True):
                    words = text.encode().split()
                    gone = removed(ss, len(words), length)
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if ss else b" ".join(words)
                    out.append((len(words), int(gone.sum()), kept.decode(), [list(x) for x in anchors.runs_of(gone)]))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([combined(batch, "id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.list_(pa.int32())))], names=["id", "n_words", "n_removed", "kept", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return anchors.attach(rows, spans).select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string, spans array<array<int>>")


def removed(spans: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Flags of the symbols that the spans (first run, number of runs) cover."""
    gone = np.zeros(n, bool)
    for s in spans or ():
        gone[s["start"] : s["start"] + s["runs"] - 1 + length] = True
    return gone


def against_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_text_col: str = "text", length: int = 20, most_bytes: int = 8 << 20) -> DataFrame:
    """(id, spans array<struct<start, runs>>): runs of ``length`` words that occur in ``reference``, a table of its own.

    The reference is cut into shards of at most about ``most_bytes``. Each is broadcast, and all documents stream through
    its automaton before the next is read: passes grow with the reference, what is held at once doesn't.
    """
    refs = reference.select(F.coalesce(F.col(ref_text_col), F.lit("")).alias("t"))
    total = refs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most_bytes))
    found = None
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for k in range(parts):
        texts = [r.t for r in refs.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(texts)

        def stream(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton()
            for t in shared.value:
                automaton.add(t.encode().split())
            for batch in it:
                spans = []
                for text in combined(batch, "text").to_pylist():
                    words = text.encode().split()
                    hit = np.zeros(max(0, len(words) - length + 1), bool)
                    for i, n in enumerate(automaton.matching(words)):
                        if n >= length:
                            hit[i - length + 1] = True
                    spans.append([{"start": a, "runs": n} for a, n in anchors.runs_of(hit)])
                yield pa.RecordBatch.from_arrays([combined(batch, "id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("runs", pa.int32())])))], names=["id", "spans"])

        one = staged(rows.mapInArrow(stream, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<start: int, runs: int>>").filter(F.size("spans") > 0), "shard")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    return found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))

