"""Suffix-array dedup: repeated byte strings are found by merging the Burrows-Wheeler transforms of shards.

Segments that share an anchor (see ``anchors``) go to one bucket and are cut into shards. The alphabet of the
transforms is blocks of ``width`` bytes, so that a string of ``length`` bytes is ``length / width`` symbols; each
segment gives ``width`` texts, one for each phase. Each shard's transform is made on its own. Merging starts with the
shards one after the other; each step walks through the interleave, takes the next unread symbol of the shard it
names, and puts the shard into that symbol's stretch, keeping order. After k steps all suffixes stand in the order of
their first k symbols, and borders of the stretches show where common prefixes are shorter than k. After
``length / width`` steps a stretch of two or more suffixes is a repeated string. No suffix is compared or sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from . import words as W
from .shared import combined
from .substring_dedup import removed

GRAM = 32
BUCKET_BYTES = 1 << 19
SHARD_BYTES = 1 << 17
#: More variants of one anchor than this are searched by hash instead, spread over all tasks.
MOST_VARIANTS = 4_000


def block_width(length: int, most: int = 100) -> int:
    """The largest divisor of ``length`` up to ``most``."""
    return next(w for w in range(min(most, length), 0, -1) if length % w == 0)


class Blocks:
    """Positions of a bucket's segments as suffixes over the alphabet of blocks.

    ``symbol``: the block that starts at the position as a dense number from 1; 0 where the segment has no whole
    block left, which ends the text of this phase. Positions of one segment are next to each other.
    """

    def __init__(self, payloads: list[bytes], width: int):
        sizes = np.array([len(p) + 1 for p in payloads], np.int64)  # with one place for the end
        data = np.frombuffer(b"".join(p + b"\0" for p in payloads), np.uint8)
        self.width, self.first = width, np.r_[0, np.cumsum(sizes)]
        place = np.arange(len(data), dtype=np.int32)
        self.left = np.repeat(self.first[1:].astype(np.int32), sizes) - place
        self.offset = place - np.repeat(self.first[:-1].astype(np.int32), sizes)
        hashes, span = anchors._BYTE[data], 1
        with np.errstate(over="ignore"):
            while span < width:
                step = min(span, width - span)
                hashes = W.mix(hashes[:-step] * W._STEP + hashes[step:]) if len(hashes) > step else hashes[:0]
                span += step
        self.symbol = np.zeros(len(data), np.int32)
        whole = np.flatnonzero(self.left > width)
        self.symbol[whole] = np.unique(hashes[whole], return_inverse=True)[1] + 1


class ShardBwt:
    """The sorted suffixes of some segments (``order``: positions) and the symbol before each (0 at the start of a text)."""

    def __init__(self, blocks: Blocks, lo: int, hi: int):
        here = np.arange(lo, hi, dtype=np.int32)
        w, symbol, end = blocks.width, blocks.symbol[lo:hi].astype(np.int64), blocks.left[lo:hi]
        last = symbol == 0  # the empty suffix that ends a text; smallest, in the order of the texts
        rank = np.where(last, np.cumsum(last), symbol + np.count_nonzero(last))
        step = w
        while step < (end.max() if len(end) else 0):
            after = np.zeros(len(here), np.int64)
            inside = np.flatnonzero(end > step)
            after[inside] = rank[inside + step]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] if len(rank) else rank
            step *= 2
        self.order = here[np.argsort(rank, kind="stable")]
        self.ends = int(np.count_nonzero(last))
        before = np.where(blocks.offset[self.order] >= w, blocks.symbol[self.order - w], 0)
        self.symbols = before


def merge(shards: list[ShardBwt], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of their first ``steps`` symbols, and the number of the stretch of each."""
    sizes = [len(s.order) for s in shards]
    base = np.r_[0, np.cumsum(sizes)][:-1]
    symbols, order = np.concatenate([s.symbols for s in shards]), np.concatenate([s.order for s in shards])
    names = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.int32), [s.ends for s in shards])
    z, stretch = names, np.zeros(len(order), np.int32)
    for _ in range(steps):
        at = _unread(z, base, len(shards))
        c = symbols[at]
        go = np.flatnonzero(c > 0)
        go = go[np.argsort(c[go], kind="stable")]
        border = np.r_[True, (c[go][1:] != c[go][:-1]) | (stretch[go][1:] != stretch[go][:-1])] if len(go) else np.zeros(0, bool)
        z = np.r_[ends, z[go]]
        stretch = np.r_[np.arange(len(ends), dtype=np.int32), len(ends) - 1 + np.cumsum(border, dtype=np.int32)]
    return order[_unread(z, base, len(shards))], stretch


def _unread(z: np.ndarray, base: np.ndarray, shards: int) -> np.ndarray:
    """For each place of the interleave, the index of the suffix that it stands for: the next of its shard."""
    at = np.empty(len(z), np.int32)
    for s in range(shards):
        mine = np.flatnonzero(z == s)
        at[mine] = base[s] + np.arange(len(mine))
    return at


def repeated_starts(payloads: list[bytes], length: int, width: int, shard_bytes: int) -> np.ndarray:
    """Flags of the positions (of the payloads, each with one place for its end) where a string of ``length`` bytes starts that also starts elsewhere."""
    flags = np.zeros(sum(map(len, payloads)) + len(payloads), bool)
    if not len(flags):
        return flags
    blocks = Blocks(payloads, width)
    cuts = [0]
    for i in range(len(payloads)):
        if blocks.first[i + 1] - blocks.first[cuts[-1]] > shard_bytes or i == len(payloads) - 1:
            cuts.append(i + 1)
    shards = [ShardBwt(blocks, int(blocks.first[a]), int(blocks.first[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    order, stretch = merge(shards, length // width)
    whole = blocks.left[order] > length
    order, stretch = order[whole], stretch[whole]
    flags[order[np.bincount(stretch, minlength=1)[stretch] > 1] if len(order) else order] = True
    return flags


def _resolve(mixed: DataFrame, unit: anchors.Unit, shard_bytes: int) -> DataFrame:
    width = block_width(unit.length)

    def search(table: pa.Table) -> pa.Table:
        rows = list({(r["anchor"], r["digest"]): r for r in table.to_pylist()}.values())
        flags = repeated_starts([r["payload"] for r in rows], unit.length, width, shard_bytes)
        out, at = [], 0
        for r in rows:
            mine = flags[at : at + r["runs"]]
            at += len(r["payload"]) + 1
            if r["n"] == 1 and mine.any():  # all copies of a segment with copies go anyway
                out += [(r["id0"], r["fp"], r["start"] + a, n) for a, n in anchors.runs_of(mine)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id0", "fp", "start", "runs"])

    return mixed.groupBy("bucket").applyInArrow(search, "id0 long, fp long, start int, runs int")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_variants: int = MOST_VARIANTS, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, kept (remaining bytes), spans (start, bytes) of the removed runs.

    A byte of the UTF-8 text goes if a string of ``length`` bytes over it also starts anywhere else, in this or
    another document; overlapping strings count; all copies go. Strings are judged on the input and never cross
    documents. Null is the empty text, shorter texts lose nothing. Rows that repeat an id and its text are texts of
    their own. Of the input only the two named columns are read.
    """
    unit = anchors.Unit("bytes", length, min(GRAM, length))
    rows = anchors.keyed(docs, id_col, text_col)
    spans = anchors.repeats(rows, unit, lambda mixed: _resolve(mixed, unit, shard_bytes), False, bucket_bytes, most_variants)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in (part.slice(i, 500) for i in range(0, part.num_rows, 500)):
                out = []
                for text, ss in zip(combined(batch, "text").to_pylist(), combined(batch, "spans").to_pylist(), strict=True):
                    data = text.encode()
                    gone = removed(ss, len(data), length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if ss else data
                    out.append((len(data), int(gone.sum()), kept, [list(x) for x in anchors.runs_of(gone)] if ss else []))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([combined(batch, "id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.list_(pa.int32())))], names=["id", "n_bytes", "n_removed", "kept", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return anchors.attach(rows, spans).select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, kept binary, spans array<array<int>>")
