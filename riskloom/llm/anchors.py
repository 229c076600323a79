"""Finds the parts of documents in which a run of ``length`` symbols may occur twice, without shipping the texts.

Symbols are the bytes or the words of a text. Of the grams in each run (of ``gram`` symbols each) the one with the
smallest hash, of equal ones the last, is the run's anchor: equal runs have equal anchors at equal places. The
consecutive runs with one anchor form a segment. So equal runs lie in segments with equal anchors, a run belongs
to exactly one segment, and the runs of one segment all differ. Only segments whose anchor occurs again go on;
equal segments are counted before anything is shuffled as text, and only one of each is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import combined, join_groups, staged, text_slices

_NO_ID = -(1 << 63)
_POS = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Unit:
    """What counts as a symbol (``bytes`` or ``words``), how long a repeat is, and how long a gram."""

    kind: str
    length: int
    gram: int


def keyed(docs: DataFrame, id_col: str, text_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """(id0, fp, id, text): ``id0`` is the id or, for null, the least long; ``fp`` tells rows with one id but different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id0"), F.xxhash64(text).alias("fp"), F.col(id_col).alias("id"), text.alias("text"), *(F.col(c) for c in extra))


def _grams(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams, hashes that segments are summed from, and the text of each symbol."""
    if unit.kind == "words":
        w = W.Words(data, offsets)
        return W.windows(w.hash, unit.gram), w.hash, w.doc
    h, span, eight = _BYTE[data], 1, None
    with np.errstate(over="ignore"):
        while span < unit.gram:
            step = min(span, unit.gram - span)
            h = W.mix(h[:-step] * W._STEP + h[step:]) if len(h) > step else h[:0]
            span += step
            if span == 8:
                eight = h
    return h, (eight if eight is not None else _BYTE[data]), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segments(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, start in the text, runs) of each segment of the texts."""
    h, sums, doc = _grams(data, offsets, unit)
    n = len(doc) - unit.length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    width = unit.length - unit.gram + 1
    if len(h) <= int(_POS):
        v, span = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64)), 1
        while span < width:
            step = min(span, width - span)
            v = np.minimum(v[:-step], v[step:])
            span += step
        at = (_POS - (v & _POS)).astype(np.int64)[:n]
    else:
        at = W.lowest_right(h & ~_POS, width)[:n]
    valid = doc[:n] == doc[unit.length - 1 :]
    new = valid & np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]]
    start = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.r_[(at[1:] != at[:-1]) | ~valid[1:], True])
    if not len(start):
        return none, none, none, none, none
    W._grow(len(sums) + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(sums * W._powers[: len(sums)])]
        end = last + unit.length - (7 if unit.kind == "bytes" and unit.gram >= 8 else 0)
        digest = W.mix((total[end] - total[start]) * W._inverse[start] + ((at[start] - start) * 100_003 + last - start).astype(np.uint64))
    first = np.searchsorted(doc, np.arange(len(offsets) - 1), "left")  # first symbol of each text
    return doc[start], h[at[start]].view(np.int64), digest.view(np.int64), start - first[doc[start]], last - start + 1


def segment_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """(id0, fp, anchor, digest, start, runs) for each segment of ``docs`` (see ``keyed``)."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, fps = combined(part, "id0").to_numpy(), combined(part, "fp").to_numpy()
            for lo, hi, data, offsets in text_slices(combined(part, "text")):
                text, anchor, digest, start, runs = segments(data, offsets, unit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][text]), pa.array(fps[lo:hi][text]), pa.array(anchor), pa.array(digest), pa.array(start.astype(np.int32)), pa.array(runs.astype(np.int32))], names=["id0", "fp", "anchor", "digest", "start", "runs"])

    return docs.select("id0", "fp", "text").mapInArrow(cut, "id0 long, fp long, anchor long, digest long, start int, runs int")


@dataclass
class Candidates:
    """``rows``: segments whose anchor occurs again. ``variants``: one row for each different segment, with ``n`` and
    its first place. ``mixed``: the variants whose anchor has another variant, with their symbols as ``payload``."""

    rows: DataFrame
    variants: DataFrame
    mixed: DataFrame
    total: int


def candidates(docs: DataFrame, unit: Unit) -> Candidates:
    segs = staged(segment_rows(docs, unit), "segments")
    again = staged(segs.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    rows = staged(segs.join(again.hint("merge"), "anchor", "left_semi"), "rows")
    place = F.min(F.struct("id0", "fp", "start")).alias("place")
    variants = staged(rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), place, F.first("runs").alias("runs")), "variants")
    several = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    mixed = variants.join(several.hint("merge"), "anchor")
    return Candidates(rows, variants, staged(payloads(docs, mixed, unit), "mixed"), rows.count())


def attach(docs: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    """Joins to each document (by id0, fp) its list. Both grow with the corpus, so both are shuffled at every size."""
    return docs.join(lists.hint("merge"), ["id0", "fp"], how)


def payloads(docs: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """Adds the symbols of the first place of each variant: its bytes, or its words joined by one space."""
    wanted = staged(mixed.select("place.id0", "place.fp", F.struct("place.start", "runs", "anchor", "digest", "n", "variants").alias("w")).groupBy("id0", "fp").agg(F.collect_list("w").alias("ws")), "wanted")
    joined = attach(docs.select("id0", "fp", "text"), wanted, "inner")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "n", "variants", "id0", "fp", "start", "runs", "payload"]
        for part in parts:
            for batch in (part.slice(i, 200) for i in range(0, part.num_rows, 200)):
                out: list[tuple] = []
                for id0, fp, text, ws in zip(*(combined(batch, c).to_pylist() for c in ("id0", "fp", "text", "ws")), strict=True):
                    symbols = text.encode()
                    symbols = symbols.split() if unit.kind == "words" else symbols
                    for w in ws:
                        part_ = symbols[w["start"] : w["start"] + w["runs"] - 1 + unit.length]
                        out.append((w["anchor"], w["digest"], w["n"], w["variants"], id0, fp, w["start"], w["runs"], b" ".join(part_) if unit.kind == "words" else part_))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(read, "anchor long, digest long, n long, variants long, id0 long, fp long, start int, runs int, payload binary")


def in_buckets(mixed: DataFrame, bucket_bytes: int) -> DataFrame:
    """Adds ``bucket``: equal anchors share one; there are as many as the text needs."""
    size = mixed.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
    n = max(8, -(-size // bucket_bytes))
    return mixed.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n))).repartition(n, "bucket")


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def by_window_hash(mixed: DataFrame, unit: Unit, first_stays: bool) -> DataFrame:
    """The repeated runs of variants with too many siblings for one task: one row for each run, grouped by a 128-bit
    hash of the run with partial aggregation, so that no group meets in one task. Returns (id0, fp, start, runs)."""

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in parts:
            out = []
            for id0, fp, start, runs, payload in zip(*(combined(part, c).to_pylist() for c in ("id0", "fp", "start", "runs", "payload")), strict=True):
                symbols = payload.split(b" ") if unit.kind == "words" else payload
                for j in range(runs):
                    run = symbols[j : j + unit.length]
                    out.append((hashlib.blake2b(b" ".join(run) if unit.kind == "words" else run, digest_size=16).digest(), id0, fp, start + j))
                if len(out) >= 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["run", "id0", "fp", "start"])

    once = mixed.dropDuplicates(["anchor", "digest"])  # rows that repeat id and text give their segments more than once
    runs = staged(once.mapInArrow(explode, "run binary, id0 long, fp long, start int"), "runs")
    groups = staged(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id0", "fp", "start")).alias("first")).filter("n > 1"), "groups")
    found = join_groups(runs, groups, "run", "n", runs.count())
    if first_stays:
        found = found.filter(F.struct("id0", "fp", "start") != F.col("first"))
    return found.select("id0", "fp", "start", F.lit(1).alias("runs"))


def repeats(docs: DataFrame, unit: Unit, resolve: Callable[[DataFrame], DataFrame], first_stays: bool, bucket_bytes: int, most_variants: int) -> DataFrame:
    """(id0, fp, spans array<struct<start, runs>>): the runs to remove of each document that has any.

    ``resolve`` finds them among the variants of shared anchors (see ``Candidates.mixed``, with ``bucket``) and
    returns (id0, fp, start, runs). Copies of one segment need no search: they repeat as a whole. With
    ``first_stays`` the first place of a run is no repeat. Anchors with more than ``most_variants`` variants, which
    would be too much for one task, go by ``by_window_hash`` instead, with the same result.
    """
    c = candidates(docs, unit)
    copied = join_groups(c.rows.select("anchor", "digest", "id0", "fp", "start", "runs").withColumn("seg", F.struct("anchor", "digest")), c.variants.filter("n > 1").select(F.struct("anchor", "digest").alias("seg"), "n", "place"), "seg", "n", c.total)
    if first_stays:
        copied = copied.filter(F.struct("id0", "fp", "start") != F.col("place"))
    copied = copied.select("id0", "fp", "start", "runs")
    found = copied.unionByName(resolve(in_buckets(c.mixed.filter(F.col("variants") <= most_variants), bucket_bytes)))
    crowded = c.mixed.filter(F.col("variants") > most_variants)
    if crowded.take(1):
        found = found.unionByName(by_window_hash(crowded, unit, first_stays))
    return staged(found.groupBy("id0", "fp").agg(F.collect_list(F.struct("start", "runs")).alias("spans")), "spans")
