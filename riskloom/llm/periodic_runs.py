"""Runs in documents: stretches of words that repeat themselves with some period, found by a dictionary of basic factors.

The dictionary names, for each power of two f, the factors of f words at each place of a text: equal factors have equal
names, and the names for 2f come from pairs of names for f. At each place the next occurrence of the same factor that
lies within a stretch of 2f words is at a distance of f at most. Inside a run of smallest period p, f/2 < p <= f, all
these distances are p: the occurrences form an arithmetic progression, and the places with one distance follow
one another. (A factor of p or more words of a run occurs again p words on and no sooner, as the run's root isn't a
power.) So each stretch of places with one distance d proposes the period d, and is then extended to both sides as far
as words d apart are identical. A run that holds three periods holds two such factors at the level f < 2p, so none is missed.

Factors that don't occur again in their document have no place on the next level, so plain text ends after a few of them.
Documents are independent of one another: nothing is shuffled, and a task holds about a megabyte of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import combined, list_array

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
_SLICE = 1 << 20


def runs(ids: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start in the text, length, period) of all runs of ``least`` words and ``times`` periods or more, by text, start, period.

    ``ids``: the numbers of the words of all texts, equal for equal words; ``first``: where each text begins, and the end.
    """
    if times < 3:
        raise ValueError("shorter runs than of three periods may be missed")
    n, sizes = len(ids), np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end, begin = first[text + 1], first[text]
    name, at, f = ids.astype(np.int64), np.arange(n), 1
    found = []
    while len(at):
        most = int(name[at].max()) + 1
        key = text[at] * most + name[at]
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        left, right = place[:-1][same], place[1:][same]
        distance = np.zeros(n, np.int64)  # to the next occurrence in the text
        distance[left] = right - left
        # progressions: places that follow one another and have one distance
        i = left[(right - left <= f) & (2 * (right - left) > f)]
        i.sort()
        d = distance[i]
        new = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(d) != 0)]) if len(i) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(i)] - 1 if len(i) else new
        lo, hi, d = i[new], i[last] + f + d[new], d[new]
        while len(lo):  # extend
            more = (lo > begin[lo]) & (ids[np.maximum(lo - 1, 0)] == ids[np.maximum(lo - 1, 0) + d])
            if not more.any():
                break
            lo = lo - more
        while len(hi):
            more = (hi < end[lo]) & (ids[np.minimum(hi, n - 1)] == ids[np.minimum(hi, n - 1) - d])
            if not more.any():
                break
            hi = hi + more
        long = hi - lo >= np.maximum(least, times * d)
        found.append(np.stack([text[lo], lo - begin[lo], hi - lo, d])[:, long])
        # the next level: pairs of factors that both occur again
        again = np.zeros(n, bool)
        again[left] = again[right] = True
        next_at = at[again[at] & (at + 2 * f <= end[at])]
        next_at = next_at[again[next_at + f]]
        if len(next_at):
            name[next_at] = np.unique(name[next_at] * most + name[next_at + f], return_inverse=True)[1]
        at, f = next_at, 2 * f
    every = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)  # deduplicate
    every = every[:, np.lexsort((every[3], every[1], every[0]))]
    return tuple(every)


def dropped(first: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a run contains a word after its first period, for all words of the texts."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, first[text] + start + period, 1)
    np.add.at(edge, first[text] + start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period, by start and period), collapsed.

    Words are what white space (space and x09 to x0D) separates, compared as they are and numbered from 0. A run is a
    stretch of at least ``least`` words and ``times`` smallest periods that can't be extended with its period. ``collapsed``
    has the words that no run contains after its first period, joined by one space. Null and empty texts have no words, no
    runs and an empty ``collapsed``. Rows that repeat an id are judged row by row, ids may be null and of any type, an
    empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = combined(part, "id"), combined(part, "text").cast(pa.large_binary())
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            lo = 0
            while lo < len(texts):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), _SLICE, "right")))
                words = [t.split() for t in texts[lo:hi].to_pylist()]  # at ASCII white space
                first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
                numbers: dict[bytes, int] = {}
                named = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, int(first[-1]))
                text, start, length, period = runs(named, first, least, times)
                gone = dropped(first, text, start, length, period)
                hit = set(text.tolist())
                left = [b" ".join([w for w, g in zip(ws, gone[first[k] : first[k + 1]].tolist(), strict=True) if not g] if k in hit else ws) for k, ws in enumerate(words)]
                each = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=["start", "length", "period"])
                lists = list_array(np.arange(len(text)), np.bincount(text, minlength=hi - lo), pa.int64())
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(lists.offsets, each), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])
                lo = hi

    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(find, schema)
