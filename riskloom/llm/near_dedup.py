"""Near-duplicate detection by b-bit MinHash, with exact confirmation and connected components.

Documents with equal shingle sets form a class first, so copies cost one row. Bands of full minima generate the
candidates; then only the low ``BITS`` bits of each minimum are kept, packed into longs, and the similarity of a
candidate pair is estimated from their bit counts, corrected for chance collisions. Pairs well under the threshold
end there; the others are confirmed on the full shingle sets.

A bucket of many near copies is not paired up: buckets that share documents are gathered, each document once, and
inside a task a document only meets those that it isn't connected with yet. What leaves a task are the links of a
spanning forest. Groups too large for a task are cut into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import combined, join_groups, list_array, staged, text_slices

SHINGLE = 5
BITS = 2
BANDS, ROWS = 25, 5
MINIMA = 128
#: Pairs whose estimate is this far under the threshold go no further: over five standard deviations of the estimate.
MARGIN = 0.2
#: A task compares at most so many documents, or documents with so many shingles together, with each other.
MOST_ROWS, MOST_SHINGLES = 4096, 1_000_000
#: Groups with more close pairs than this for each document count their intersections at once.
FEW = 24

_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text: ``size`` lower-cased words, or all words of a shorter text."""
    w = W.Words(data, offsets, lower=True)
    h = W.windows(w.hash, size)
    out = []
    for i, n in enumerate(w.counts.tolist()):
        at = int(w.first[i])
        if n >= size:
            out.append(np.unique(h[at : at + n - size + 1]))
        else:
            out.append(W.windows(w.hash[at : at + n], n) if n else np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), MINIMA) 32-bit minima; the sets are not empty."""
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])][:-1]
    out = np.empty((len(sets), MINIMA), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(MINIMA):
            x = flat * _MULTIPLY[k] + _ADD[k]
            out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return W.mix(out)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(m), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            k = np.full(len(m), b + 1, np.uint64)
            for r in range(ROWS):
                k = W.mix(k * np.uint64(0x9E3779B97F4A7C15) + m[:, b * ROWS + r])
            keys[:, b] = k
    return keys.view(np.int64)


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, 64 / ``bits`` of them to a long."""
    lanes = 64 // bits
    low = (m & np.uint64((1 << bits) - 1)).reshape(len(m), MINIMA // lanes, lanes)
    return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, key, bands, sig) of (id, text); key names the shingle set (128 bits), null for an empty one."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = combined(part, "id")
            for lo, hi, data, offsets in text_slices(combined(part, "text")):
                sets = shingle_sets(data, offsets)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sigs = np.zeros((len(sets), 0), np.int64), np.zeros((len(sets), 0), np.int64)
                counts = np.array([len(s) for s in sets], np.int64)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                if full:
                    m = minima([sets[i] for i in full])
                    bands, sigs = band_keys(m), packed(m)
                some = (counts > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(counts), pa.array(keys, pa.binary()), list_array(bands.ravel(), some * BANDS, pa.int64()), list_array(sigs.ravel(), some * (MINIMA * BITS // 64), pa.int64())], names=["id", "n_shingles", "key", "bands", "sig"])

    return docs.mapInArrow(sign, "id long, n_shingles long, key binary, bands array<long>, sig array<long>")


def links_of(texts: list[str], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join the texts into the components of all their links.

    Each text meets the later ones that are not in its component yet. Those whose estimate comes near the threshold are
    confirmed on the full sets.
    """
    raw = [t.encode() for t in texts]
    sets: list[np.ndarray] = []
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= 1 << 20):
            size += len(raw[hi])
            hi += 1
        sets += shingle_sets(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw[lo:hi]])])
        lo = hi
    sizes = np.array([len(x) for x in sets], np.int64)
    close = []
    for x in range(len(sets) - 1):
        rest = np.arange(x + 1, len(sets))
        rest = rest[100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])]
        close.append(rest[similarity(sigs[x], sigs[rest]) >= percent / 100 - MARGIN])
    shared = None
    if sum(map(len, close)) > FEW * len(sets):  # of sets with a close one only
        some = np.unique(np.concatenate([np.r_[x, rest] for x, rest in enumerate(close) if len(rest)]))
        shared, at = intersections([sets[i] for i in some]), np.searchsorted(some, np.arange(len(sets)))
    component, found = np.arange(len(sets)), []
    for x, rest in enumerate(close):
        rest = rest[component[rest] != component[x]]
        if not len(rest):
            continue
        both = shared[at[x], at[rest]].astype(np.int64) if shared is not None else np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in rest])
        for y in rest[100 * both >= percent * (sizes[x] + sizes[rest] - both)].tolist():
            if component[y] != component[x]:
                component[component == component[y]] = component[x]
                found.append((x, y))
    return found


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets (float32, exact below 2^24).

    Shingles that a tenth of the sets have are counted by a matrix product, slice by slice; rarer ones by their pairs.
    """
    m = len(sets)
    row = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    common = df >= max(8, m // 10)
    numbers = np.cumsum(common) - 1
    mine = common[column]
    dense_row, dense_column = row[mine], numbers[column[mine]]
    for lo in range(0, int(common.sum()), 1024):
        here = (dense_column >= lo) & (dense_column < lo + 1024)
        block = np.zeros((m, 1024), np.float32)
        block[dense_row[here], dense_column[here] - lo] = 1
        out += block @ block.T
    few = ~mine & (df[column] > 1)
    order = np.argsort(column[few], kind="stable")
    r, c = row[few][order].astype(np.int64), column[few][order]
    flat, step = out.reshape(-1), 1
    while len(same := np.flatnonzero(c[step:] == c[:-step])) if step < len(c) else 0:
        np.add.at(flat, r[same] * m + r[same + step], np.float32(1))
        np.add.at(flat, r[same + step] * m + r[same], np.float32(1))
        step += 1
    return out


def similarity(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity of packed signature ``a`` and each of ``b``, corrected for minima that agree in their low bits by chance."""
    x = (a ^ b).view(np.uint64)
    step = 1
    while step < bits:
        x = x | (x >> np.uint64(step))
        step *= 2
    lanes = x & np.uint64(sum(1 << i for i in range(0, 64, bits)))
    agree, chance = 1 - np.bitwise_count(lanes).sum(axis=1, dtype=np.int64) / MINIMA, 2.0**-bits
    return (agree - chance) / (1 - chance)


def _blocks(classes: DataFrame, members: DataFrame, most_rows: int, most_shingles: int) -> DataFrame:
    """(kind, key, i, j, cls): where each class meets others. Buckets that share classes form one group, in which every
    class stands once; a group that is too much for one task goes by buckets, and such a bucket by pairs of chunks."""
    pivots = members.groupBy("bucket").agg(F.min("cls").alias("b"))
    groups = components(members.join(pivots.hint("merge"), "bucket").select(F.col("cls").alias("a"), "b"))
    sized = staged(groups.select(F.col("node").alias("cls"), F.col("component").alias("group")).join(classes.select("cls", "n_shingles").hint("merge"), "cls"), "grouped")
    total = sized.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("shingles") / most_shingles)).cast("int")
    sized = staged(sized.join(total.select("group", parts.alias("parts")), "group"), "sized")
    zero = F.lit(0)
    whole = sized.filter("parts = 1").select(zero.alias("kind"), F.col("group").alias("key"), zero.alias("i"), zero.alias("j"), "cls")
    large = members.join(sized.filter("parts > 1").select("cls", "n_shingles").hint("merge"), "cls")
    chunks = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).select("bucket", parts.alias("parts"))
    placed = large.join(chunks, "bucket").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    placed = placed.select("bucket", "cls", "c", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("o"))
    return whole.unionByName(placed.select(F.lit(1).alias("kind"), F.col("bucket").alias("key"), F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "cls"))


def _links(classes: DataFrame, rows: DataFrame, percent: int, most_rows: int, most_shingles: int) -> DataFrame | None:
    """(node, component) over the classes that have links; None if no two share a bucket."""
    spread = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = staged(spread.groupBy("bucket").count().filter("count > 1").select("bucket"), "buckets")
    members = staged(spread.join(shared.hint("merge"), "bucket"), "members")
    if not members.take(1):
        return None
    blocks = staged(_blocks(classes, members, most_rows, most_shingles).join(classes.select("cls", "sig", "n_shingles").hint("merge"), "cls"), "blocks")
    bins = max(8, -(-(blocks.agg(F.sum("n_shingles")).first()[0] or 0) // (most_shingles // 4)))
    bin_ = F.pmod(F.xxhash64("kind", "key", "i", "j"), F.lit(bins))
    texts = rows.select(F.col("id").alias("cls"), "text").join(blocks.hint("merge"), "cls").withColumn("bin", bin_).repartition(bins, "bin")

    def test(table: pa.Table) -> pa.Table:
        met: dict[tuple, list[dict]] = {}
        for r in table.to_pylist():
            met.setdefault((r["kind"], r["key"], r["i"], r["j"]), []).append(r)
        out = []
        for group in met.values():
            group.sort(key=lambda r: r["cls"])
            found = links_of([r["text"] for r in group], np.array([r["sig"] for r in group], np.int64), percent)
            out += [(group[x]["cls"], group[y]["cls"]) for x, y in found]
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return components(texts.groupBy("bin").applyInArrow(test, "a long, b long"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, most_rows: int = MOST_ROWS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """One row per document: id, n_shingles, component, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set has its distinct shingles of five words,
    one of a shorter text. Documents are linked if 100 * intersection >= ``percent`` * union, and the component is the
    smallest id reachable over links; that document is kept. Null and empty texts have no shingles and no links. A row
    with a null id is linked with nothing: its component is null and it is kept. Rows with one id are one document with
    the links of all its texts. Ids are whole numbers. Of the input only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = staged(signatures(rows), "signatures")
    full = signed.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = staged(full.groupBy("key").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")

    labels = _links(classes, rows, percent, most_rows, most_shingles)
    named = classes.select("key", "cls", "size")
    named = named.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left") if labels is not None else named.withColumn("component", F.lit(None).cast("long"))
    named = staged(named.select("key", "size", F.coalesce("component", "cls").alias("component")), "named")
    linked = join_groups(full.select("id", "n_shingles", "key"), named, "key", "size", full.count()).select("id", "n_shingles", "component")
    alone = signed.filter("key IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
