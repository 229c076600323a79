"""Line dedup by an exact set-similarity join.

Tokens of a line are ordered by rarity (hashed corpus counts, ties by hash: any order that all lines share is
exact). Two sets with Jaccard similarity over the threshold share a token of their prefixes; their lengths, the
token's positions and a 128-bit parity sketch rule out most candidates, and the rest are verified on their full sets.

A line is removed if any earlier line matches, so one match is enough. Prefix entries are shuffled once, by token. In a
task a line with the set of an earlier one goes at once, and of the others' candidates the MOST_CANDIDATES nearest
leave the task and are verified. A line that had more of them, all of which failed, or that has a token of more than
MOST_ROWS lines (such a token is cut into chunks, so no task gets all of its lines) then meets all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .anchors import attach, keyed
from .shared import combined, discard, list_array, partitions_for, staged, text_slices

#: The rarity table: so many one-byte counters, whatever the corpus; this is the size of the broadcast.
SLOTS = 1 << 24
_CHUNK = 1 << 14
#: At most about so many lines of a token, and of lines that ask for partners, meet in one block.
MOST_ROWS = 4096
#: Candidates of a line that one task passes on in the first round.
MOST_CANDIDATES = 16
#: Rows of blocks in one task, on average.
_TASK_ROWS = 400_000
#: Blocks of up to so many rows are compared all at once, larger ones one by one.
_STEPS = 256
#: Pairs that a task holds before it picks the nearest.
_HELD = 1 << 20

PLACE = ("id0", "fp", "line")


class LineSets:
    """The sets of the lines with words of a run of texts; lines end at \\n.

    ``doc``, ``line``: the text and the number of each line; ``token``: the distinct word hashes of the lines one after
    the other, ``start`` the first of each line, ``n`` how many, ``group`` the line of each. In a line tokens stand by
    ``weight`` (of the slots of a table of bytes; the rarest first), then by hash. ``only``: lines to read, as doc << 32 | line.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None, only: np.ndarray | None = None):
        w = W.Words(data, offsets)
        breaks = np.flatnonzero(data == 10)
        before = np.cumsum(np.bincount(np.searchsorted(w.start, breaks), minlength=len(w.start) + 1)[: len(w.start)])  # line breaks before each word
        line = before - np.searchsorted(breaks, offsets[:-1])[w.doc]
        new = np.r_[True, (w.doc[1:] != w.doc[:-1]) | (before[1:] != before[:-1])][: len(line)]
        self.doc, self.line = w.doc[new], line[new]
        group, hashes = np.cumsum(new) - 1, w.hash
        if only is not None:
            asked = np.isin(self.doc << 32 | self.line, only)
            hashes, group = hashes[asked[group]], (np.cumsum(asked) - 1)[group[asked[group]]]
            self.doc, self.line = self.doc[asked], self.line[asked]
        weight = table[hashes & np.uint64(len(table) - 1)] if table is not None else np.zeros(len(group), np.uint8)
        order = np.argsort(weight.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))
        small = group.astype(np.uint16) if len(self.doc) < 1 << 16 else group
        order = order[np.argsort(small[order], kind="stable")]
        group, token = group[order], hashes[order]
        first = np.r_[True, (group[1:] != group[:-1]) | (token[1:] != token[:-1])][: len(group)]
        self.group, self.token, self.weight = group[first], token[first], weight[order][first]
        self.start = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]][: len(self.group)])
        self.n = np.diff(np.r_[self.start, len(self.group)])


def gathered(parts: DataFrame) -> np.ndarray:
    """The sums of ``parts`` (chunk, slot: 16-bit numbers, n: 32-bit counts) as one array of SLOTS counts on a log scale.

    Counts are summed chunk by chunk as they stream by; what comes to the driver is SLOTS bytes, whatever the corpus.
    0 is never, 1 once, n times 1 + 8 log2(n) rounded down, so that rarity still tells words apart in large corpora.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, slot, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total = sums.setdefault(c, np.zeros(_CHUNK, np.int64))
                total[np.frombuffer(slot, np.uint16)] += np.frombuffer(n, np.uint32)
        for c, total in sums.items():
            scale = np.where(total > 0, np.minimum(1 + np.floor(8 * np.log2(np.maximum(total, 1))), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([scale.tobytes()])], names=["chunk", "counts"])

    out = np.zeros(SLOTS, np.uint8)
    table = parts.repartition(64, "chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    for c, b in zip(table.column("chunk").to_pylist(), table.column("counts").to_pylist(), strict=True):
        out[c * _CHUNK : (c + 1) * _CHUNK] = np.frombuffer(b, np.uint8)
    return out


def by_chunk(slots: np.ndarray) -> pa.RecordBatch:
    """(chunk, slot, n) of ``slots``, each with how often it occurs."""
    slot, n = np.unique(slots, return_counts=True)
    chunk = (slot // _CHUNK).astype(np.int32)
    edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(slot) else np.zeros(1, np.int64)
    low, n = (slot % _CHUNK).astype(np.uint16), n.astype(np.uint32)
    columns = [pa.array(chunk[edge[:-1]]), *(pa.array([x[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (low, n))]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "slot", "n"])


def rarity(rows: DataFrame) -> np.ndarray:
    """How often the words of each hash slot occur, see ``gathered``."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            slots = [slots_of(W.Words(data, offsets).hash) for _, _, data, offsets in text_slices(combined(part, "text"))]
            yield by_chunk(np.concatenate(slots) if slots else np.zeros(0, np.uint32))

    return gathered(rows.select("text").mapInArrow(count, "chunk int, slot binary, n binary"))


def slots_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SLOTS - 1)).astype(np.uint32)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of ``n`` of which a similar set must share one; equal sets share the first."""
    return np.maximum(1, n + 1 - -(-percent * n // 100))


#: What an entry says of its line, packed so that it is one column of the shuffle: the place, the number of distinct words,
#: and two hashes of the set.
LINE = np.dtype([("id0", "<i8"), ("fp", "<i8"), ("line", "<i4"), ("n", "<i4"), ("key", "<u8"), ("sketch", "<u8", 2)])


def packed(values: np.ndarray) -> pa.Array:
    """A binary column of the rows of a structured array."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, size * (len(values) + 1), size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The structured array of a binary column of such rows."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + kind.itemsize * len(column)].view(kind) if len(column) else np.zeros(0, kind)


def set_name(x: np.ndarray) -> np.ndarray:
    """What tells the sets of LINEs apart: all that is known of them, in 64 bits."""
    with np.errstate(over="ignore"):
        return W.mix(x["key"] ^ W.mix(x["sketch"][:, 0] + x["n"].astype(np.uint64)) ^ W.mix(x["sketch"][:, 1] ^ np.uint64(0x9E3779B97F4A7C15)))


def line_rows(rows: DataFrame, counts: Broadcast, percent: int) -> DataFrame:
    """(id0, fp, line, again, m, skipped, data, prefix array<long>, common array<long>) for each line that may match another.

    ``data`` is a LINE: its key names the set together with n and the sketch. Bit i of the sketch is the parity of the
    tokens with hash i (mod 128), so two sketches differ in no more bits than their sets in tokens. Tokens that occur once
    in the corpus are left out of the prefix, and a line without others: no other line has them. They come first in the
    order, so the position of a token is its index and the number of those left out, ``skipped``. ``common`` are the last tokens of the
    prefix, those that so many lines may have that their blocks could be too large. ``again``: an earlier line of the same
    batch has the same set; such a line needs no prefix. ``m`` is the length of the prefix.
    """
    seed, often = np.uint64(0xA0761D6478BD642F), 1 + int(8 * np.log2(MOST_ROWS))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for part in parts:
            ids, fps = combined(part, "id0").to_numpy(), combined(part, "fp").to_numpy()
            found = []
            for lo, _, data, offsets in text_slices(combined(part, "text")):
                s = LineSets(data, offsets, table)
                if not len(s.start):
                    continue
                x = np.zeros(len(s.start), LINE)
                with np.errstate(over="ignore"):
                    x["key"] = W.mix(np.add.reduceat(W.mix(s.token ^ seed), s.start))
                bit, half = np.uint64(1) << (s.token >> np.uint64(57) & np.uint64(63)), s.token >> np.uint64(63)
                for i in (0, 1):
                    x["sketch"][:, i] = np.bitwise_xor.reduceat(np.where(half == i, bit, np.uint64(0)), s.start)
                x["id0"], x["fp"], x["line"], x["n"] = ids[s.doc + lo], fps[s.doc + lo], s.line, s.n
                pos = np.arange(len(s.token)) - s.start[s.group]
                inside = pos < prefix_size(s.n, percent)[s.group]
                lists, skipped = [], np.bincount(s.group[inside & (s.weight < 2)], minlength=len(x))
                for mine in (inside & (s.weight > 1) & (s.weight < often), inside & (s.weight >= often)):
                    lists += [np.bincount(s.group[mine], minlength=len(x)), s.token[mine]]
                some = lists[0] + lists[2] > 0
                found.append((x[some], skipped[some], lists[0][some], lists[1], lists[2][some], lists[3]))
            if not found:
                continue
            x, skipped, m, prefix, k, common = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(x["key"], kind="stable")
            same = np.r_[False, x["key"][order][1:] == x["key"][order][:-1]]
            order = order[same | np.r_[same[1:], False]]
            name = set_name(x)
            order = order[np.lexsort([*(x[c][order] for c in ("line", "fp", "id0")), name[order]])]
            head = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]][: len(order)])
            first = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
            again, repeat = np.zeros(len(x), bool), np.zeros(len(x), bool)
            repeat[order] = order != first
            again[order] = x[list(PLACE)][order] != x[list(PLACE)][first]  # else a row that repeats id and text
            prefix, common = prefix[np.repeat(~repeat, m)], common[np.repeat(~repeat, k)]
            m, k = np.where(repeat, 0, m), np.where(repeat, 0, k)
            lists = [list_array(prefix.view(np.int64), m, pa.int64()), list_array(common.view(np.int64), k, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[c].copy()) for c in PLACE), pa.array(again), pa.array((m + k).astype(np.int32)), pa.array(skipped.astype(np.int32)), packed(x), *lists], names=[*PLACE, "again", "m", "skipped", "data", "prefix", "common"])

    return rows.select("id0", "fp", "text").mapInArrow(cut, "id0 long, fp long, line int, again boolean, m int, skipped int, data binary, prefix array<long>, common array<long>")


def nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, most: int, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each ``b`` the ``most`` nearest; marks in ``more`` those that had others."""
    order = np.lexsort((a, apart, b))
    a, b, apart = a[order], b[order], apart[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
    ok = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)])) < most
    more[b[~ok]] = True
    return a[ok], b[ok], apart[ok]


def candidates(x: np.ndarray, pos: np.ndarray, block: np.ndarray, no: np.ndarray, role: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(earlier, later, apart): positions of an indexed and a later probing row of one block that may be similar.

    The rows (LINE and the token's position) are ordered by block and place, of which ``no`` is the number. Two sets
    with a shared token need a size ratio of ``percent`` hundredths, as many tokens from this one on as they must
    share, and sketches no further apart than their other tokens.
    """
    n, sketch = x["n"].astype(np.int64), np.ascontiguousarray(x["sketch"])
    left, index, probe = n - pos, role & 1 > 0, role & 2 > 0

    def pick(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        ok = index[a] & probe[b] & (no[a] < no[b])
        a, b = a[ok], b[ok]
        least = -(-percent * (n[a] + n[b]) // (100 + percent))
        ok = np.minimum(left[a], left[b]) >= least
        a, b, least = a[ok], b[ok], least[ok]
        apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        ok = apart <= n[a] + n[b] - 2 * least
        return a[ok], b[ok], apart[ok]

    edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(x) else np.zeros(1, np.int64)
    sizes = np.diff(edge)
    end = np.repeat(edge[1:], sizes)
    at = np.flatnonzero(np.repeat(sizes <= _STEPS, sizes))
    step = 1
    while len(at := at[at + step < end[at]]):
        yield pick(at, at + step)
        step += 1
    for lo, hi in zip(edge[:-1][sizes > _STEPS].tolist(), edge[1:][sizes > _STEPS].tolist(), strict=True):
        held, asked = lo + np.flatnonzero(index[lo:hi]), lo + np.flatnonzero(probe[lo:hi])
        wide = max(1, (1 << 20) // max(len(held), 1))
        for k in range(0, len(asked), wide):
            yield pick(np.tile(held, len(asked[k : k + wide])), np.repeat(asked[k : k + wide], len(held)))


def met(entries: DataFrame, about: int, percent: int, most: int | None) -> DataFrame:
    """What meets in the ``about`` ``entries`` (block, tag, data): a row for each later line and candidate.

    ``tag`` is four times the token's position and 1 for a line that others ask for, 2 for one that asks, 3 for both.
    (id0, fp, line) is the later line, (a_id0, a_fp, a_line) the earlier one, null if their sets are equal: nothing
    is left to verify then. Given ``most``, only so many of the nearest are told, and ``more`` says that there were others.
    """

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(parts)
        if not batches:
            return
        name = np.concatenate([b.column(0).to_numpy() for b in batches]).view(np.uint64)
        tag = np.concatenate([b.column(1).to_numpy() for b in batches])
        data = np.concatenate([unpacked(b.column(2), LINE) for b in batches])
        order = np.argsort(name)
        alone = np.r_[True, name[order][1:] != name[order][:-1]]
        order = order[~(alone & np.r_[alone[1:], True])]  # blocks of one row
        name, tag, x = name[order], tag[order], data[order]
        order = np.lexsort((x["line"], x["fp"], x["id0"], name))
        name, tag, x = name[order], tag[order], x[order]
        no = np.cumsum(np.r_[True, (x["line"][1:] != x["line"][:-1]) | (x["fp"][1:] != x["fp"][:-1]) | (x["id0"][1:] != x["id0"][:-1])][: len(x)])
        # rows with the set of an earlier, indexed row of the block
        sets = W.mix(name ^ set_name(x))
        by_set = np.argsort(sets, kind="stable")
        held = np.where(tag & 1 > 0, no, len(x) + 1)[by_set]
        begin = np.flatnonzero(np.r_[True, sets[by_set][1:] != sets[by_set][:-1]][: len(x)])
        equal = np.zeros(len(x), bool)
        if len(x):
            equal[by_set] = no[by_set] > np.repeat(np.minimum.reduceat(held, begin), np.diff(np.r_[begin, len(x)]))
        twins = x[equal & (tag & 2 > 0)]
        name, tag, x, no = name[~equal], tag[~equal], x[~equal], no[~equal]
        more, pairs = np.zeros(len(x), bool), [np.zeros((3, 0), np.int64)]
        for pair in candidates(x, tag.astype(np.int64) >> 2, name, no, tag & 3, percent):
            pairs.append(np.array(pair))
            if most is not None and sum(p.shape[1] for p in pairs) > _HELD:
                pairs = [np.array(nearest(*np.concatenate(pairs, axis=1), most, more))]
        a, b, apart = np.concatenate(pairs, axis=1)
        if most is not None:
            a, b, apart = nearest(a, b, apart, most, more)
        columns = {c: pa.array(np.r_[twins[c], x[c][b]]) for c in PLACE}
        columns |= {f"a_{c}": pa.concat_arrays([pa.nulls(len(twins), columns[c].type), pa.array(x[c][a])]) for c in PLACE}
        out = pa.table(columns | {"more": pa.array(np.r_[np.zeros(len(twins), bool), more[b]])})
        yield from out.to_batches(max_chunksize=100_000)

    return entries.repartition(partitions_for(about, _TASK_ROWS), "block").mapInArrow(meet, "id0 long, fp long, line int, a_id0 long, a_fp long, a_line int, more boolean")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id0, fp, line, tokens) of the ``wanted`` places, read again from their texts."""
    lists = wanted.groupBy("id0", "fp").agg(F.collect_set("line").alias("lines"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wanted_ = [np.array(x, np.int64) for x in combined(part, "lines").to_pylist()]
            ids, fps = combined(part, "id0").to_numpy(), combined(part, "fp").to_numpy()
            for lo, hi, data, offsets in text_slices(combined(part, "text")):
                s = LineSets(data, offsets, only=np.concatenate([np.int64(d) << 32 | x for d, x in enumerate(wanted_[lo:hi])]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.doc + lo]), pa.array(fps[s.doc + lo]), pa.array(s.line.astype(np.int32)), list_array(s.token.view(np.int64), s.n, pa.int64())], names=[*PLACE, "tokens"])

    joined = attach(rows.select("id0", "fp", "text"), lists, "inner")
    return joined.mapInArrow(read, "id0 long, fp long, line int, tokens array<long>")


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(id0, fp, line): the later lines of the pairs that are similar on their full sets."""
    earlier = [F.col(f"a_{k}").alias(k) for k in PLACE]
    sets = staged(sets_of(rows, pairs.select(*PLACE).unionByName(pairs.select(*earlier))), "sets", True)
    x = sets.select(*(F.col(k).alias(f"a_{k}") for k in PLACE), F.col("tokens").alias("x"))
    near = pairs.select(*PLACE, *(f"a_{k}" for k in PLACE)).join(x.hint("merge"), [f"a_{k}" for k in PLACE]).join(sets.hint("merge"), list(PLACE))

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in (part.slice(i, 2000) for i in range(0, part.num_rows, 2000)):
                lists = [combined(batch, c) for c in ("x", "tokens")]
                sizes = [np.diff(c.offsets.to_numpy()).astype(np.int64) for c in lists]
                owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
                token = np.concatenate([c.flatten().to_numpy() for c in lists])
                order = np.argsort(token)
                order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
                token, owner = token[order], owner[order]
                both = np.bincount(owner[1:][(token[1:] == token[:-1]) & (owner[1:] == owner[:-1])], minlength=batch.num_rows)  # a set holds a token once
                yield batch.select(list(PLACE)).filter(pa.array(100 * both >= percent * (sizes[0] + sizes[1] - both)))

    hits = staged(near.select(*PLACE, "x", "tokens").mapInArrow(check, "id0 long, fp long, line int").distinct(), "hits")
    discard(sets)
    return hits


def _both(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, pos, data): the entries of rare tokens, and those of common ones."""
    rare = lines.select("data", "skipped", F.posexplode("prefix").alias("at", "token"))
    common = lines.filter(F.size("common") > 0).select("data", (F.col("skipped") + F.size("prefix")).alias("skipped"), F.posexplode("common").alias("at", "token"))
    rare, common = (x.select("token", (F.col("skipped") + F.col("at")).alias("pos"), "data") for x in (rare, common))
    return rare, common


def asked_slots(asking: DataFrame) -> Broadcast:
    """Which hash slots the tokens of ``asking`` have: a table of SLOTS bytes."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield by_chunk(slots_of(combined(part, "token").to_numpy().view(np.uint64)))

    return asking.sparkSession.sparkContext.broadcast(gathered(asking.select("token").mapInArrow(count, "chunk int, slot binary, n binary")))


def asked_for(lines: DataFrame, slots: Broadcast) -> DataFrame:
    """The entries of all ``lines`` with a token of one of the ``slots``."""

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = slots.value
        for part in parts:
            before, data = combined(part, "skipped").to_numpy().astype(np.int64), unpacked(combined(part, "data"), LINE)
            for name in ("prefix", "common"):
                lists = combined(part, name)
                counts = np.diff(lists.offsets.to_numpy())
                token = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), counts)
                at = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts) + before[owner]
                ok = wanted[slots_of(token.view(np.uint64))] > 0
                yield pa.RecordBatch.from_arrays([pa.array(token[ok]), pa.array(at[ok].astype(np.int32)), packed(data[owner[ok]])], names=["token", "pos", "data"])
                before = before + counts

    return lines.select("skipped", "data", "prefix", "common").mapInArrow(pick, "token long, pos int, data binary")


def _in_each(rows: DataFrame, name: str, count: str) -> DataFrame:
    """Rows once for each number under ``count`` in the column ``name``; only of those with several the rows multiply."""
    several = rows.filter(F.col(count) > 1).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    return rows.filter(F.col(count) == 1).unionByName(several)


def matched(lines: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(id0, fp, line) of the lines of which an earlier one is similar. ``lines``: see ``line_rows``."""
    place, about = list(PLACE), lines.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rare, common = _both(lines)
    crowded = common.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > MOST_ROWS)
    crowded = staged(crowded.select("token", F.ceil(F.col("size") / MOST_ROWS).cast("int").alias("parts")), "crowded")
    own = F.pmod(F.xxhash64("data"), F.coalesce("parts", F.lit(1))).cast("int")
    both = (F.col("pos") * 4 + 3).alias("tag")
    common = common.join(crowded.hint("merge"), "token", "left")
    block = F.when(F.col("parts").isNull(), F.col("token")).otherwise(F.xxhash64("token", own, F.lit(0)))
    seen = staged(met(rare.select(F.col("token").alias("block"), both, "data").unionByName(common.select(block.alias("block"), both, "data")), about, percent, MOST_CANDIDATES), "seen", True)
    same = seen.filter("a_line IS NULL").select(*place).distinct()
    pairs = seen.filter("a_line IS NOT NULL").groupBy(*place, "a_id0", "a_fp", "a_line").agg(F.max("more").alias("more")).join(same.hint("merge"), place, "left_anti")
    pairs = staged(pairs, "pairs")
    found = staged(same.unionByName(verified(pairs, rows, percent)), "found")
    # not settled: lines that had more candidates, and those that haven't met all the lines of a token
    split = lines.filter(F.size("common") > 0).select(*place, F.explode("common").alias("token")).join(crowded.hint("merge"), "token", "left_semi")
    rest = staged(pairs.filter("more").select(*place).unionByName(split.select(*place)).distinct().join(found.hint("merge"), place, "left_anti"), "rest")
    discard(seen, pairs)
    if not rest.take(1):
        return found
    rare, common = _both(lines.join(rest.hint("merge"), place, "left_semi"))
    asking = staged(rare.unionByName(common), "asking")
    shares = asking.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / MOST_ROWS).cast("int").alias("shares")).join(crowded.hint("merge"), "token", "left")
    shares = staged(shares.select("token", "shares", F.coalesce("parts", F.lit(1)).alias("parts")), "shares")
    # a block holds a chunk of a token's lines and a share of those that ask
    slots = asked_slots(asking)
    held = asked_for(lines, slots).join(shares.hint("merge"), "token").withColumns({"c": own, "p": F.lit(0), "role": F.lit(1)})
    asks = asking.join(shares.hint("merge"), "token").withColumns({"c": F.lit(0), "p": F.pmod(F.xxhash64("data", F.lit(1)), F.col("shares")).cast("int"), "role": F.lit(2)})
    held, asks = _in_each(held, "p", "shares"), _in_each(asks, "c", "parts")
    blocks = held.unionByName(asks).select(F.xxhash64("token", "c", "p").alias("block"), (F.col("pos") * 4 + F.col("role")).alias("tag"), "data")
    blocks = staged(blocks, "blocks", True)
    slots.destroy()
    seen = staged(met(blocks, blocks.count(), percent, None), "others", True)
    discard(blocks)
    pairs = staged(seen.filter("a_line IS NOT NULL").drop("more").distinct(), "pairs")
    return found.unionByName(seen.filter("a_line IS NULL").select(*place)).unionByName(verified(pairs, rows, percent)).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, extra: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, n_lines, removed (numbers of the removed lines, from 0), kept (the other lines).

    The lines of a text are its parts between \\n. Their sets have the distinct words ``[^\\x20\\x09-\\x0D]+``,
    unchanged. A line goes if its set's intersection with that of any earlier line (smaller id, or earlier in the
    document) is at least ``percent`` hundredths of the union; judged on the input. Lines without words stay and
    match nothing. Null is the empty text: one line without words. Rows that repeat an id and its text count as one
    document, with equal results; of rows with one id and different texts the one with the smaller hash is earlier; a
    null id sorts first. Ids are whole numbers. Of the input only the two named columns are read, and ``extra`` ones,
    of any names but the result's own, which are passed on.
    """
    rows = keyed(docs.withColumn("extra", F.struct(F.lit(0).alias("none"), *extra)), id_col, text_col, ["extra"])
    out = attach(rows, removed_lines(rows, percent))
    gone = F.sort_array(F.coalesce("gone", F.array().cast("array<int>")))
    return out.select("id", line_count(F.col("text")).alias("n_lines"), gone.alias("removed"), without_lines(F.col("text"), F.col("gone")).alias("kept"), *(F.col("extra")[c].alias(c) for c in extra))


def line_count(text: F.Column) -> F.Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def without_lines(text: F.Column, gone: F.Column) -> F.Column:
    """``text`` without the lines of these numbers (null: all stay)."""
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def removed_lines(rows: DataFrame, percent: int = 80) -> DataFrame:
    """(id0, fp, gone array<int>) of the documents (see ``keyed``) that lose lines."""
    rows = rows.select("id0", "fp", "text")
    counts = rows.sparkSession.sparkContext.broadcast(rarity(rows))
    lines = staged(line_rows(rows, counts, percent), "lines", True)
    counts.destroy()
    gone = lines.filter("again").select(*PLACE).unionByName(matched(lines.filter("m > 0"), rows, percent))
    out = staged(gone.groupBy("id0", "fp").agg(F.collect_set("line").alias("gone")), "removed")
    discard(lines)
    return out
