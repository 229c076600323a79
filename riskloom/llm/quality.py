"""Quality classifier: support vectors over naive-Bayes-scaled n-gram indicators.

Features are indicators of byte 3-grams and 4-grams and of word 1-grams and 2-grams, hashed to ``2 ** HASH_BITS``
columns. Each is scaled by its class log-count ratio, the vector is brought to length one, and a linear hinge-loss
model is fitted by dual coordinate descent. A logistic curve fitted on rows kept from that fit maps margins to 0..1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import combined, list_array, text_slices

HASH_BITS = 18
#: The fit uses at most so many labelled rows, half of each class, chosen by a hash of their ids, and of these the first
#: that together have so many bytes of text (half of each class again, one text at least).
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 64 << 20
#: Tasks that read the features of the sample: results of about a megabyte, not a few large ones.
SAMPLE_TASKS = 64
EPOCHS = 12
COST = 1.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out (and never labelled)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    down = np.uint64(64 - HASH_BITS)
    with np.errstate(over="ignore"):
        b = data.astype(np.uint64)
        three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16) if len(b) > 2 else b[:0]
        four = three[:-1] | b[3:] << np.uint64(24) if len(b) > 3 else b[:0]
        three = (W.mix(three + np.uint64(1 << 40)) >> down).astype(np.int32)
        four = (W.mix(four + np.uint64(1 << 41)) >> down).astype(np.int32)
        w = W.Words(data, offsets)
        one = (W.mix(w.hash + np.uint64(1)) >> down).astype(np.int32)
        two = (W.windows(w.hash, 2) >> down).astype(np.int32)
        twice = w.hash[1:] == w.hash[:-1]  # any word twice in a row is one more feature
        two[twice] = 1
    flags = np.zeros(1 << HASH_BITS, bool)
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        a, z = int(w.first[i]), int(w.first[i + 1])
        flags[three[lo : max(lo, hi - 2)]] = True
        flags[four[lo : max(lo, hi - 3)]] = True
        flags[one[a:z]] = True
        flags[two[a : max(a, z - 1)]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found.astype(np.int32)


@dataclass
class Model:
    """``weight``: hinge-loss weights times log-count ratios; ``ratio``: the ratios, for the length of a vector."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float | None = None

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        length = math.sqrt(float(r @ r)) or 1.0
        return float(self.weight[found].sum()) / length + self.bias

    def score(self, found: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        z = self.slope * self.margin(found) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, ones: float | None = None) -> Model:
    """``labels``: 0 or 1. ``ones``: the share of label 1 where the scores are to hold, if the rows' own share differs.

    Each class needs two rows, one to fit and one to set the slope by; else every score is the share of ones (one half
    without any rows).
    """
    size = 1 << HASH_BITS
    if np.bincount(labels, minlength=2).min() < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0, float(labels.mean()) if len(rows) else 0.5)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    kept, train = order[::5], np.setdiff1d(order, order[::5])
    if len(set(labels[train].tolist())) < 2 or len(set(labels[kept].tolist())) < 2:
        kept = train = order
    counts = np.zeros((2, size))
    for i in train:
        counts[labels[i], rows[i]] += 1
    part = np.bincount(labels[train], minlength=2)[:, None] / len(train)
    counts = (counts + part) / part  # smoothed in proportion to the classes: a feature that was never seen has ratio 0
    ratio = np.log(counts[1] / counts[0])
    y = np.where(labels == 1, 1.0, -1.0)
    length = {i: math.sqrt(float(ratio[rows[i]] @ ratio[rows[i]])) or 1.0 for i in train.tolist()}
    share = labels[train].mean()
    most = {1.0: cost * 0.5 / share, -1.0: cost * 0.5 / (1 - share)}  # both classes weigh the same
    w, bias, alpha = np.zeros(size), 0.0, dict.fromkeys(train.tolist(), 0.0)
    for _ in range(epochs):
        for i in rng.permutation(train).tolist():
            x = ratio[rows[i]] / length[i]  # made anew each time: all vectors at once would take twice the memory of the rows
            g = y[i] * (float(w[rows[i]] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / 2.0, 0.0), most[y[i]])  # the vector has length one, the bias one more
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    model = Model(ratio, w * ratio, bias, 1.0, 0.0)
    model.slope, model.shift = _logistic(np.array([model.margin(rows[i]) for i in kept]), labels[kept], labels[kept].mean() if ones is None else ones)
    return model


def _logistic(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the targets drawn in a little so that separable rows have an optimum."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    t = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(labels == 1, share / (ones / len(labels)), (1 - share) / (zeros / len(labels)))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        v, d = weight * p * (1 - p) + 1e-9, weight * (p - t)
        h = np.array([[v @ (margins**2) + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([d @ margins, d.sum()]))
        size = min(1.0, 5.0 / (float(np.abs(step).max()) + 1e-12))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most ``sample_rows`` labelled rows that are not held out; null and contradicting labels don't count.

    Of rows that repeat an id the text with the smallest hash counts. The order of rows makes no difference.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other").filter(~held_out(F.col("id")))
    shares = dict(marks.groupBy("label").count().collect())
    chosen = None
    for k in (0, 1):
        part = marks.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # lengths first: the bound on bytes applies before any text is moved
    lengths = texts.select("id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("n", "h").alias("n"), F.min("h").alias("h"))
    running = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")) - F.col("n")
    picked = lengths.withColumn("before", running).filter(F.col("before") < sample_bytes // 2).select("id", "label", "h")
    rows = texts.join(F.broadcast(picked), "id").filter(F.xxhash64("text") == F.col("h")).groupBy("id", "label").agg(F.min("text").alias("text")).repartition(SAMPLE_TASKS, "id")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, data, offsets in text_slices(combined(part, "text")):
                found = list(features(data, offsets))
                yield pa.RecordBatch.from_arrays([combined(part, "id").slice(lo, hi - lo), combined(part, "label").slice(lo, hi - lo), list_array(np.concatenate(found), np.array([len(f) for f in found]), pa.int32())], names=["id", "label", "found"])

    table = rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, label int, found array<int>").toArrow()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in table.column("found").chunks]  # views, not copies
    found = [flat[a:z] for flat, at in lists for a, z in zip(at[:-1], at[1:], strict=True)]
    marks_ = table.column("label").to_numpy()
    return fit([found[i] for i in order], np.asarray(marks_)[order].astype(np.int64), ones=shares.get(1, 0) / max(1, sum(shares.values())))


def classify(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and ``score_col``: the probability of label 1, from the whole text alone.

    A null or empty text has no features and gets what the bias gives. An old
    ``score_col`` is replaced. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    names = docs.columns

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            scores = [m.score(f) for _, _, data, offsets in text_slices(combined(part, text_col)) for f in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(score, schema)
