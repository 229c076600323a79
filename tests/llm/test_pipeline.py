"""The stages against brute-force versions of their rules, on the smallest tables and on awkward ones."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
STAGE = dict(corpus_pipeline.STAGES)


def gone_lines(rows):
    """(id, line) of the lines that an earlier one matches; ``rows``: (id, text) by id."""
    lines = [(i, k, frozenset(re.findall(WORD, x))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    return {(i, k) for n, (i, k, y) in enumerate(lines) if y and any(x and 100 * len(x & y) >= 80 * len(x | y) for _, _, x in lines[:n])}


def near_kept(rows):
    """Ids that stay: the smallest of each group that links of 0.8 or more connect."""
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    name = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((name[i], name[j]))
            name = {k: a if v == b else v for k, v in name.items()}
    return {i for i in name if name[i] == i}


def clean(rows, items):
    """Ids of the documents of which less than one word in twenty is in an occurrence of a window of 13 words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for v in map(words, items):
        n = min(13, len(v))
        windows[n] |= {tuple(v[a : a + n]) for a in range(len(v) - n + 1 if n else 0)}
    out = set()
    for i, t in rows:
        w, hit = words(t), set()
        for n, known in windows.items():
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in known:
                    hit |= set(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == names and kept[-1].schema == docs.schema
        assert kept[-1].count() > 0
    rows = [[(r.doc_id, r.text) for r in k.orderBy("doc_id").collect()] for k in kept]
    ids = [{i for i, _ in x} for x in rows]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in ids[0]]
    bad = [i for i, q in labels.items() if q == 0 and i in ids[0]]
    assert sum(i in ids[1] for i in good) >= 0.95 * len(good) and sum(i in ids[1] for i in bad) <= 0.3 * len(bad)
    gone, old = gone_lines(rows[1]), dict(rows[1])
    for i, new in rows[2]:
        assert (new or "") == "\n".join(x for k, x in enumerate((old[i] or "").split("\n")) if (i, k) not in gone)
    assert all(any(g == i for g, _ in gone) for i in ids[1] - ids[2])
    assert ids[3] == near_kept(rows[2])
    assert ids[4] == clean(rows[3], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    out = STAGE["packing"](spark, kept[-1], SF).collect()
    length = {i: len(re.findall(WORD, t or "")) for i, t in rows[4]}
    assert {r.doc_id: r.n_tokens for r in out} == length and len(out) == len(rows[4])
    batches = collections.defaultdict(list)
    for r in out:
        batches[r.bucket, r.batch].append(r)
    assert all(len(b) == 1 or len(b) * b[0].padded <= 16_384 for b in batches.values())
    bounds = sorted({r.padded for r in out if r.padded <= 16_384})
    assert len(bounds) <= 12 and all(r.padded == min(b for b in bounds if b >= r.n_tokens) for r in out if r.n_tokens <= 16_384)


NAMES = "kept string, gone int, id0 int, fp int, id string, whole int, extra int, score double, _score double, _hit int, _items int, _n_words int, lines int, component int, key int, other1 int, n_tokens int, place int, bin int, n_chars long"


def awkward(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in NAMES.split(", "):
        name, kind = c.split(" ")
        docs = docs.withColumn(name, F.lit(7).cast(kind))
    return docs


ROWS = [(1, "one two three four five six\nseven eight nine ten"), (2, None), (3, ""), (4, "one two three four five six\nnew line of words here"), (4, "one two three four five six\nnew line of words here"), (5, "one two three four five six"), (6, " \n\t\n"), (7, "w " * 30_000), (8, "alpha beta gamma delta epsilon zeta eta theta"), (9, "alpha beta gamma delta epsilon zeta eta theta")]


@pytest.mark.parametrize("name", list(STAGE))
def test_clashing_names_nulls_repeats_and_empty_tables(spark, name):
    docs = awkward(spark, ROWS)
    out = STAGE[name](spark, docs, SF)
    rows = out.collect()
    assert STAGE[name](spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in ROWS)
        return
    assert out.columns == docs.columns and all(r.kept == "7" and r._hit == 7 and r.key == 7 and r.whole == 7 for r in rows)
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "line_dedup":
        assert ids == collections.Counter([1, 2, 3, 4, 4, 6, 7, 8])
        assert {r.text for r in rows if r.doc_id == 4} == {"new line of words here"} and {r.n_chars for r in rows if r.doc_id == 4} == {22}
        assert [(r.text, r.n_chars) for r in rows if r.doc_id == 2] == [(None, 7)]
    if name == "minhash_near_dedup":
        assert ids == collections.Counter([1, 2, 3, 4, 4, 5, 6, 7, 8])
    if name == "benchmark_decontamination":
        assert ids == collections.Counter(i for i, _ in ROWS)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
