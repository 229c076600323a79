"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import anchors, decontaminate, exact_dedup, line_dedup, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts, url_filter
from riskloom.llm.components import components

#: Columns with names that operators use themselves.
EXTRA = "kept string, id string, spans int, anchor int, key int, component int, score string, bin int, lines int, gone int, n int"


def corpus(seed=1, n=60):
    """Texts of few words, with copies, near copies, shared passages, one very long text, odd ones and nulls."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ñu,", "A", "b."]
    make = lambda k: " ".join(r.choice(words) + ("\n" if r.random() < 0.1 else "") for _ in range(k))
    passage, out = make(60), []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            out.append(r.choice(out))
        elif kind < 0.5 and out:
            t = (r.choice(out) or "x").split(" ")
            for _ in range(r.randint(1, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        elif kind < 0.7:
            out.append(make(r.randint(0, 30)) + " " + passage + " " + make(r.randint(0, 30)))
        else:
            out.append(make(r.randint(0, 120)))
    out += [None, "", " \n\t ", "a " * 300, "one", make(5000), "x" * 5000, "same line\nsame line\n\nsame line"]
    return list(enumerate(out))


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA.split(", ") if extra else ():
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


def empty(spark):
    return frame(spark, [])


# --- 1 ----------------------------------------------------------------------------------------------------------


def brute_decontamination(docs, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[a : a + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    docs = [(i, t) for i, t in corpus(2, 25)]
    texts = [t for _, t in docs if t and 20 < len(t.split()) < 200]
    items = [(j, " ".join(t.split()[3 : 3 + k])) for j, (t, k) in enumerate(zip(texts, (1, 2, 5, 12, 13, 14, 30), strict=False))] + [(50, None), (51, ""), (52, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, docs), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r._n_words, r._hit, r._items) for r in got} == brute_decontamination(docs, items, 13)
    assert got[0].kept == "7"
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert all(not r._hit for r in decontaminate.decontaminate(frame(spark, docs), bench.limit(0)).collect())


def test_overlapping_patterns():
    sets = decontaminate.pattern_sets([("a", "x x x"), ("b", "x y")], 2)
    assert sorted((at, p) for s in sets for at, p in s.find([b"x", b"x", b"x", b"y"])) == [(0, (b"x", b"x")), (1, (b"x", b"x")), (2, (b"x", b"y"))]


# --- 2 ----------------------------------------------------------------------------------------------------------


def brute_lines(docs, percent):
    lines = [(i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))) for i, t in sorted(docs, key=lambda x: x[0]) for k, line in enumerate((t or "").split("\n"))]
    gone = collections.defaultdict(list)
    for b, (i, k, y) in enumerate(lines):
        if y and any(x and 100 * len(x & y) >= percent * len(x | y) for _, _, x in lines[:b]):
            gone[i].append(k)
    return gone


@pytest.mark.parametrize("few", [8, 2, 1])
def test_line_dedup(spark, monkeypatch, few):
    """With ``few`` = 1 and 2, lines meet in chunks and in both rounds."""
    monkeypatch.setattr(line_dedup, "MOST_CANDIDATES", few)
    monkeypatch.setattr(line_dedup, "_HELD", 1 << 20 if few == 8 else 5)
    monkeypatch.setattr(line_dedup, "MOST_ROWS", 4096 if few == 8 else few)
    monkeypatch.setattr(line_dedup, "_STEPS", 256 if few == 8 else 2)
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(r.sample(words, r.randint(1, 12))) for _ in range(12)]
    change = lambda t: " ".join(w if r.random() < 0.9 else r.choice(words) for w in t.split(" "))
    docs = [(i, "\n".join(change(r.choice(base)) for _ in range(r.randint(1, 4)))) for i in range(40)] + [(100, None), (101, ""), (102, " \n\n"), (103, base[0] + "\n" + base[0])]
    got = {x.id: x for x in line_dedup.line_dedup(frame(spark, docs, False).withColumn("lang", F.lit("en")), extra=["lang"]).collect()}
    want = brute_lines(docs, 80)
    for i, t in docs:
        kept = [line for k, line in enumerate((t or "").split("\n")) if k not in want[i]]
        assert (got[i].removed, got[i].kept, got[i].n_lines, got[i].lang) == (want[i], "\n".join(kept), len((t or "").split("\n")), "en")
    assert line_dedup.line_dedup(empty(spark).select("doc_id", "text")).count() == 0
    again = line_dedup.line_dedup(frame(spark, [(1, "a b c d"), (1, "a b c d")], False)).collect()
    assert [x.removed for x in again] == [[], []]


# --- 3 ----------------------------------------------------------------------------------------------------------


def brute_components(docs, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = name[i], name[j]
                name = {k: min(a, b) if v in (a, b) else v for k, v in name.items()}
    return {i: (len(s), name[i]) for i, s in sets.items()}


@pytest.mark.parametrize("most", [4096, 3])
def test_near_dedup(spark, most):
    r = random.Random(9)
    base = [f"t{i}" for i in range(80)]
    family = []
    for i in range(40):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(80)] = f"e{i}"
        family.append((200 + i, " ".join(t)))
    docs = corpus(5) + family + [(300, "A b"), (301, "a B"), (302, "a b c")]
    got = {x.id: (x.n_shingles, x.component) for x in near_dedup.near_dedup(frame(spark, docs), most_rows=most).collect()}
    assert got == brute_components(docs, 85)
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    lone = near_dedup.near_dedup(frame(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c")])).collect()
    assert sorted((x.id or 0, x.component or 0, x.kept) for x in lone) == [(0, 0, True), (4, 4, True), (4, 4, True)]


@pytest.mark.parametrize("few", [0, 24, 10**6])
def test_links_within_a_group(monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    r = random.Random(3)
    texts = []
    for _ in range(3):
        base = [f"t{r.randrange(10**6)}" for _ in range(90)]
        texts += [" ".join(w if r.random() < 0.97 else "other" for w in base) for _ in range(14)]
    sets = near_dedup.shingle_sets(np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    found = near_dedup.links_of(texts, near_dedup.packed(near_dedup.minima(sets)), 85)
    name = list(range(len(texts)))
    for a, b in found:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        name = [min(name[a], name[b]) if x in (name[a], name[b]) else x for x in name]
    assert {i: (len(x), name[i]) for i, x in enumerate(sets)} == brute_components(list(enumerate(texts)), 85)


def test_estimate_is_unbiased():
    r = np.random.default_rng(1)
    truth, seen = [], []
    for share in (0.3, 0.6, 0.9):
        for _ in range(40):
            both, own = r.integers(0, 1 << 62, int(400 * share), dtype=np.uint64), r.integers(0, 1 << 62, (2, int(200 * (1 - share))), dtype=np.uint64)
            sig = near_dedup.packed(near_dedup.minima([np.r_[both, own[0]], np.r_[both, own[1]]]))
            truth.append(len(both) / (len(both) + own.size))
            seen.append(near_dedup.similarity(sig[0], sig[1:])[0])
    assert abs(np.mean(np.array(seen) - truth)) < 0.01


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    name = {}
    for a, b in edges:
        x, y = name.setdefault(a, a), name.setdefault(b, b)
        name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in name.items() if k in got} and {k for k in name if name[k] != k} <= set(got)


# --- 4 ----------------------------------------------------------------------------------------------------------


def brute_bytes(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    n = collections.Counter(t[j : j + length] for t in raw for j in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if n[t[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("most", "shard"), [(4000, 1 << 17), (4000, 600), (2, 1 << 17)])
def test_suffix_dedup(spark, most, shard):
    docs = corpus(6)
    got = {x.id: x for x in suffix_dedup.suffix_dedup(frame(spark, docs), length=100, most_variants=most, shard_bytes=shard, bucket_bytes=4000).collect()}
    for (i, _), want in zip(docs, brute_bytes(docs, 100), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == want
        assert sum(n for _, n in got[i].spans) == got[i].n_removed
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    twice = suffix_dedup.suffix_dedup(frame(spark, [(1, "q" * 150), (1, "r" + "s" * 99), (1, "r" + "s" * 99)]), length=100).collect()
    assert sorted(x.n_removed for x in twice) == [100, 100, 150]


def test_merged_transforms_equal_sorting():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(8, 60))) for _ in range(30)]
    for width, shard in ((1, 40), (2, 200), (4, 1)):
        flags = suffix_dedup.repeated_starts(texts, 8, width, shard)
        n = collections.Counter(t[j : j + 8] for t in texts for j in range(len(t) - 7))
        want = [n[t[j : j + 8]] > 1 if j + 8 <= len(t) else False for t in texts for j in range(len(t) + 1)]
        assert flags.tolist() == want


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_quality(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice("the of and river stone house walks under quiet".split()) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(r.choice("win $$$ click free!!! %% now".split()) for _ in range(r.randint(5, 60)))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(400, None), (401, ""), (402, "x" * 100_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    out = quality.classify(docs, quality.train(docs, labels)).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    held = [x for x in out if x.out and x.doc_id < 400]
    assert len(held) > 50 and np.mean([(x.score >= 0.7) == (x.doc_id % 2 == 1) for x in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in out) and len(out) == len(rows) and out[0].kept == "7"
    none = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty(spark), none).count() == 0


def test_ratios_and_fit_against_a_plain_solver():
    """Log-count ratios by counting, and the dual's optimum by many plain passes without a random order."""
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 30, 6) + (8 if i % 2 else 0)).astype(np.int32) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    model = quality.fit(rows, labels, epochs=400)
    order = np.random.default_rng(5).permutation(60)
    train = np.setdiff1d(order, order[::5])
    part = [np.mean(labels[train] == k) for k in (0, 1)]
    count = [[sum(f in rows[i] for i in train if labels[i] == k) for f in range(38)] for k in (0, 1)]
    ratio = np.array([np.log((count[1][f] / part[1] + 1) / (count[0][f] / part[0] + 1)) for f in range(38)])
    assert np.allclose(model.ratio[:38], ratio) and not model.ratio[38:].any()
    x = np.zeros((len(train), 39))
    for j, i in enumerate(train):
        x[j, rows[i]] = ratio[rows[i]] / np.linalg.norm(ratio[rows[i]])
        x[j, 38] = 1
    y, alpha = np.where(labels[train] == 1, 1.0, -1.0), np.zeros(len(train))
    most = np.where(labels[train] == 1, 0.5 / labels[train].mean(), 0.5 / (1 - labels[train].mean()))
    w = np.zeros(39)
    for _ in range(2000):
        for j in range(len(train)):
            new = min(max(alpha[j] - (y[j] * (x[j] @ w) - 1) / 2, 0), most[j])
            w, alpha[j] = w + (new - alpha[j]) * y[j] * x[j], new
    assert np.allclose(model.weight[:38], w[:38] * ratio, atol=1e-3) and abs(model.bias - w[38]) < 1e-3


def test_quality_sample(spark):
    """Repeated rows and the order of rows make no difference, and texts beyond the bound aren't fetched."""
    rows = [(i, ("good stone " if i % 2 else "bad $$$ ") * (5 + i % 7)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    one, two = (quality.train(d, labels) for d in (frame(spark, rows), frame(spark, rows[::-1] + rows[:9])))
    assert np.array_equal(one.weight, two.weight) and one.bias == two.bias
    assert quality.train(frame(spark, rows), labels, sample_bytes=2).prior == 0.5


# --- 6 ----------------------------------------------------------------------------------------------------------


def test_best_boundaries():
    import itertools

    r = random.Random(1)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 9)))
        counts = [r.randint(1, 9) for _ in lengths]
        totals = [n * c for n, c in zip(lengths, counts, strict=True)]
        k = r.randint(1, 4)

        def waste(bounds, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(waste((*inner, lengths[-1])) for m in range(k) for inner in itertools.combinations(lengths[:-1], m))
        got = packing.boundaries(np.array(lengths), np.array(counts), np.array(totals), k)
        assert len(got) <= k and waste(got) == best


def test_pack(spark):
    docs = corpus(3) + [(70_000 + i, "a b c") for i in range(50)] + [(None, "z"), (None, "z")]
    rows = packing.pack(frame(spark, docs), buckets=4, budget=100).collect()
    assert len(rows) == len(docs)
    by = collections.defaultdict(list)
    for x in rows:
        assert x.n_tokens <= x.padded
        by[x.bucket, x.batch].append(x)
    for (bucket, batch), xs in by.items():
        assert len(xs) == 1 or len(xs) * xs[0].padded <= 100
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
        if (bucket, batch + 1) in by:
            assert len(xs) == max(1, 100 // max(1, xs[0].padded))
    named = packing.pack(spark.createDataFrame([("a", "x y"), ("b", "x"), ("b", "x"), (None, "x"), (None, "x")], "doc_id string, text string"), budget=4).collect()
    assert sorted((x.id or "", x.n_tokens, x.padded) for x in named) == [("", 1, 1), ("", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 1)]
    assert sorted((x.bucket, x.batch, x.slot) for x in named) == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 0, 3), (1, 0, 0)]
    first, second = ({tuple(x) for x in packing.pack(frame(spark, docs[:-2]).repartition(k), buckets=4, budget=100).collect()} for k in (1, 5))
    assert first == second
    coarse = packing.pack(frame(spark, docs), buckets=4, budget=100, bins=8).collect()
    assert len(coarse) == len(docs) and all(x.n_tokens <= x.padded for x in coarse)
    assert packing.pack(empty(spark)).count() == 0


def test_pack_with_outliers(spark):
    import itertools

    r = random.Random(6)
    short = [(i, r.randint(0, 30)) for i in range(300)]
    long = [(1000, 10_000_000), (1001, 20_000), (1002, 20_000)]
    pack = lambda rows: {x.id: x for x in packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), tokens=F.col("n"), buckets=3).collect()}
    got, alone = pack(short + long), pack(short)
    assert all(got[i] == alone[i] for i, _ in short) and len(got) == len(short) + len(long)
    distinct = sorted({n for _, n in short})
    waste = lambda bounds: sum(min(b for b in bounds if b >= n) - n for _, n in short)
    best = min(waste((*inner, distinct[-1])) for m in range(3) for inner in itertools.combinations(distinct[:-1], m))
    assert sum(got[i].padded - n for i, n in short) == best
    assert all(got[i].padded == n and got[i].slot == 0 for i, n in long)
    assert len({(got[i].bucket, got[i].batch) for i, _ in long}) == 3 and not {got[i].bucket for i, _ in long} & {got[i].bucket for i, _ in short}
    assert [(x.bucket, x.padded, x.slot) for x in pack(long[:1]).values()] == [(0, 10_000_000, 0)]


# --- 7 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["start", "majority", "fraction"])
def test_token_counts(spark, rule):
    docs = corpus(4, 20)
    out = token_counts.token_counts(frame(spark, docs), ["kept", "text"], sections_of="text", rule=rule).collect()
    by = collections.defaultdict(list)
    for x in out:
        by[x.id].append(x)
    encode, size_of = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    for i, t in docs:
        ids = encode("7\n" + (t or ""))
        assert abs(sum(x.n_tokens for x in by[i]) - len(ids)) < 1e-9 and {x.total for x in by[i]} == {len(ids)}
        assert sum(x.n_bytes for x in by[i]) == len(("7\n" + (t or "")).encode()) == size_of[ids].sum()
        assert len(by[i]) == 1 + (t or "").count("\n") + 1
    assert token_counts.token_counts(empty(spark), ["text"]).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_token_counts_of_sections(spark, rule):
    """Token by token, byte by byte."""
    import tiktoken.load

    docs = [(1, "Überlänge naïve\nzwei  drei\n\n  vier"), (2, None), (3, ""), (None, "a\nb"), (3, "a\nb" * 50)]
    ranks = tiktoken.load.load_tiktoken_bpe(token_counts.VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs:
        text = "7\n" + (t or "")
        owner = [0] * 2 + [1 + k for k, line in enumerate((t or "").split("\n")) for _ in line.encode() + b"\n"]
        n, at = collections.Counter(), 0
        for token in encoding.encode_ordinary(text):
            mine = owner[at : at + len(encoding.decode_single_token_bytes(token))]
            n[mine[0] if rule == "start" else max(sorted(set(mine)), key=mine.count)] += 1
            at += len(mine)
        want += [(i, *(("kept", 0) if s == 0 else ("text", s - 1)), n[s]) for s in range(2 + (t or "").count("\n"))]
    got = token_counts.token_counts(frame(spark, docs), ["kept", "text"], sections_of="text", rule=rule).collect()
    assert collections.Counter((x.id, x.field, x.section, x.n_tokens) for x in got) == collections.Counter(want)


def test_allocation():
    sizes, starts = np.array([3, 2, 5]), np.array([0, 4, 4, 9])
    assert token_counts.allocate(sizes, starts, 10, "start").tolist() == [2, 0, 1, 0]
    assert token_counts.allocate(sizes, starts, 10, "majority").tolist() == [2, 0, 1, 0]
    assert token_counts.allocate(sizes, starts, 10, "fraction").tolist() == [1.5, 0, 0.5 + 0.8, 0.2]


# --- 8 ----------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = [
        (1, "http://A.example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "https://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        (4, "http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        (5, "http://badexample.net", "badexample.net", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/x", "", "", None, "allow"),
        (8, "a://b.net?x=/", "b.net", "", None, "allow"),
    ]
    bad = [(100 + i, f"http://spam.co/{i}") for i in range(60)] + [(200 + i, f"http://fine.io/{i}") for i in range(60)]
    pages = spark.createDataFrame([u[:2] for u in urls] + bad, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    outcomes = spark.createDataFrame([(100 + i, 0) for i in range(50)] + [(200 + i, 1) for i in range(50)] + [(1, None)], "page_id long, good int")
    got = {x.id: x for x in url_filter.filter_urls(pages, outcomes).collect()}
    for i, _, host, path, rule, verdict in urls:
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert got[155].verdict == "block" and got[255].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.filter_urls(pages, outcomes.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_levels(spark):
    d, s = url_filter.levels(F.col("h"), ("co.uk",))
    rows = spark.createDataFrame([("a.b.co.uk:80",), ("x.y.com",), ("com",), ("",)], "h string").select(d, s).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


# --- 9 ----------------------------------------------------------------------------------------------------------


def brute_words(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - length + 1):
            run = tuple(w[j : j + length])
            if run in seen:
                gone[j : j + length] = True
            seen.add(run)
        out[i] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("most", "states"), [(20_000, 400_000), (20_000, 50), (2, 400_000)])
def test_substring_dedup(spark, most, states):
    docs = corpus(7)
    got = {x.id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.substring_dedup(frame(spark, docs), length=10, most_variants=most, shard_states=states, bucket_bytes=4000).collect()}
    assert got == brute_words(docs, 10)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    same = substring_dedup.substring_dedup(frame(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]), length=3).collect()
    assert sorted((x.id, x.n_removed) for x in same) == [(1, 0), (1, 0), (2, 4)]


def test_against_reference(spark):
    docs, refs = corpus(7, 20), corpus(8, 10)[:10] + [(99, corpus(7, 20)[3][1])]
    runs = {tuple((t or "").split()[j : j + 6]) for _, t in refs for j in range(len((t or "").split()) - 5)}
    for most in (8 << 20, 500):
        got = {x.id: {s.start + k for s in x.spans for k in range(s.runs)} for x in substring_dedup.against_reference(frame(spark, docs), frame(spark, refs), length=6, most_bytes=most).collect()}
        want = {i: {j for j in range(len((t or "").split()) - 5) if tuple((t or "").split()[j : j + 6]) in runs} for i, t in docs}
        assert got == {i: s for i, s in want.items() if s}


def test_automaton():
    r = random.Random(5)
    a, texts = substring_dedup.SuffixAutomaton(), ["".join(r.choice("ab") for _ in range(20)) for _ in range(8)]
    for t in texts:
        a.add(t)
    q = "".join(r.choice("abc") for _ in range(60))
    want = [max((n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in t for t in texts)), default=0) for i in range(len(q))]
    assert list(a.matching(q)) == want


def test_segments_cover_every_run_once():
    docs = [(t or "").encode() for _, t in corpus(3, 20)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.r_[0, np.cumsum([len(d) for d in docs])]
    text, _, _, start, runs = anchors.segments(data, offsets, anchors.Unit("bytes", 50, 16))
    seen = collections.Counter((int(t), int(s) + k) for t, s, n in zip(text, start, runs, strict=True) for k in range(n))
    assert seen == collections.Counter((i, j) for i, d in enumerate(docs) for j in range(len(d) - 49))


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    docs = corpus(1) + [(500, None), (501, "one"), (501, "one")]
    table = f"t_{uuid.uuid4().hex}"
    exact_dedup.open_index(spark, table)
    got = exact_dedup.dedup(spark, frame(spark, docs), table).collect()
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    assert len(got) == len(docs)
    for x in got:
        t = next(t or "" for i, t in docs if i == x.id)
        assert (x.digest, x.keep_id, x.group_size, x.kept) == (hashlib.sha256(t.encode()).hexdigest(), max(groups[t]), len(groups[t]), x.id == max(groups[t]))
    assert spark.table(table).count() == len(groups)
    later = exact_dedup.dedup(spark, frame(spark, [(900, "one"), (901, "brand new"), (902, "brand new")]), table).collect()
    assert sorted((x.id, x.keep_id, x.kept) for x in later) == [(900, 501, False), (901, 902, False), (902, 902, True)]
    assert spark.table(table).count() == len(groups) + 1
    assert exact_dedup.dedup(spark, empty(spark), table).count() == 0
    again = exact_dedup.dedup(spark, frame(spark, docs).repartition(3), table).collect()
    assert collections.Counter((x.id, x.keep_id, x.group_size, x.kept) for x in again) == collections.Counter((x.id, x.keep_id, x.group_size, x.kept) for x in got)
    assert spark.table(table).count() == len(groups) + 1
    long = exact_dedup.dedup(spark, frame(spark, [(1, "x" * 3_000_000), (2, "x" * 3_000_000)]), table, batch="long")
    assert sorted((x.id, x.kept) for x in long.collect()) == [(1, False), (2, True)]
