"""Filter audit, byte-pair automaton and periodic runs against brute force, with the odd cases of each."""

import hashlib
import itertools
import json
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import corpus, empty, frame

from riskloom.llm import bpe, exact_dedup, filter_audit, periodic_runs, quality, queries

ODD = [None, "", " \n\t ", "a " * 300, "one", "x" * 5000, "A" * 50, "# x", "é ñ"]

# --- 11 ---------------------------------------------------------------------------------------------------------


def brute_audit(docs, marks):
    """``docs``: (id, text, lang); ``marks``: id to (good, toxic)."""
    facts = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len({*w}) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        facts.append((lang or "", {c for c in "ABCDE" if fails[c]}, *marks.get(i, (0, 0))))
    out, total = {}, {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for o in itertools.permutations("ABCDE"):
            for k, c in enumerate(o):
                left = [f for f in mine if not f[1] & {*o[:k]}]
                gone = [f for f in left if c in f[1]]
                total[part, c] = total.get((part, c), 0) + len(gone)
                redundant = sum(c in f[1] for f in mine) - len(gone)
                out[part, "".join(o), k + 1] = (len(left) - len(gone), len(gone), redundant, sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("sketch_bytes", [1 << 20, 64])
def test_filter_audit(spark, sketch_bytes):
    """With 64 bytes the sketch clears hardly any text: the masks stay the same."""
    r = random.Random(3)
    texts = [t for _, t in corpus(5, 60)] + ODD + ODD
    docs = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(None, "one", "en"), (None, "alone", "en"), (2, texts[2], "en")]
    r.shuffle(docs)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, len(texts), 2)] + [(0, 1, 1), (None, 1, 1)]
    marks = {}
    for i, q, t in labels:
        if i is not None:
            a, b = marks.get(i, (0, 0))
            marks[i] = (max(a, q or 0), max(b, t))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("id", "h", "mask", "part", "first", "n", "good", "said")})
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masked = filter_audit.masks(df, queries.AUDIT_FILTERS, "E", sketch_bytes=sketch_bytes)
    got = audited(filter_audit.interactions(filter_audit.histogram(masked, marked), "ABCDE"))
    assert got == brute_audit(docs, marks)
    assert filter_audit.audit(df.limit(0), marked, queries.AUDIT_FILTERS, "E").count() == 0


def test_sketch_never_clears_a_repeat(spark):
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    h = np.r_[h, h[:500], np.full(2000, h[7])]
    rows = spark.createDataFrame([(int(x),) for x in h], "h long").repartition(5)
    for cells in (256, 1 << 14, 1 << 18):
        sketch = np.frombuffer(filter_audit.counting_sketch(rows, cells), np.uint8)
        found = filter_audit.possible_repeat(h, sketch, cells)
        assert found[:500].all() and found[3000:].all()
    assert found[500:3000].mean() < 0.01


# --- 12 ---------------------------------------------------------------------------------------------------------


def tiny():
    """A vocabulary with overlapping and doubled merges over a few bytes, as a file of the tokenizers library has it."""
    names = {b: c for c, b in bpe.byte_names().items()}
    vocab = {names[b]: b for b in range(256)}
    merges = []
    for a, b in [("a", "a"), ("b", "a"), ("aa", "a"), ("aa", "aa"), ("a", "b"), ("ba", "ba"), ("ab", "c"), ("c", "ab"), ("Ġ", "a"), ("Ġa", "b"), ("Ġ", "Ġ"), ("c", "c"), ("cc", "cc"), ("b", "c")]:
        merges.append([a, b])
        vocab[a + b] = len(vocab)
    return {"added_tokens": [{"id": len(vocab), "content": "<end>"}], "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": vocab, "merges": merges}}


def brute_tokens(word, labels, merges):
    """Merges one after another, each from left to right."""
    of = {v: k for k, v in labels.items()}
    out = [of[bytes([b])] for b in word.encode()]
    for u, v, w in merges:
        i, new = 0, []
        while i < len(out):
            hit = out[i : i + 2] == [u, v]
            new.append(w if hit else out[i])
            i += 1 + hit
        out = new
    return out


def test_automaton_of_all_short_words(tmp_path):
    kept = tiny()
    (tmp_path / "v.json").write_text(json.dumps(kept))
    vocab, names = kept["model"]["vocab"], bpe.byte_names()
    labels = {i: bytes(names[c] for c in t) for t, i in vocab.items()}
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in kept["model"]["merges"]]
    encoder = bpe.Encoder(bpe.from_file(str(tmp_path / "v.json")))
    for n in range(1, 9):
        for w in itertools.product("abc", repeat=n):
            for word in ("".join(w), " " + "".join(w)) if n < 7 else ("".join(w),):
                assert encoder.tokens(word) == brute_tokens(word, labels, merges)
    assert encoder.tokens("  ") == brute_tokens("  ", labels, merges)
    assert encoder.encode("ab<end>ab").tolist() == [*encoder.tokens("ab"), 270, *encoder.tokens("ab")]


def test_encode_and_decode_as_the_library(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "STORE_BYTES", 5000)
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    r = random.Random(8)
    odd = ["".join(chr(r.randrange(0x20, 0x3000)) for _ in range(40)) for _ in range(30)] + ["".join(r.choice("aab  \n'stre<|>") for _ in range(60)) for _ in range(60)]
    texts = [t for _, t in corpus(9, 40)] + ODD + odd + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " " * 900 + "x", "՘⃁ ꟎1", "1234567890" * 30, "don't we'll"]
    docs = frame(spark, list(enumerate(texts)))
    automaton = bpe.from_file(queries.VOCABULARY)
    got = {x.id: x for x in bpe.decode(bpe.encode(docs, automaton), automaton).collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == library.encode(t or "", add_special_tokens=False).ids
        assert got[i].decoded == library.decode(got[i].tokens, skip_special_tokens=False) == (t or "")
    assert bpe.encode(empty(spark), automaton).count() == 0
    arcs = spark.createDataFrame([(1, None), (2, []), (3, [50256, 72]), (4, [200])], "id int, tokens array<int>")
    assert [x.decoded for x in bpe.decode(arcs, automaton).orderBy("id").collect()] == ["", "", library.decode([50256, 72], skip_special_tokens=False), library.decode([200], skip_special_tokens=False)]


def test_op12(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    frame(spark, corpus(4, 20)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in queries.op12_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in corpus(4, 20):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (i, len(ids), sha(",".join(map(str, ids))), sha(t or ""))


# --- 13 ---------------------------------------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    """Every period, every stretch."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            part = w[start : start + length]
            smallest = not any(part[:-d] == part[d:] for d in range(1, q))
            if length >= max(least, times * q) and smallest:
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    r = random.Random(2)
    texts = [None, "", "x " * 23, "x " * 24, "x\t" * 500, "a b " * 12, "a b " * 11 + "a", ("a a b " * 9 + "a a c ") * 4, "é ñ a " * 8 + "é"]
    for _ in range(80):
        words = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice("abc") for _ in range(r.randint(0, 9))]
            root = [r.choice("ab") for _ in range(r.randint(1, 17))]
            words += (root * 8)[: r.randint(0, 4 * len(root))]
        texts.append(" ".join(words))
    texts += [" ".join(r.choice("ab") for _ in range(400)), " ".join((["u", "v"] * 40 + ["w"] * 30) * 3)]
    return texts


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_periodic_runs(spark, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "_SLICE", size)
    texts = periodic_texts()
    for least, times in ((24, 3), (6, 3), (1, 4)):
        got = {r.id: r for r in periodic_runs.periodic_runs(frame(spark, list(enumerate(texts))), least=least, times=times).collect()}
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            want = brute_runs(w, least, times)
            assert [tuple(x) for x in got[i].runs] == want
            assert (got[i].n_words, got[i].collapsed) == (len(w), collapsed(w, want))
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "a " * 30), (1, None), (1, "b " * 30)], "doc_id int, text string")
    assert sorted((str(r.id), len(r.runs)) for r in periodic_runs.periodic_runs(twice).collect()) == [("1", 0), ("1", 1), ("None", 1)]
    with pytest.raises(ValueError):
        periodic_runs.runs(np.zeros(4, np.int64), np.array([0, 4]), times=2)


def test_op13(spark, tmp_path):
    r = random.Random(6)
    texts = periodic_texts() + [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 200))) for _ in range(200)] + [None, "", "  "] * 30
    docs = list(enumerate(texts, 1))
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    changed = 0
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, before = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], w
            changed += w != before
        want = brute_runs(w)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        milli = best and 1000 * best[1] // best[2]
        assert tuple(got[i]) == (i, len(want), *(best or (None,) * 3), milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in want)), sha(collapsed(w, want)))
    assert changed > 5


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_periodic_runs"])
def test_equals_its_sql(spark, tmp_path, name):
    r = random.Random(1)
    texts = ([t for _, t in corpus(3, 50)] + ODD + periodic_texts()) * 2
    spark.createDataFrame([(i, t, r.choice(["en", "fr", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(80)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


# --- 10 and 5, in batches and with few rows ---------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_exact_dedup_in_batches(spark, batches):
    docs = [(i * 7 - 100, t) for i, t in corpus(2, 40)] + [(None, "one"), (None, "alone"), (None, "alone"), (-100, corpus(2, 40)[0][1])]
    name = f"batches_{batches}"
    exact_dedup.open_index(spark, name)
    got = exact_dedup.dedup_batches(spark, frame(spark, docs), name, batches=batches).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    of = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert sorted((str(r.id), r.digest, str(r.keep_id), r.group_size, r.kept) for r in got) == sorted((str(i), d, str(of[d][0]), of[d][1], i == of[d][0]) for i, d in ((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs))
    assert spark.table(name).count() == len(of)
    exact_dedup.open_index(spark, name + "e")
    assert exact_dedup.dedup_batches(spark, empty(spark), name + "e", batches=batches).count() == 0


def test_op10_leaves_no_table(spark, tmp_path):
    frame(spark, corpus(2, 20)).write.parquet(str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    got = queries.op10_exact_dedup(spark, str(tmp_path))
    assert {t.name for t in spark.catalog.listTables()} == before and got.count() == len(corpus(2, 20))


def test_quality_fits_few_rows(spark):
    texts = [(i, ("good plain words here " if i % 2 else "bad junk !!! ") * 3) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    few = labels.filter("doc_id < 12")
    scores = {r.doc_id: r.score for r in quality.classify(docs, quality.train(docs, few)).collect()}
    assert all((s > 0.5) == bool(i % 2) for i, s in scores.items())
    short = quality.train(docs, labels, sample_bytes=200)  # the bound on bytes leaves a few rows of each class
    assert short.prior is None or 0 <= short.prior <= 1
