"""The SQL of registered queries on texts at the borders of its own steps: nulls, empty texts, lengths about 400 and 800 bytes."""

import random

import duckdb
import pytest

from riskloom.llm import queries


def odd_documents():
    r = random.Random(3)
    plain = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = "".join(r.choice("uvwxyz") for _ in range(400))
    texts = [None, "", " ", "one", "ONE", "a b c d e", "A b\tc d e", "a b c d", "x" * 399, "y" * 400, "z" * 401]
    texts += ["".join(r.choice("mnop") for _ in range(n)) + shared for n in (0, 1, 399, 400, 401, 800)]
    texts += [shared + plain(n) for n in (0, 399, 400)] + [plain(300) + shared + plain(10) + shared + shared[:399]]
    words = [f"w{i}" for i in range(100)]
    texts += [" ".join(words), " ".join(words[:97]), " ".join(words[:96] + ["other"] * 4), " ".join(words[4:]), " ".join(words)]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("name", ["op3_minhash", "op4_suffix_dedup"])
def test_query_equals_its_sql(spark, tmp_path, name):
    docs = odd_documents()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
