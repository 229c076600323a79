"""Registered queries over stored indexes, table sets, archives, bad records and streams with state, with their DuckDB SQL."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.staging import shared_dir
from ..operators import matching
from ..operators import vector_index as V
from ..sources import quarantine
from ..sources import table_set as TS
from ..streaming import jobs, states
from .fixtures import SCORES, table
from .queries import _HUNDREDTH, SQL, _event_stream, _run, query

# --- the vector index -------------------------------------------------------------------------------------------


def _index(spark, d) -> tuple[TS.TableSet, DataFrame]:
    rows = table(spark, d, "embeddings")
    return V.rebuild(spark, rows, f"{shared_dir(spark)}/riskloom/index_{uuid.uuid4().hex}"), rows


def _probes(index: TS.TableSet) -> int:
    """Three cells of four: these vectors lie in all directions alike, where neighbours share a cell seldom. Clusters need far fewer."""
    return -(-3 * index.read("centres").count() // 4)


@query("vector_index_top_k")
def _(spark, d):
    index, rows = _index(spark, d)
    return V.search(index, rows.filter(_HUNDREDTH), 10, _probes(index)).select("query", "id", "rank")


@query("vector_index_recall", "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    index, rows = _index(spark, d)
    queries = rows.filter(_HUNDREDTH)
    return V.recall(V.search(index, queries, 10, _probes(index)), matching.top_k(queries, rows, 10), 10).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query("vector_index_all_cells", SQL["vector_top_k_full"])
def _(spark, d):
    index, rows = _index(spark, d)
    return V.search(index, rows.filter(_HUNDREDTH), 10, V.MOST_CELLS).select("query", "id", "rank")


# --- tables that change together ----------------------------------------------------------------------------------

_SET = """WITH gone AS (SELECT 'r' || n_nationkey AS repo FROM nation WHERE n_regionkey = 2),
scores AS (SELECT 'r' || user_id % 25 AS repo, event_id AS id FROM events), roles AS (SELECT 'r' || c_nationkey AS repo, c_custkey AS id FROM customer), blocked AS (SELECT 'r' || s_nationkey AS repo, s_suppkey AS id FROM supplier)
"""


@query("repo_deletion", _SET + """SELECT 'scores' AS name, id FROM scores WHERE repo NOT IN (SELECT repo FROM gone) UNION ALL SELECT 'roles', id FROM roles WHERE repo NOT IN (SELECT repo FROM gone) UNION ALL SELECT 'blocked_authors', id FROM blocked""")
def _(spark, d):
    repo = lambda c: F.concat(F.lit("r"), c).alias("repo")
    start = {
        "scores": table(spark, d, "events").select(repo(F.col("user_id") % 25), F.col("event_id").alias("id")),
        "roles": table(spark, d, "customer").select(repo(F.col("c_nationkey")), F.col("c_custkey").alias("id")),
        "blocked_authors": table(spark, d, "supplier").select(repo(F.col("s_nationkey")), F.col("s_suppkey").alias("id")),
    }
    tables = TS.TableSet(spark, f"{shared_dir(spark)}/riskloom/tables_{uuid.uuid4().hex}").commit(start)
    gone = table(spark, d, "nation").filter("n_regionkey = 2").select(repo(F.col("n_nationkey")))
    tables = tables.commit(TS.without_repos(tables, gone))
    rows = [tables.read(n).select(F.lit(n).alias("name"), F.col("id").cast("long").alias("id")) for n in start]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- archives and bad records -----------------------------------------------------------------------------------


def archived(rows: DataFrame) -> DataFrame:
    """(archive, content): one compressed tar archive out of the files of each row (archive, files array<struct<path, data>>)."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(x, 64) for b in parts for x in range(0, b.num_rows, 64)):
            out = []
            for files in part.column(1).to_pylist():
                held = io.BytesIO()
                with tarfile.open(fileobj=held, mode="w:gz") as tar:
                    for f in files:
                        m = tarfile.TarInfo(f["path"])
                        m.size = len(f["data"])
                        tar.addfile(m, io.BytesIO(f["data"]))
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["archive", "content"])

    return rows.select("archive", "files").mapInArrow(pack, "archive long, content binary")


_ARCHIVED = """WITH f AS (SELECT doc_id // 10 AS archive, CASE doc_id % 10 WHEN 3 THEN '../up/' WHEN 7 THEN '/abs/' ELSE 'src/' END || doc_id || '.txt' AS path, coalesce(text, '') AS text, doc_id % 5 = 4 AS broken FROM documents)
SELECT archive, path, CASE WHEN path LIKE 'src/%' AND NOT broken THEN md5(text) END AS text, CAST(octet_length(encode(text)) + broken::INT AS BIGINT) AS n_bytes, CASE WHEN path NOT LIKE 'src/%' THEN 'unsafe_path' WHEN broken THEN 'not_utf8' END AS reason FROM f"""


def _archives(spark, d) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(F.when(k % 10 == 3, "../up/").when(k % 10 == 7, "/abs/").otherwise("src/"), k, F.lit(".txt"))
    data = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.when(k % 5 == 4, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    files = table(spark, d, "documents").select(F.floor(k / 10).cast("long").alias("archive"), F.struct(path.alias("path"), data.alias("data")).alias("f"))
    return archived(files.groupBy("archive").agg(F.collect_list("f").alias("files")))  # ten documents an archive


@query("archive_files", _ARCHIVED)
def _(spark, d):
    return quarantine.archive_files(_archives(spark, d)).withColumn("text", F.md5("text"))


@query("archive_files_sql", _ARCHIVED)
def _(spark, d):
    quarantine.register_functions(spark)
    return spark.sql("SELECT archive, m.path, md5(m.text) AS text, m.n_bytes, m.reason FROM {archives}, LATERAL archive_members(content) AS m", archives=_archives(spark, d))


@query("quarantined_records", """WITH r AS (SELECT doc_id, octet_length(encode(text)) + (doc_id % 7 = 0)::INT AS n, doc_id % 11 = 0 AS missing, doc_id % 7 = 0 AS broken, text FROM documents)
SELECT doc_id, CASE WHEN missing OR text IS NULL THEN 'missing' WHEN n > 2000 THEN 'too_large' WHEN broken THEN 'not_utf8' END AS reason, CASE WHEN NOT (missing OR text IS NULL) AND n <= 2000 AND NOT broken THEN md5(text) END AS text,
CASE WHEN NOT (missing OR text IS NULL) AND (n > 2000 OR broken) THEN CAST(n AS BIGINT) END AS n_bytes FROM r""")
def _(spark, d):
    k = F.col("doc_id")
    data = F.when(k % 11 != 0, F.concat(F.encode("text", "UTF-8"), F.when(k % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))))
    good, bad = quarantine.split(table(spark, d, "documents").select("doc_id", data.alias("content")), ["doc_id"], most=2000)
    none = F.lit(None)
    return good.select("doc_id", none.cast("string").alias("reason"), F.md5("text").alias("text"), none.cast("long").alias("n_bytes")).unionByName(bad.select("doc_id", "reason", none.cast("string").alias("text"), "n_bytes"))


# --- streams with state -----------------------------------------------------------------------------------------


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def _(spark, d):
    rows = _run(states.sessions(_event_stream(spark, d), "user_id", "6 hours"), "complete")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("user_id", stamp("start"), stamp("end"), "n")


@query("stream_followed_by", """WITH a AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'purchase'),
wm AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 1 HOUR AS t), m AS (SELECT a.user_id, a.id, b.id AS next_id FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS)
SELECT user_id, id, next_id FROM m UNION ALL SELECT user_id, id, NULL FROM a, wm WHERE id NOT IN (SELECT id FROM m) AND date_trunc('milliseconds', a.ts) + INTERVAL 12 HOURS < date_trunc('milliseconds', wm.t)""")
def _(spark, d):
    e = _event_stream(spark, d).withColumnRenamed("event_id", "id")
    out = states.followed_by(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", within="12 hours")
    return _run(out, "append").select("user_id", "id", "next_id")


@query("stream_build_states")
def _(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in {"view": "request", "click": "start", "purchase": "done", "error": "fail", "signup": "request"}.items() for x in pair)), F.col("event_type"))
    rows = _event_stream(spark, d).select(F.col("user_id").alias("repo"), "ts", F.col("event_id").alias("ord"), kind.alias("kind"), F.col("props").cast("string").alias("message"))
    states.use_rocksdb(spark)
    try:
        return _run(states.build_states(rows, stale=86_400, ttl=10 * 86_400), "append")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@query("stream_append_scores", SCORES + "SELECT event_id, repo, score, verdict FROM scores")
def _(spark, d):
    base = f"{shared_dir(spark)}/riskloom/stream_{uuid.uuid4().hex}"
    e = _event_stream(spark, d)
    score = (F.floor("value") % 101).cast("int")
    rows = e.select("event_id", F.concat(F.lit("org/repo"), F.col("user_id") % 7).alias("repo"), score.alias("score"), S.verdict(score).alias("verdict"))
    jobs.append_scores(rows, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


@query("stream_notify", SCORES + "SELECT event_id, score FROM scores WHERE repo = 'org/repo2'")
def _(spark, d):
    base = f"{shared_dir(spark)}/riskloom/stream_{uuid.uuid4().hex}"
    rows = _event_stream(spark, d).select("event_id", F.concat(F.lit("org/repo"), F.col("user_id") % 7).alias("repo"), (F.floor("value") % 101).cast("int").alias("score"))
    publish = lambda batch, number: batch.select("event_id", "score").write.mode("overwrite").parquet(f"{base}/out/batch={number}")  # noqa: E731  a batch that is told again is told alike
    jobs.notify(rows, publish, f"{base}/checkpoint", "org/repo2").awaitTermination()
    return spark.read.schema("event_id long, score int, batch int").parquet(f"{base}/out").drop("batch")
