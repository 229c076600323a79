"""The registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decon
from . import bpe, exact_dedup, filter_audit, line_dedup, near_dedup, packing, periodic_runs, quality, substring_dedup, suffix_dedup, token_counts, url_filter
from .shared import delete, shared_dir

#: The vocabulary of op12; a session can name another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decon.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        decon.contaminated(F.col("_hit"), F.col("_n_words")).alias("contaminated"),
    )


OP1_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS k, least(13, len(w)) AS m
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT doc_id, s, m, item_id FROM (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)) JOIN win USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come as two batches to an index in the shared folder, which goes when the verdicts are written."""
    name = f"digest_index_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/riskloom/{name}"
    exact_dedup.open_index(spark, name, path)
    out = exact_dedup.dedup_batches(spark, _table(spark, sf_dir, "documents"), name)
    spark.sql(f"DROP TABLE {name}")
    delete(spark, path)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, i, t, list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, i, list_sort(w) AS w FROM l WHERE len(w) > 0),
c AS (SELECT row_number() OVER () AS c, w, len(w) AS n, min((doc_id, i)) AS first FROM s GROUP BY w),
t AS (SELECT c, n, first, unnest(w) AS k FROM c),
p AS (SELECT b.c, a.n AS x, b.n AS y, count(*) AS common FROM t a JOIN t b ON a.k = b.k AND a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.c, b.c, a.n, b.n),
m AS (SELECT DISTINCT c FROM p WHERE 100 * common >= 80 * (x + y - common)),
g AS (SELECT s.doc_id, s.i FROM s JOIN c USING (w) LEFT JOIN m USING (c) WHERE (s.doc_id, s.i) > c.first OR m.c IS NOT NULL)
SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(t, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r ON r.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are two hex digits each. Strings are read from overlapping pieces, as cutting a long text at every byte takes long.
OP4_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT doc_id, j, substr(x, 800 * j + 1, 1598) AS y FROM (SELECT doc_id, x, unnest(range(0, n // 400)) AS j FROM h WHERE n >= 400)),
k AS (SELECT doc_id, 400 * j + o AS i, md5_number(substr(y, 2 * o + 1, 800)) AS k FROM (SELECT doc_id, j, y, unnest(range(0, 400)) AS o FROM q) WHERE length(y) >= 2 * o + 800),
r AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m) GROUP BY doc_id, span),
b AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM b JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source", "text"], sections_of="text")
    return out.withColumnRenamed("id", "doc_id")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): a page's outcome is the quality label of the document whose number its url's path has."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) AS bigint)")
    marks = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max("quality").alias("good"))
    return pages.select("page_id", number.alias("number")).filter("number IS NOT NULL").join(marks.hint("merge"), "number").select("page_id", "good")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             TRY_CAST(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT) AS number FROM p),
l AS (SELECT doc_id AS number, max(quality) AS good FROM labels GROUP BY doc_id),
c AS (SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n FROM q LEFT JOIN l USING (number) GROUP BY host),
h AS (SELECT host, good, n, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM c),
bh AS (SELECT host, good, n, array_to_string(parts[greatest(len(parts) - 1, 1):], '.') AS domain, parts[len(parts)] AS suffix FROM h),
g AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m FROM bh),
s0 AS (SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(m) AS m FROM bh, g GROUP BY suffix),
k1 AS (SELECT sum(power(good / n - m, 2) * n) AS a, sum(m * (1 - m)) AS b, sum(m * (1 - m) * (n - 1)) AS c FROM s0 WHERE n > 0),
t1 AS (SELECT CASE WHEN c > 0 AND a > b THEN least(1000.0, greatest(1.0, c / (a - b) - 1)) ELSE 1000.0 END AS s FROM k1),
m1 AS (SELECT suffix, (good + s * m) / (n + s) AS m FROM s0, t1),
s1 AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n, any_value(m) AS m FROM bh JOIN m1 USING (suffix) GROUP BY domain, suffix),
k2 AS (SELECT sum(power(good / n - m, 2) * n) AS a, sum(m * (1 - m)) AS b, sum(m * (1 - m) * (n - 1)) AS c FROM s1 WHERE n > 0),
t2 AS (SELECT CASE WHEN c > 0 AND a > b THEN least(1000.0, greatest(1.0, c / (a - b) - 1)) ELSE 1000.0 END AS s FROM k2),
m2 AS (SELECT domain, suffix, (good + s * m) / (n + s) AS m FROM s1, t2),
s2 AS (SELECT host, good, n, m FROM bh JOIN m2 USING (domain, suffix)),
k3 AS (SELECT sum(power(good / n - m, 2) * n) AS a, sum(m * (1 - m)) AS b, sum(m * (1 - m) * (n - 1)) AS c FROM s2 WHERE n > 0),
t3 AS (SELECT CASE WHEN c > 0 AND a > b THEN least(1000.0, greatest(1.0, c / (a - b) - 1)) ELSE 1000.0 END AS s FROM k3),
ab AS (SELECT host, good + s * m AS a, n - good + s * (1 - m) AS b FROM s2, t3),
u AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM ab),
r AS (SELECT page_id, host, path,
      CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN u USING (host)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS p, true AS hit FROM g) USING (doc_id, p) WHERE hit IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: What separates words: space and x09 to x0D.
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, WHITE), "")


def _few_distinct(text: F.Column) -> F.Column:
    return 100 * F.size(F.array_distinct(words_of(text))) < 80 * F.size(words_of(text))


#: Failure conditions of op11's filters; E fails texts that a smaller id has.
AUDIT_FILTERS = {
    "A": lambda text: F.size(words_of(text)) < 100,
    "B": _few_distinct,
    "C": lambda text: 100 * (F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.char_length(text),
    "D": lambda text: text.rlike("[#$%&*|]"),
}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), AUDIT_FILTERS, "E")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
k AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, x.i AS step, o[x.i] AS own, o[1:x.i - 1] AS before FROM o, x),
j AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda f: f)) AS failed FROM m, k),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
             sum(n) FILTER (WHERE NOT gone AND NOT hit) AS kept, sum(n) FILTER (WHERE NOT gone AND hit) AS removed, sum(n) FILTER (WHERE gone AND hit) AS redundant,
             sum(n) FILTER (WHERE hit AND failed = 1) AS unique_fails, sum(good) FILTER (WHERE NOT gone AND hit) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND hit) AS toxic_lost
      FROM j GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = bpe.from_file(spark.conf.get("riskloom.vocabulary", VOCABULARY))
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), automaton), automaton)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of op13: in one document of ten, by its id's checksum, the words from one place on repeat a stretch of them."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    g, n = F.floor(h / 10).cast("long"), F.size("w").cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), g.alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("a", F.when(n > 0, F.expr("g % size(w)")))
    rows = rows.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(n > 0, turned).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(_table(spark, sf_dir, "documents")))
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (m, r) -> if(r.length * m.period > m.length * r.period, r, m))")  # by start and period, so the first of equal ones
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (r["period"]).cast("string"))), "\n")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best").getField(c).alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The table of names of factors as in the method, built by joining the table with itself; checksums are computed bit by bit.
OP13_SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
v AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM g),
t AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS w FROM v),
k(doc_id, i, f, x) AS (SELECT doc_id, i, CAST(1 AS BIGINT), dense_rank() OVER (ORDER BY w) FROM t
  UNION ALL SELECT a.doc_id, a.i, 2 * a.f, dense_rank() OVER (ORDER BY a.x, b.x) FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i = a.i + a.f),
s AS (SELECT doc_id, f, i, lead(i) OVER (PARTITION BY doc_id, f, x ORDER BY i) - i AS d FROM k),
p AS (SELECT doc_id, f, i, d, i - row_number() OVER (PARTITION BY doc_id, f, d ORDER BY i) AS stretch FROM s WHERE d <= f AND 2 * d > f),
r AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + f + d AS length, d AS period FROM p GROUP BY doc_id, f, d, stretch HAVING max(i) - min(i) + f + d >= greatest(24, 3 * d)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY doc_id),
m AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))),
q AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
l AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t ANTI JOIN q USING (doc_id, i) GROUP BY doc_id)
SELECT v.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN o USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_line_dedup": op2_line_dedup,
        "op3_minhash": op3_minhash,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_token_counts": op7_token_counts,
        "op8_url_filter": op8_url_filter,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_bpe": op12_bpe,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op3_minhash": OP3_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op8_url_filter": OP8_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_filter_audit": OP11_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
