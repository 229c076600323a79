"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; ``run``
writes each one's result as Parquet and reads it again for the next. All but the last return the columns of documents.

``docs`` has doc_id and text; other columns, of any names, are passed on as they are (line dedup counts n_chars anew). An
empty table gives an empty result. Null texts count as empty. Rows that repeat an id are judged row by row by the classifier
and by decontamination; line dedup takes those with one text as one document; near-dedup drops all rows of an id or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import anchors, decontaminate, line_dedup, near_dedup, packing, quality
from riskloom.llm.shared import staged

#: Documents with a lower score are rejected. Lower than the mark of a good document: what is in doubt stays.
MIN_QUALITY = 0.5
#: Documents with so many hundredths of their shingles in common are near duplicates.
NEAR_PERCENT = 80


def _renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with names for all columns but doc_id and text that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. Empty documents are scored like all others."""
    rows = _renamed(docs)
    model = quality.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.classify(rows, model, score_col="score").filter(F.col("score") >= MIN_QUALITY)
    return kept.select(*rows.columns).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line matches; a document that has lost lines and has no word left goes.

    Documents that lose no line stay as they are, a null text too; n_chars, if it is a column, follows the text of the
    others.
    """
    rows = anchors.keyed(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text"), "doc_id", "text", ["whole"])
    cut = anchors.attach(rows, line_dedup.removed_lines(rows)).withColumn("kept", line_dedup.without_lines(F.col("text"), F.col("gone")))
    left = cut.filter(F.col("gone").isNull() | (packing.word_count(F.col("kept")) > 0))

    def value(name: str) -> F.Column:
        old = F.col("whole").getField(name)
        if name == "text":
            return F.when(F.col("gone").isNull(), old).otherwise(F.col("kept"))
        if name == "n_chars":
            return F.when(F.col("gone").isNull(), old).otherwise(F.char_length("kept").cast(docs.schema[name].dataType))
        return old

    return left.select(*(value(c).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    dropped = staged(near_dedup.near_dedup(docs, percent=NEAR_PERCENT), "near").filter(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    rows = _renamed(docs)
    return rows.join(dropped.hint("merge"), "doc_id", "left_anti").select(*rows.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words one in twenty or more lie in occurrences of benchmark windows."""
    rows = _renamed(docs)
    out = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.filter(~decontaminate.contaminated(F.col("_hit"), F.col("_n_words"))).select(*rows.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place in the batch of each document."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_stage), ("minhash_near_dedup", near_stage), ("benchmark_decontamination", decontamination), ("packing", packing_stage)]

#: The classifier's fit and the search for the best buckets can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
