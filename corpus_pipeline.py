"""The corpus pipeline: language, lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
the columns of documents; the last returns the packed pieces. run() writes each stage's rows as
Parquet to the shared folder and reads them again, so a lost executor costs one stage at most.
Null texts have no letters and go in the first stage; rows without an id and rows that repeat
one are handled as each operator says. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.llm import decontaminate, jaccard, language, lines, packing
from dealforge.llm.common import fresh, materialise, quoted, read, remove, shared_path, shuffles_dropped, small_batches
from dealforge.llm.queries import PACK_MODEL, vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those far from every centroid, or without letters, go."""
    model = language.train_on(docs, F.lit(True))
    found = language.identify(docs, model)
    return found.filter(~F.col(quoted(found.columns[-1]))).select(*map(quoted, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the document of least id only; n_chars follows the text."""
    out = lines.line_dedup(docs)  # docs' own columns first
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*map(quoted, docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays.

    Rows that share an id but not the text are documents of their own, of which the least hash of
    the text comes first; rows equal in both stay or go together. Rows without an id stay.
    """
    key = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low <> high and doc_id is not null")
    if several.isEmpty():
        found = jaccard.jaccard_components(docs.select("doc_id", "text"))
        extra = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
        return docs.join(extra, "doc_id", "left_anti").select(*map(quoted, docs.columns))
    rows = docs.filter("doc_id is not null").groupBy("doc_id", key.alias("th")).agg(F.first("text").alias("text"))
    rows = materialise(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    found = jaccard.jaccard_components(rows, "node").join(rows.select("node", "doc_id", "th"), "node")
    order = F.struct("doc_id", "th")
    first = found.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = found.join(first, "component_id").filter(order != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"))
    own, gone_id, gone_th = fresh(docs, "own_th", "gone_id", "gone_th")
    kept = docs.withColumn(own, key).join(gone.toDF(gone_id, gone_th), (F.col("doc_id") == F.col(gone_id)) & (F.col(own) == F.col(gone_th)), "left_anti")
    return kept.select(*map(quoted, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(PACK_MODEL))


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language identification cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with small_batches(spark), shuffles_dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
