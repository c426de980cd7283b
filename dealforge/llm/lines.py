"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

State: runs, each a table of distinct line hashes that is bucketed and sorted by hash, on
levels. A batch of documents is grouped by hash, then merge-anti-joined with every run; all
runs share one bucketing, so the batch is shuffled once and the runs not at all. What remains
is new and becomes a run of level 0; FAN runs of a level are merged into one of the next.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, fresh, materialise, quoted

FAN = 3
BATCHES = 4
LEAST = 10
MAX_HOT = 4096
LAST = 2**63 - 1
STRIP = " \t\n\x0b\x0c\r"


def line_key(line):
    return ascii_lower(F.trim(line, F.lit(STRIP)))


class Runs:
    """Levelled sorted runs in tables of the warehouse, which the cluster shares."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels, self.stem = spark, buckets, [[]], f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.stem}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def known(self, batch: DataFrame) -> DataFrame:
        """batch with a column `known`: whether a run has the key."""
        batch = batch.repartition(self.buckets, "h1", "h2").withColumn("known", F.lit(False))
        for run in self.tables():
            run = run.select("h1", "h2", F.lit(True).alias("hit"))
            batch = batch.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("known", F.col("known") | F.coalesce("hit", F.lit(False))).drop("hit")
        return batch

    def add(self, new: DataFrame) -> None:
        self.levels[0].append(self._write(new))
        level = 0
        while len(self.levels[level]) >= FAN:
            merged = self._write(reduce(DataFrame.unionAll, [self.spark.table(n) for n in self.levels[level]]))
            for name in self.levels[level]:
                self.spark.sql(f"DROP TABLE {name}")
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES, least: int = LEAST) -> DataFrame:
    """(id, th, gone): the positions of lines that each document loses. th is a hash of its text."""
    spark = docs.sparkSession
    at = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))
    quantiles = docs.select(at.alias("at")).approxQuantile("at", [i / n_batches for i in range(1, n_batches)], 0.02)
    cuts = sorted({min(int(q), LAST) for q in quantiles})  # as a double, LAST is one more
    batch = reduce(lambda x, c: x + F.when(F.col("at") > F.lit(c), 1).otherwise(0), cuts, F.lit(0))
    lines = docs.select(at.alias("at"), F.xxhash64(text_col).alias("th"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least)
    keyed = keyed.select(batch.alias("batch"), "at", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.char_length("key")).alias("h2"))
    keyed = materialise(keyed, "lines")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    repeats = []
    try:
        for b in range(len(cuts) + 1):
            firsts = keyed.filter(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
            firsts = checkpointed(runs.known(firsts))
            # A known key has its first document in an earlier batch; a new one may repeat in this batch.
            repeats.append(firsts.filter(F.col("known") | (F.col("first") < F.col("last"))).select(F.lit(b).alias("batch"), "h1", "h2", F.when(~F.col("known"), F.col("first")).alias("first"), "n"))
            runs.add(firsts.filter(~F.col("known")).select("h1", "h2"))
        repeated = checkpointed(reduce(DataFrame.unionAll, repeats))
    finally:
        runs.drop()
    # Keys with many lines, at most MAX_HOT in all (their counts add up to the lines), go by broadcast
    # so that none of them meets in one task; the others are joined by hash.
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1000, -(-total // MAX_HOT))
    on = ["batch", "h1", "h2"]
    late = F.col("first").isNull() | (F.col("at") > F.col("first"))
    few = repeated.filter(hot).select(*on, "first")
    cold = keyed.join(F.broadcast(few.select(*on)), on, "left_anti").join(repeated.filter(~hot).select(*on, "first"), on)
    dropped = keyed.join(F.broadcast(few), on).filter(late).unionByName(cold.filter(late))
    return dropped.groupBy("at", "th").agg(F.array_sort(F.array_distinct(F.collect_list("pos"))).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES, least: int = LEAST) -> DataFrame:
    """docs with text_col reduced to the kept lines, plus _n_lines and _n_dropped (last, with more
    underscores where docs has such a column already).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    `least` code points in two documents or more keep their lines only in the document of least
    id. A null text becomes one empty line. A null id counts as greater than any other, and all
    such rows as one document; so do rows that repeat an id. Other columns stay as they are. An
    empty table gives no rows. Keys are compared by two 64-bit hashes.
    """
    at, th, lost, lines, kept, n_lines, n_dropped = fresh(docs, "_at", "_th", "_gone", "_lines", "_kept", "_n_lines", "_n_dropped")
    gone = drop_positions(docs.select(id_col, text_col), id_col, text_col, n_batches, least).toDF(at, th, lost)
    whole = docs.withColumn(at, F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))).withColumn(th, F.xxhash64(text_col))
    whole = whole.join(gone, [at, th], "left").withColumn(lines, lines_of(F.col(text_col)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    text = F.when(F.col(lost).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    out = whole.withColumn(kept, text).withColumn(n_lines, F.size(lines).cast("bigint")).withColumn(n_dropped, F.coalesce(F.size(lost), F.lit(0)).cast("bigint"))
    return out.select(*[F.col(kept).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns], n_lines, n_dropped)
