"""Groups of rows that are tied together through equal values, also over several steps."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; in one process, where that is unset, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint(eager=True)


def looked_up(rows: DataFrame, words: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """rows joined with a dictionary on `key`: of at most `most` entries it is broadcast, beyond, both sides are dealt by the key.

    Left to itself Spark goes by the sizes of files, by which rows that are exploded from a small file count as
    less than a dictionary and are broadcast in its place.
    """
    if words.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(words), key)
    return rows.hint("merge").join(words, key)


def tied(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """rows with `first`: the least id that can be reached over rows of equal values in any of the keys.

    A null value ties nothing. In a round the least id goes through each key in turn, by a grouping with
    partial minima and a join, and then to the least id of the row that it names; rounds end when nothing changes.
    """
    now = checkpointed(rows.withColumn("first", F.col(id_col)))
    while True:
        moved = now
        for key in keys:
            least = moved.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("first").alias("_m"))
            moved = moved.join(least, F.col(key) == F.col("_k"), "left").withColumn("first", F.least("first", "_m")).drop("_k", "_m")
        onward = moved.select(F.col(id_col).alias("_i"), F.col("first").alias("_f"))
        moved = moved.join(onward, F.col("first") == F.col("_i"), "left").withColumn("_new", F.least("first", "_f")).drop("_i", "_f")
        moved = checkpointed(moved)
        same = moved.filter(F.col("_new") != F.col("first")).isEmpty() and moved.join(now.select(F.col(id_col).alias("_i"), F.col("first").alias("_was")), F.col(id_col) == F.col("_i")).filter(F.col("_was") != F.col("first")).isEmpty()
        now = moved.withColumn("first", F.col("_new")).drop("_new")
        if same:
            return now


def numbered(rows: DataFrame, id_col: str, slug: str, taken: DataFrame) -> DataFrame:
    """rows with `name`: the slug, with -2, -3 and so on where it is taken by `taken` (slug) or by a row of lesser id.

    A number is left out if the name that it makes is taken or is the slug of another row, so names are distinct and in no
    case one that stands already. The numbers that are taken of one slug are held as one sorted list.
    """
    parts = lambda c: F.struct(F.regexp_extract(c, r"^(.*)-([0-9]{1,9})$", 1).alias("stem"), F.regexp_extract(c, r"^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("int").alias("number"))
    used = taken.select(F.col("slug").alias("s")).unionByName(rows.select(F.col(slug).alias("s"))).distinct()
    numbers = used.select(parts(F.col("s")).alias("p")).filter("p.number >= 2").groupBy("p.stem").agg(F.array_sort(F.collect_set("p.number")).alias("numbers"))
    bare = taken.select(F.col("slug").alias("stem"), F.lit(1).alias("held")).distinct()
    place = F.row_number().over(Window.partitionBy(slug).orderBy(id_col))
    out = rows.withColumn("place", place).join(bare, F.col(slug) == bare["stem"], "left").drop("stem").join(numbers, F.col(slug) == numbers["stem"], "left").drop("stem")
    nth = F.col("place") + F.coalesce("held", F.lit(0))  # 1 is the slug itself
    skipped = F.size(F.filter(F.transform(F.coalesce("numbers", F.array().cast("array<int>")), lambda u, i: u - i), lambda x: x <= nth))
    return out.withColumn("name", F.when(nth == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), (nth + skipped).cast("string")))).drop("place", "held", "numbers")
