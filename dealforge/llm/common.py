"""Small helpers shared by the operators: the shared folder, hashing folds, bounded broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_OWN: dict[str, str] = {}  # by application, the folder of its intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, as in tests, a temporary one is made; but only if everything runs in one
    process, since on a cluster the executors would not see it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in a folder of this application's, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{shared_dir(spark).rstrip('/')}/tables-{app}-{uuid.uuid4().hex}"
        atexit.register(_remove_own, spark, app)
    return f"{_OWN[app]}/{what}-{uuid.uuid4().hex}"


def _remove_own(spark: SparkSession, app: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and sc.applicationId == app and not sc._jsc.sc().isStopped():
        remove(spark, _OWN[app])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of shared_path() that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside send at most `rows` rows to Python at a time.

    An executor buffers a batch beside its heap, and its worker once more, so batches of ten
    thousand whole texts cost memory that neither gives back. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made inside drop their shuffle files as soon as they have run, not when the driver collects garbage.

    For steps that write a table, checkpoint or collect: nothing reads their shuffles again. A frame
    that is handed out to be run more than once is made outside; inside, a second run of the same
    frame would be right, but would make its shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of docs is called so (case aside)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write once to the shared folder and read back with the same schema."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables between the steps of one run, in the shared folder, each dropped when its last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, what: str, df: DataFrame) -> DataFrame:
        self.paths[what] = path = shared_path(self.spark, what)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for what in names:
            remove(self.spark, self.paths.pop(what))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. lower() agrees on pure ASCII and is cheaper than translate()."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def crc32_fold(id_col: Column) -> Column:
    """crc32(id as text) mod 5; fold 0 is held out. A row without id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
