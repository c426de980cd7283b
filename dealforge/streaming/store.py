"""A keyed table in partitions, written batch by batch, and a lease: state of streams on storage that the cluster shares.

A batch writes only the partitions that it touches, whole, as version=<number of the batch>/<column>=<value>; a reader takes
the last version of each partition. A batch that is run again reads what was there before it and overwrites its own version, so
replays change nothing. Versions that two later ones of a partition replace are removed, so files do not pile up.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.operators.sinks import upsert


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def versions(spark: SparkSession, path: str, part: str) -> dict[str, list[int]]:
    """For each partition, as its folder is named, the numbers of its whole versions, last first."""
    found: dict[str, list[int]] = {}
    for number in sorted((int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("version=")), reverse=True):
        if _exists(spark, f"{path}/version={number}/_SUCCESS"):  # else its writer was lost
            for name in _names(spark, f"{path}/version={number}"):
                if name.startswith(f"{part}="):
                    found.setdefault(name, []).append(number)
    return found


def _folders(spark: SparkSession, path: str, part: str, before: int | None = None) -> dict[str, str]:
    kept = {name: [n for n in numbers if before is None or n < before] for name, numbers in versions(spark, path, part).items()}
    return {name: f"{path}/version={numbers[0]}/{name}" for name, numbers in kept.items() if numbers}


def stored(spark: SparkSession, path: str, part: str = "day") -> DataFrame | None:
    """The table's rows, one for each key, without any window; None before the first batch."""
    folders = _folders(spark, path, part)
    if not folders:
        return None
    table = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*folders.values()).drop("version")
    return table


def store(batch: DataFrame, path: str, number: int, keys: list[str], order: list[Column], part: str = "day", on_conflict: str = "update", ranked: bool = True) -> None:
    """Merges a batch into the partitions that it touches. Rows of a key must lie in one partition; part may not be null.

    Only the names of the partitions that a batch touches come to the driver.
    """
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(F.col(part).cast("string")).distinct().collect()]
    if not touched:
        return
    before = {name: folder for name, folder in _folders(spark, path, part, number).items() if name.split("=", 1)[1] in touched}
    rows = batch
    if before:
        kind = dict(batch.dtypes)[part]
        old = spark.read.option("basePath", path).parquet(*before.values()).withColumn(part, F.col(part).cast(kind)).select(*batch.columns)
        rows = upsert(old, batch, keys, order, on_conflict, ranked)
    else:
        rows = upsert(batch.limit(0), batch, keys, order, on_conflict, ranked)
    rows.repartition(part).write.mode("overwrite").partitionBy(part).parquet(f"{path}/version={number}")
    for name, numbers in versions(spark, path, part).items():
        for old_number in [n for n in numbers if n < number][1:]:
            files, where = _files(spark, f"{path}/version={old_number}/{name}")
            files.delete(where, True)


class Lease:
    """The right to run a job, among all applications that share `folder`, for `seconds` at a time.

    Each taking makes a file of the next generation, which only one can make; the holder of the last generation
    has the lease until its file is older than `seconds`, unless it renews it.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, seconds: float, clock=time.time) -> None:
        self.spark, self.folder, self.name, self.seconds, self.clock = spark, folder.rstrip("/"), name, seconds, clock
        self.owner, self.generation = uuid.uuid4().hex, None

    def _last(self) -> int | None:
        return max((int(n.rsplit(".", 1)[1]) for n in _names(self.spark, self.folder) if n.rsplit(".", 1)[0] == self.name and n.rsplit(".", 1)[1].isdigit()), default=None)

    def _path(self, generation: int) -> str:
        return f"{self.folder}/{self.name}.{generation}"

    def _create(self, path: str) -> bool:
        """Makes a file that is not there; false if another was first. A local file system tells that by its own call only."""
        jvm = self.spark.sparkContext._jvm
        files, where = _files(self.spark, path)
        files.mkdirs(where.getParent())
        try:
            if files.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(jvm.java.net.URI.create("file://" + where.toUri().getPath())), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                files.create(where, False).close()
        except Exception as error:  # noqa: BLE001  the class is the JVM's
            if "AlreadyExists" in str(error):
                return False
            raise
        files.setTimes(where, int(self.clock() * 1000), -1)
        return True

    def _fresh(self, generation: int) -> bool:
        files, where = _files(self.spark, self._path(generation))
        return files.exists(where) and files.getFileStatus(where).getModificationTime() / 1000 + self.seconds > self.clock()

    def take(self) -> bool:
        last = self._last()
        if last is not None and self._fresh(last):
            return self.generation == last
        following = 0 if last is None else last + 1
        self.generation = following if self._create(self._path(following)) else None
        return self.generation is not None

    def renew(self) -> bool:
        """Whether the lease is still held, which then lasts for `seconds` more."""
        if self.generation is None or self._last() != self.generation or not self._fresh(self.generation):
            return False
        files, where = _files(self.spark, self._path(self.generation))
        files.setTimes(where, int(self.clock() * 1000), -1)
        return True

    def release(self) -> None:
        if self.generation is not None:
            files, where = _files(self.spark, self._path(self.generation))
            files.delete(where, False)
            self.generation = None
