"""Canonical exact digests: normalise, fold case and white space, wide xxhash, compare bytes inside equal ones.

Also the neighbour operator that gives each text its successor in id order without a global
sort in one task.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, materialise, quoted
from .textkernel import chunks

FILTER_BITS = 1 << 24  # 2 MB, whatever the input
MEMO_BYTES = 1 << 25  # texts that a task keeps to compare copies with
HOT_SHARE = 1000  # a group with more than one in so many rows of groups is broadcast
MAX_COLLISIONS = 10_000  # hashes that different texts share, kept by every task


def canonical(text: str | None) -> str:
    """NFKC, case folded, NFKC again (folding can undo it), runs of white space as one space."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide_hash(canon: bytes) -> str:
    """128-bit xxhash, as 32 hex digits."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon)


def digest(text: str | None, collided: frozenset = frozenset(), wide: Callable[[bytes], str] = wide_hash) -> str:
    """The wide hash of the canonical text; where different texts share that, its SHA-256 is appended."""
    canon = canonical(text).encode("utf-8", "surrogatepass")
    found = wide(canon)
    return f"{found}-{hashlib.sha256(canon).hexdigest()}" if found in collided else found


def fingerprints(docs: DataFrame, collided: frozenset = frozenset(), id_col: str = "doc_id", text_col: str = "text", wide: Callable[[bytes], str] = wide_hash) -> DataFrame:
    """id and fingerprint of each row; a null text counts as empty, null and repeated ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t, collided, wide) for t in b.column(1).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, fingerprint string")


def _bit(key: str) -> int:
    return zlib.crc32(key.encode()) % FILTER_BITS


def collisions(docs: DataFrame, text_col: str = "text", wide: Callable[[bytes], str] = wide_hash) -> frozenset:
    """The hashes that texts of different canonical bytes share, by comparing the bytes inside equal hashes.

    Hashes of one row only are left out first, by a bit set of fixed size and then by a join. A task
    compares the copies that it meets itself and sends one of each, so a group of any size never meets
    in one place; what is sent is compared by its least and greatest value.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                yield pa.RecordBatch.from_arrays([pa.array([digest(t, wide=wide) for t in b.column(0).to_pylist()], pa.string())], names=["h"])

    texts = docs.select(F.col(text_col).alias("text"))
    shared = checkpointed(texts.mapInArrow(hashes, "h string").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[[_bit(h) for h in b.column(0).to_pylist()]] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at])], names=["at", "bits"])

    got = shared.mapInArrow(bits_of, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    bits = packed.view(np.uint8)

    def canons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, str] = {}
        size = 0
        for whole in batches:
            for b in chunks(whole):
                out = []
                for t in b.column(0).to_pylist():
                    h, canon = digest(t, wide=wide), canonical(t)
                    at = _bit(h)
                    if not bits[at >> 3] >> (7 - at % 8) & 1 or met.get(h) == canon:
                        continue
                    out.append((h, canon))
                    if size > MEMO_BYTES:
                        met.clear()
                        size = 0
                    met[h] = canon
                    size += len(canon)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["h", "canon"])

    told = texts.mapInArrow(canons, "h string, canon string").join(shared, "h", "left_semi")
    mixed = told.groupBy("h").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low <> high")
    found = mixed.select("h").limit(MAX_COLLISIONS + 1).collect()
    if len(found) > MAX_COLLISIONS:
        raise ValueError(f"over {MAX_COLLISIONS} hashes are shared by different texts; use a wider one")
    return frozenset(r["h"] for r in found)


def with_groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints with group_id, the least id of an equal fingerprint, and group_size.

    Only groups of two and more are tables to join. Those with over a thousandth of all such rows, a thousand at
    most, are broadcast, so that a large group stays dealt as it is; the others are joined by their fingerprint, which a
    row of a large group has a stand-in for.
    """
    groups = prints.groupBy("fingerprint").agg(F.min(id_col).alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    own, key, known, large_id, large_size, small_id, small_size = fresh(prints, "own", "key", "known", "large_id", "large_size", "small_id", "small_size")
    groups = checkpointed(groups)
    copies = groups.agg(F.sum("group_size")).first()[0] or 0
    large = groups.filter(F.col("group_size") * HOT_SHARE > copies).select(F.col("fingerprint").alias(own), F.col("group_id").alias(large_id), F.col("group_size").alias(large_size))
    small = groups.filter(F.col("group_size") * HOT_SHARE <= copies).select(F.col("fingerprint").alias(known), F.col("group_id").alias(small_id), F.col("group_size").alias(small_size))
    marked = prints.join(F.broadcast(large), F.col("fingerprint") == F.col(own), "left")  # HOT_SHARE rows
    marked = marked.withColumn(key, F.when(F.col(large_size).isNull(), F.col("fingerprint")).otherwise(F.concat(F.lit("#"), F.xxhash64(id_col))))
    out = marked.join(small, F.col(key) == F.col(known), "left")
    size = F.coalesce(large_size, small_size, F.lit(1).cast("bigint"))
    least = F.when(F.col(large_size).isNotNull(), F.col(large_id)).when(F.col(small_size).isNotNull(), F.col(small_id)).otherwise(F.col(id_col))
    return out.select(*map(quoted, prints.columns), least.alias("group_id"), size.alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: Callable[[bytes], str] = wide_hash) -> DataFrame:
    """id, fingerprint, group_id (the least id of its equal canonical texts) and group_size for each row.

    Null and repeated ids stay; a group of rows without ids has a null group_id. Other columns
    are left out; an empty table gives no rows.
    """
    return with_groups(fingerprints(docs, collisions(docs, text_col, wide), id_col, text_col, wide), id_col)


def with_next(docs: DataFrame, make: Callable[[list[tuple], list[tuple]], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Calls make(rows, next rows) for blocks of (id, text) in descending id order.

    The row after the last is the first. Null ids come last, equal ids in order of a hash of the
    text. Rows are dealt by ranges of (id, hash), as many as Spark's shuffles have partitions, so a
    repeated id is split too. Each range gives its first and its last row beside its results, and
    the last ones meet the first ones of the following ranges by a join.
    """
    low = -(2**63)
    kind = dict(docs.dtypes)[id_col]
    at = F.coalesce(F.col(id_col).cast("bigint"), F.lit(low))
    picked = docs.select(F.col(id_col).alias("id"), at.alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    order = [F.desc("at"), F.asc("th")]
    rows = picked.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = held = None

        def edge(which: str, row: tuple, like: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in like.schema), pa.array([which]), pa.array([part], pa.int64()), pa.array([row[0]], id_type), pa.array([row[1]], pa.string())], names=[*names, "edge", "part", "id", "text"])

        for whole in batches:
            for b in chunks(whole):
                id_type = b.schema.field(0).type
                now = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                first = first or now[0]
                line = ([held] if held else []) + now
                held = line[-1]
                if len(line) > 1:
                    made = make(line[:-1], line[1:])
                    n = made.num_rows
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.string())], names=[*names, "edge", "part", "id", "text"])
        if first:
            like = make([first], [first])
            yield edge("first", first, like)
            yield edge("last", held, like)

    done = materialise(rows.mapInArrow(run, f"{schema}, edge string, part bigint, id {kind}, text string"), "next")
    edges = done.filter("edge is not null")
    # One number for each range: the following one, round the ring.
    parts = edges.filter("edge = 'first'").select("part")
    after = parts.withColumn("after", F.lead("part").over(Window.orderBy("part")))
    after = after.crossJoin(F.broadcast(parts.agg(F.min("part").alias("start")))).select("part", F.coalesce("after", "start").alias("after"))  # one row
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("after"), F.col("id").alias("next_id"), F.col("text").alias("next_text"))
    met = edges.filter("edge = 'last'").select("part", "id", "text").join(after, "part").join(firsts, "after").select("id", "text", "next_id", "next_text")

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = [x.to_pylist() for x in b.columns]
                yield make(list(zip(c[0], c[1])), list(zip(c[2], c[3])))

    return done.filter("edge is null").select(*names).unionByName(met.mapInArrow(bridge, schema))
