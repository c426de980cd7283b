"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns, known by two 64-bit hashes, each the exclusive or of one hash
for every turn and its place. Of each node's children the one with most conversations is heavy, so a
path from the root has a light edge at most log2(conversations) times. Heads of heavy paths are found by
doubling pointers, path totals climb to the parents' paths in rounds of light edges, and sums over
subtrees are suffix sums along the paths. Every step is a join on unique keys, a sum with partial sums,
or a window that runs along one path; no path, group of children or list of members is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

NODE = ["a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()
CHUNK_IDS = 4096


def ordered_turns(chats: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text: turns by turn number (null first), then role and text.

    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    """
    rows = chats.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def borrowed(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation c - c % every.

    h is crc32(c as text) % most. A turn of a shared start meets at most 2 * every conversations. pos
    keeps its order; a conversation may be left without any turn.
    """
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.filter(F.col("pos") > h)
    starts = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "start_id")
    asked = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("start_id")).filter("h > 0")
    return own.unionByName(asked.join(starts, "start_id").filter("pos <= h").select(*turns.columns))


def _hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in zip((1, 2), NODE)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the node), pa, pb (its parent; 0, 0 is the root), chars, last."""
    said = turns.select("conv_id", "pos", F.char_length("text").alias("chars"), F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"))
    order = Window.partitionBy("conv_id").orderBy("pos")
    rows = said.withColumn("depth", F.row_number().over(order))
    one = rows.select("conv_id", "depth", "chars", *_hashes(F.col("depth"), F.col("x"), F.col("y")))
    order = Window.partitionBy("conv_id").orderBy("depth")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = one.select("conv_id", "depth", "chars", *[F.bit_xor(k).over(until).alias(k) for k in NODE], F.lead("depth").over(order).isNull().alias("last"))
    return rows.select("*", *[F.coalesce(F.lag(k).over(order), F.lit(0).cast("bigint")).alias("p" + k) for k in NODE])


def _heads(nodes: DataFrame) -> DataFrame:
    """(a, b, ha, hb): each node with the head of its heavy path, by doubling pointers until all stand at heads."""
    light = nodes.filter("not heavy").select(*NODE, *[F.col(k).alias("h" + k) for k in NODE])
    state = materialise(nodes.filter("heavy").select(*NODE, *[F.col("p" + k).alias("h" + k) for k in NODE], F.lit(False).alias("there")).unionByName(light.withColumn("there", F.lit(True))), "heads")
    while True:
        going = state.filter("not there")
        if going.isEmpty():
            return state.drop("there")
        to = state.select(*[F.col(k).alias("h" + k) for k in NODE], *[F.col("h" + k).alias("n" + k) for k in NODE], F.col("there").alias("found"))
        moved = going.drop("there").join(to, ["ha", "hb"]).select(*NODE, F.col("na").alias("ha"), F.col("nb").alias("hb"), F.col("found").alias("there"))
        state = materialise(state.filter("there").unionByName(moved), "heads")


def _path_totals(paths: DataFrame, sums: list[str]) -> DataFrame:
    """(ha, hb, sums): each path's own sums and those of all paths below it. paths: ha, hb, up_a, up_b, sums."""
    up = paths.select("ha", "hb", "up_a", "up_b")
    found = now = paths
    while True:
        climbed = now.filter("up_a is not null").groupBy(F.col("up_a").alias("ha"), F.col("up_b").alias("hb")).agg(*[F.sum(s).alias(s) for s in sums])
        now = materialise(climbed.join(up, ["ha", "hb"]), "climbing")
        if now.isEmpty():
            return found.groupBy("ha", "hb").agg(*[F.sum(s).alias(s) for s in sums])
        found = found.unionByName(now)


def _digests(ends: DataFrame, most: int) -> DataFrame:
    """(a, b, ends_sha256) of the members that end at a node, ascending and joined by commas.

    Lists of more than `most` are laid out in order by ranges, in chunks of text that one stream hashes.
    """
    sizes = ends.groupBy(*NODE).agg(F.count("*").alias("n_ends"))
    rows = ends.join(sizes, NODE)
    few = rows.filter(F.col("n_ends") <= most).groupBy(*NODE).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ","), 256).alias("ends_sha256"))
    many = rows.filter(F.col("n_ends") > most).select(*NODE, F.col("conv_id").cast("bigint").alias("conv_id"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        out = lambda: pa.RecordBatch.from_pylist([{"a": at[0], "b": at[1], "first": held[0], "ids": ",".join(map(str, held))}], schema=kind)
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            for a, b, c in zip(*(col.to_pylist() for col in batch.columns)):
                if held and (at != (a, b) or len(held) == CHUNK_IDS):
                    yield out()
                    held = []
                at = (a, b)
                held.append(c)
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        digest, at = None, None
        for batch in batches:
            for a, b, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if at == (a, b):
                    digest.update(b",")
                else:
                    if digest:
                        yield pa.RecordBatch.from_pylist([{"a": at[0], "b": at[1], "ends_sha256": digest.hexdigest()}], schema=kind)
                    digest, at = hashlib.sha256(), (a, b)
                digest.update(ids.encode())
        if digest:
            yield pa.RecordBatch.from_pylist([{"a": at[0], "b": at[1], "ends_sha256": digest.hexdigest()}], schema=kind)

    laid = many.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    text = laid.mapInArrow(chunked, "a bigint, b bigint, first bigint, ids string")
    long = text.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a bigint, b bigint, ends_sha256 string")
    return few.unionByName(long)


def prefix_trie(ids: DataFrame, turns: DataFrame, most_ends: int = 10_000) -> DataFrame:
    """One row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ids: conv_id, distinct and not null, with conversations without turns; turns: conv_id, pos, role, text (not
    null), other columns are not read. Without any conversation there is no node, not even the root. Turns
    equal in pos are told apart by nothing, so give them distinct ones (ordered_turns()).
    """
    rows = materialise(_prefixes(turns), "prefixes")
    zero = F.lit(0).cast("bigint")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("bigint").alias("pa"), F.lit(None).cast("bigint").alias("pb"), "n_convs", "conv_id", F.lit(0).alias("chars"))
    made = rows.groupBy("depth", *NODE, "pa", "pb").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"))
    made = materialise(made.unionByName(root), "nodes")
    kids = made.filter("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", *NODE)).alias("h"))
    kids = materialise(kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children", F.col("h.a").alias("ca"), F.col("h.b").alias("cb")), "children")
    heavy = kids.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.lit(True).alias("heavy"))
    nodes = made.join(kids.select(*NODE, "n_children"), NODE, "left").join(heavy, NODE, "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "heavy": F.coalesce("heavy", F.lit(False))})
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = materialise(nodes, "weighted")
    nodes = materialise(nodes.join(_heads(nodes), NODE), "placed")
    sums = ["n_leaves", "saved"]
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("ha").alias("up_a"), F.col("hb").alias("up_b"), F.col("conv_id").alias("parent"))
    heads = nodes.filter("not heavy").select(F.col("a").alias("ha"), F.col("b").alias("hb"), "pa", "pb").join(above, ["pa", "pb"], "left")
    heads = materialise(heads, "edges")
    own = nodes.groupBy("ha", "hb").agg(*[F.sum(s).alias(s) for s in sums])
    paths = materialise(heads.select("ha", "hb", "up_a", "up_b").join(own, ["ha", "hb"]), "paths")
    hung = heads.join(_path_totals(paths, sums), ["ha", "hb"]).filter("pa is not null")
    hung = hung.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*[F.sum(s).alias("hung_" + s) for s in sums])
    path = Window.partitionBy("ha", "hb")
    below = path.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.join(hung, NODE, "left").join(heads.select(F.col("ha").alias("a"), F.col("hb").alias("b"), "parent"), NODE, "left")
    out = out.join(_digests(rows.filter("last").select(*NODE, "conv_id").unionByName(ids.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").select(zero.alias("a"), zero.alias("b"), "conv_id")), most_ends), NODE, "left")
    return out.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent", F.lag("conv_id").over(path.orderBy("depth"))).alias("parent_conv_id"), "n_convs", "n_children",
        F.sum(F.col("n_leaves") + F.coalesce("hung_n_leaves", zero)).over(below).alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("hung_saved", zero)).over(below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
