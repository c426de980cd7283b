"""Exact Jaccard self-join of shingle sets, size-aware (light sets, heavy sets).

Sets are reduced to classes of equal sets. Light sets, at most `boundary` shingles, enumerate
the fixed-size subsets that a linked pair must share. Heavy sets are found on inverted lists:
of a pair with similarity t each side has one of the shared shingles among its first
n - ceil(t n) + 1, in any one order of all shingles, so only these are listed. The order puts
frequent shingles last. The boundary is chosen from the histogram of sizes by counted cost.

Lists of one class are dropped at once. Long lists are not expanded into pairs: each list first
links its members to one of them; what is verified becomes components, and only members of
different components are compared afterwards. All candidates are verified on whole sets.

Shingles are 64-bit hashes; a pair is judged wrongly only if two of its own shingles collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, materialise, shuffles_dropped
from .components import components
from .textkernel import buffers, chunks, mix, run_hashes, shingle_sets

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
MAX_FREQUENT = 1 << 19  # shingles sent to every task, 8 bytes each
WINDOW = 1 << 21  # shingles that a task counts at a time
FREQUENT = 48
FILTER_BITS = 1 << 24  # 2 MB, whatever the input
MAX_LIGHT = 12
CELLS = 64  # steps of the common order at which a set's shingles are counted
STEP = 62 - 6  # its bits below a cell's number
BEFORE = 16  # list entries before its own that a list entry carries


def needed(a: int, b: int) -> int:
    """The least overlap with which sets of a and b shingles link: i / (a + b - i) >= t."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The overlaps that a set of n needs with light partners of each possible size."""
    return sorted({k for b in range(1, boundary + 1) if (k := needed(n, b)) <= min(n, b)})


def boundary_by_cost(histogram: dict[int, int]) -> int:
    """The greatest light size, from the number of classes of each size up to MAX_LIGHT.

    A light set costs its subsets, a heavy one its list entries and their verification, taken as
    its size once. A light set within reach of a heavy one is listed as well.
    """

    def cost(limit: int) -> float:
        total = 0.0
        for n, times in histogram.items():
            if n <= limit:
                total += times * sum(comb(n, k) for k in subset_sizes(n, limit))
            if n > limit or DENOMINATOR * n >= NUMERATOR * (limit + 1):
                total += times * (prefix_length(n) + n)
        return total

    return min(range(MAX_LIGHT + 1), key=cost)


def _digest(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(found.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (id, n, d1, d2), and rows of shingles that a window holds in two classes or more (h, n)."""
    held: list[np.ndarray] = []
    classes: set[int] = set()

    def frequent(id_type: pa.DataType) -> pa.RecordBatch:
        found = np.concatenate(held)
        held.clear()
        classes.clear()
        found.sort()
        found, again = np.unique(found[1:][found[1:] == found[:-1]], return_counts=True)
        m = len(found)
        return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.array(again + 1, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(found.view(np.int64))], names=["id", "n", "d1", "d2", "h"])

    size = 0
    for whole in batches:
        for b in chunks(whole):
            n, d1, d2 = [], [], []
            for found in shingle_sets(*buffers(b.column(1)), SHINGLE):
                hi, lo = _digest(found) if len(found) else (0, 0)
                n.append(len(found))
                d1.append(hi)
                d2.append(lo)
                if len(found) and lo not in classes:
                    classes.add(lo)
                    held.append(found)
                    size += len(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(len(n), pa.int64())], names=["id", "n", "d1", "d2", "h"])
            if size > WINDOW:
                yield frequent(b.schema.field(0).type)
                size = 0
            last = b.schema.field(0).type
    if held:
        yield frequent(last)


GRID = pa.list_(pa.int32())


def _lister(frequent: np.ndarray, boundary: int):
    """Rows (h, d2): the list entries and light subsets of each class that a task meets.

    One more row of a class, (d2, d2, end, grid), tells where its prefix ends in the common order,
    and how many of its shingles are in each of the cells up to there, and before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in chunks(whole):
                keys, owners, ended, ends, grids = [], [], [], [], []
                for found in shingle_sets(*buffers(b.column(0)), SHINGLE):
                    n = len(found)
                    if not n:
                        continue
                    owner = _digest(found)[1]
                    if owner in seen:  # a copy; a group of copies is combined here, before the shuffle
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(owner)
                    if n > boundary or DENOMINATOR * n >= NUMERATOR * (boundary + 1):
                        p = prefix_length(n)
                        if len(frequent):
                            common = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
                            rare = found[~common]
                            listed = np.concatenate([rare, found[common]])[:p]
                        else:
                            rare, listed = found, found[:p]
                        keys.append(listed)
                        owners.append(np.full(len(listed), owner, np.int64))
                        ended.append(owner)
                        ends.append((int(listed[-1]) >> 2) + ((1 << 62) if p > len(rare) else 0))
                        steps = np.arange(1, min(CELLS, ends[-1] >> STEP) + 1, dtype=np.uint64) << np.uint64(STEP)
                        grids.append(np.searchsorted(rare >> np.uint64(2), steps, "right").tolist())
                    if n <= boundary:
                        subsets = [run_hashes(np.array(s, np.uint64) ^ np.uint64(0x5BD1E995), len(s))[0] for k in subset_sizes(n, boundary) for s in combinations(found.tolist(), k)]
                        keys.append(np.array(subsets, np.uint64))
                        owners.append(np.full(len(subsets), owner, np.int64))
                if keys:
                    h, d = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), GRID)], names=["h", "d2", "end", "grid"])
                if ended:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ended, ended, ends)), pa.array(grids, GRID)], names=["h", "d2", "end", "grid"])

    return run


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, d2): distinct rows of the lists that hold two classes at least.

    Only the last row of a batch and whether its list was already sent are carried over. Rows
    that tell a prefix's end pass through.
    """
    last: tuple[int, int] | None = None
    sent = False
    for b in batches:
        told = b.filter(b.column(2).is_valid())
        if told.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(told.num_rows, pa.int64()), *told.columns[1:]], names=["h", "d2", "end", "grid"])
        b = b.filter(b.column(2).is_null())
        h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        if last is not None:
            h, d = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], d])
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first_sent = sent  # whether row 0 is out already
        h, d = h[new], d[new]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and h[0] == last[0] and first_sent:
            keep[0] = False
            tail_sent = bool(keep[-1]) or len(h) == 1
        else:
            tail_sent = bool(keep[-1])
        last, sent = (int(h[-1]), int(d[-1])), tail_sent
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(d[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.nulls(int(keep.sum()), GRID)], names=["h", "d2", "end", "grid"])


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit set of hashed ids: at most FILTER_BITS bits, combined by tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = _bits(b.column(0).to_numpy())
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = packed.view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at])], names=["at", "bits"])

    got = ids.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return packed.view(np.uint8)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def _sets_of(picked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, s) of the wanted ids. A bit set spares most other texts; the join makes it exact."""
    bits = _filter_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = _bits(whole.column(0).to_numpy(zero_copy_only=False))
            whole = whole.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for b in chunks(whole):
                sets = list(shingle_sets(*buffers(b.column(1)), SHINGLE))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets).view(np.int64) if len(sets) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["id", "n", "s"])

    found = picked.filter("id is not null").mapInArrow(run, "id bigint, n bigint, s array<bigint>")
    return found.join(wanted, "id", "left_semi")


def _needed(a, b):
    return F.ceil(NUMERATOR * (a + b) / (NUMERATOR + DENOMINATOR))


def _least_shared(x: dict, y: dict, boundary: int):
    """How many list entries sets x and y (columns n, end, grid) share at least if they link.

    Of the two prefixes one ends first in the common order. What the sets share up to there is in
    both prefixes, so in lists of both. Beyond it each has its other shingles: all but its prefix if
    its own ends there, else all but those it has in the cells before.
    """
    a, b = x["n"], y["n"]
    cell = F.least(F.shiftright(F.least(x["end"], y["end"]), STEP), F.lit(CELLS)).cast("int")

    def beyond(own: dict, other: dict):
        prefix = own["n"] - F.ceil(NUMERATOR * own["n"] / DENOMINATOR) + 1
        return own["n"] - F.when(own["end"] <= other["end"], prefix).otherwise(F.coalesce(F.get(own["grid"], cell - 1), F.lit(0)))

    light = F.greatest(a, b) <= boundary  # one shared subset is enough
    return F.when(light, 1).otherwise(F.greatest(F.lit(1), _needed(a, b) - F.least(beyond(x, y), beyond(y, x))))


def _side(prefix: str = "", suffix: str = "") -> dict:
    return {c: F.col(f"{prefix}{c}{suffix}") for c in ("n", "end", "grid")}


def _likely(pairs: DataFrame, listed: DataFrame, boundary: int) -> DataFrame:
    """Of pairs (u, v) those that share enough list entries to link.

    16 bits of each entry are moved. Entries of a set that agree in these may be shared and are
    counted once, so their number is added: no pair is lost by it.
    """
    short = F.array_distinct(F.transform("hs", lambda h: (h.bitwiseAND(F.lit(65535)) - 32768).cast("smallint")))
    slim = listed.select("id", "n", "end", "grid", F.size("hs").alias("m"), short.alias("hs"))
    left, right = (slim.select(F.col("id").alias(x), *[F.col(c).alias(c + x) for c in ("n", "end", "grid", "m", "hs")]) for x in "uv")
    both = pairs.join(right, "v").join(left, "u")
    twice = F.least(F.col("mu") - F.size("hsu"), F.col("mv") - F.size("hsv"))
    least = _least_shared(_side(suffix="u"), _side(suffix="v"), boundary)
    return both.filter(F.size(F.array_intersect("hsu", "hsv")) + twice >= least).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) those that link."""
    left = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"))
    both = pairs.join(right, "v").join(left, "u")
    overlap = F.size(F.array_intersect("su", "sv"))
    return both.filter((NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (F.col("nu") + F.col("nv"))).select("u", "v")


def _rarest_lists(sets: DataFrame) -> DataFrame:
    """(h, id, n, most, place, before): list entries in the exact order of rarity among these sets.

    most: how many shingles of a set another one has. Shingles of one set only come first and
    make no list, so a prefix may be used up by them. before: the last BEFORE entries of the same
    set; where two sets share one of these, the pair has met already.
    """
    tokens = sets.select("id", "n", F.explode("s").alias("h")).withColumn("c", F.count("*").over(Window.partitionBy("h"))).filter("c > 1")
    own = Window.partitionBy("id", "n")
    rarest = own.orderBy("c", "h")
    ranked = tokens.withColumn("most", F.count("*").over(own)).withColumn("rank", F.row_number().over(rarest)).withColumn("before", F.collect_list("h").over(rarest.rowsBetween(-BEFORE, -1)))
    ranked = ranked.withColumn("place", F.col("n") - F.col("most") + F.col("rank"))
    return ranked.filter(F.col("place") <= F.col("n") + 1 - F.ceil(NUMERATOR * F.col("n") / DENOMINATOR)).select("h", "id", "n", "most", "place", "before")


def _class_components(picked: DataFrame, seen: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that link with another, by their least ids; a written table."""
    steps = Steps(picked.sparkSession)
    # Bounds: MAX_LIGHT rows; at most total / threshold <= MAX_FREQUENT shingles.
    histogram = {r[0]: r[1] for r in classes.filter(F.col("n") <= MAX_LIGHT * DENOMINATOR // NUMERATOR + 1).groupBy("n").count().collect()}
    boundary = boundary_by_cost(histogram)
    total = classes.agg(F.sum("n")).first()[0] or 0
    threshold = max(FREQUENT, -(-total // MAX_FREQUENT))
    often = seen.filter("h is not null").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold).select("h").toArrow()
    frequent = np.sort(often.column("h").to_numpy().view(np.uint64)) if often.num_rows else np.empty(0, np.uint64)

    kinds = "h bigint, d2 bigint, end bigint, grid array<int>"
    entries = picked.select("text").mapInArrow(_lister(frequent, boundary), kinds)
    lists = entries.repartition(F.col("h")).sortWithinPartitions("h", "d2").mapInArrow(_shared_lists, kinds)
    reps = classes.filter("rep is not null").select("d2", F.col("rep").alias("id"), "n")
    # A light set that is not listed has no prefix and links with light ones only.
    prefix = [F.coalesce(F.max("end"), F.lit(0)).alias("end"), F.max("grid").alias("grid")]
    listed = lists.join(reps, "d2").groupBy("d2", "id", "n").agg(F.collect_set("h").alias("hs"), *prefix).filter(F.size("hs") > 0)
    listed = steps.keep("listed", listed.drop("d2"))
    lists = listed.select("id", "n", "end", "grid", F.size("hs").alias("shared"), F.explode("hs").alias("h"))

    # Each list to the member that may overlap most of itself.
    most = F.when(F.col("n") <= boundary, F.col("n")).otherwise(F.least("n", F.ceil(NUMERATOR * F.col("n") / DENOMINATOR) - 1 + F.col("shared")))
    hubs = lists.groupBy("h").agg(F.min(F.struct(-most / F.col("n"), "id", "n", "end", "grid", "shared")).alias("hub")).select("h", *[F.col(f"hub.{c}").alias(f"{c}_u") for c in ("id", "n", "end", "grid", "shared")])
    enough = _least_shared(_side(), _side(suffix="_u"), boundary) <= F.least("shared", "shared_u")
    stars = lists.join(hubs, "h").filter((F.col("id") != F.col("id_u")) & enough).select(F.col("id_u").alias("u"), F.col("id").alias("v")).distinct()
    likely = steps.keep("likely", _likely(stars, listed, boundary))
    links = steps.keep("links", _verified(likely, _sets_of(picked, _ids(likely))))
    steps.drop("likely")
    parts = components(links)

    # Then members of different components, in lists that have them.
    labelled = listed.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = labelled.select("id", "n", "end", "grid", "component", F.size("hs").alias("shared"), F.explode("hs").alias("h"))
    open_lists = labelled.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("h")
    rest = steps.keep("open", labelled.join(open_lists, "h", "left_semi"))

    def meet(how: str) -> DataFrame:
        a, b = rest.alias("a"), rest.alias("b")
        t = _needed(F.col("a.n"), F.col("b.n"))
        if "place" not in rest.columns:
            fits = _least_shared(_side("a."), _side("b."), boundary) <= F.least("a.shared", "b.shared")
        else:  # one of the shared shingles is as early as this in both
            fits = (t <= F.least("a.most", "b.most")) & (F.col("a.place") <= F.col("a.n") - t + 1) & (F.col("b.place") <= F.col("b.n") - t + 1)
            # The first shared entry is the earliest in both, so no pair is lost by this.
            fits &= ~F.arrays_overlap("a.before", "b.before")
        order = F.col("a.id") < F.col("b.id") if how == "inner" else F.col("a.id") != F.col("b.id")
        return a.join(b, (F.col("a.h") == F.col("b.h")) & order & (F.col("a.component") != F.col("b.component")) & fits, how)

    # Sets that have a partner left are few: over these the lists are made anew from whole sets.
    active = steps.keep("active", meet("left_semi").select("a.id").distinct())
    sets = steps.keep("sets", _sets_of(picked, active))
    rest = steps.keep("rest", _rarest_lists(sets).join(rest.select("id", "component").distinct(), "id"))
    steps.drop("open", "active")
    pairs = meet("inner").select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    more = _verified(steps.keep("likely", _likely(pairs, listed, boundary)), sets)
    steps.drop("rest", "listed")
    final = components(links.unionByName(more))
    steps.drop("links", "sets", "likely")
    return final


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id.

    A null text, or one without words, has no shingles and is linked with nothing; its component
    is its own id. Rows that repeat an id are one node of the graph with several texts. A row
    without an id takes the component of the ids with an equal set, else null. Other columns are
    left out; an empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    with shuffles_dropped(docs.sparkSession):
        seen = materialise(picked.mapInArrow(_signatures, "id bigint, n bigint, d1 bigint, d2 bigint, h bigint"), "signatures")
        rows = seen.filter("h is null").drop("h")
        classes = materialise(rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
        final = _class_components(picked, seen, classes)
    final = final.select(F.col("node").alias("rep"), "component")
    named = classes.join(final, "rep", "left").select("d1", "d2", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, (rows.d1 == named.d1) & (rows.d2 == named.d2) & (rows.n == named.size), "left")
    return out.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
