"""Packing of token pieces into fixed sequences by cutting-stock column generation.

1. Encode every document once, in tasks; cut whole sequences off and leave one remainder.
2. Count remainders by length class (at most capacity / width classes: a bounded histogram).
3. On the driver, solve the linear program over patterns of classes; a knapsack dynamic
   program prices new patterns. Round the solution down; the few classes left over, a number
   that depends on the classes and not on the documents, are packed first-fit-decreasing.
4. In tasks, rank the pieces of each class and look each rank up in the rounded patterns.
"""

from __future__ import annotations

import os
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import chunks

CAPACITY = 4096
WIDTH = 8
END_ID = 2
CHUNK = 1 << 19  # bytes of text encoded at a time
MEMO_WORDS = 200_000
MARKS = r"([!-&(-/:-@\[-`{-~]+)"
#: ASCII without white space, controls and the apostrophe; Latin letters but the dotted capital I.
PLAIN = r"^[!-&(-~\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{2af}]*$"
SALT_ROWS = 20_000  # rows that one window numbers
_LOADED: dict[str, tuple] = {}


def _load(path: str) -> tuple:
    """The tokenizer, the memo of parts, and which ids end a pre-token."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        last = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])
        _LOADED[path] = (tokenizer, {"": b""}, last)
    return _LOADED[path]


def _cut(words: pa.Array) -> pa.Array:
    """The parts, at single spaces, that this tokenizer encodes each for itself: runs of marks, and what is between.

    In a word of ASCII and Latin letters these never merge, and case does not matter, but for
    apostrophes and special strings. All other words stay whole.
    """
    plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
    return pc.if_else(plain, pc.ascii_lower(pc.replace_substring_regex(words, MARKS, r" \1 ")), words)


def _gather(pool: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool that codes name, one after the other, and the n + 1 ends of what they give."""
    starts = ends[codes]
    n = ends[codes + 1] - starts
    out = np.concatenate([[0], n.cumsum()])
    return pool[np.arange(out[-1]) + np.repeat(starts - out[:-1], n)], out


def _stretches(text: str, size: int) -> Iterator[str]:
    """A long text in stretches of about `size`, cut at single spaces, over which no ids merge."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + size)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to + 1


def encoder(path: str):
    """A function from an array of texts to the ids of all and the n + 1 offsets of the texts into them.

    This tokenizer drops white space and never merges over it, so a text's ids are those of its
    words in order, and a word's those of its parts. Both recur: distinct words are found and cut
    by Arrow, each worker encodes only new parts, many in a call, and keeps a bounded memo.
    """
    tokenizer, memo, last = _load(path)

    def learn(parts: list[str]) -> None:
        simple = [p.isalpha() and p.islower() and max(p) < "\u02b0" for p in parts]
        # Lower-case Latin words are one pre-token each, so spaces keep them apart.
        words = [p for p, yes in zip(parts, simple) if yes]
        rest = [p for p, yes in zip(parts, simple) if not yes]
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                keep(some, ids, ends)
            else:
                rest += some
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            keep(some, np.array(found.ids, dtype="<u4"), np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some)).cumsum())

    def keep(parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, to = ids.tobytes(), (4 * ends).tolist()
        memo.update(zip(parts, [raw[a:b] for a, b in zip([0, *to], to)]))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        parts = pc.split_pattern(_cut(coded.dictionary), " ")
        of_parts = parts.flatten().dictionary_encode()
        names = of_parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(memo) > MEMO_WORDS:
            memo.clear()
            memo[""] = b""
        learn([p for p in names if p not in memo])
        got = [memo[p] for p in names]
        ends = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got], dtype=np.int64)])
        pool, ends = _gather(np.frombuffer(b"".join(got), "<u4"), ends, of_parts.indices.to_numpy())
        pool, ends = _gather(pool, ends[parts.offsets.to_numpy()], coded.indices.to_numpy())
        return pool, ends[words.offsets.to_numpy()]

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole sequences and one remainder of each document: id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for whole in batches:
            for b in chunks(whole, size=CHUNK):
                if b.num_rows == 1 and b.column(1).is_valid()[0].as_py() and len(text := b.column(1)[0].as_py()) > CHUNK:
                    ids = np.concatenate([encode(pa.array([t]))[0] for t in _stretches(text, CHUNK)])
                    ends = np.array([0, len(ids)])
                else:
                    ids, ends = encode(b.column(1))
                rows: list[tuple] = []
                for row, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    raw = ids[a:z].tobytes() + end
                    n = z - a + 1
                    rows += [(row, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                at, start, length, crc, n = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), start, length, crc, n], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            worth = best[c - sizes[:fits]] + values[:fits]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], taken[c] = worth[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each.

    Revised simplex; the first basis has one pattern of a single class for each class. Any basis
    is feasible, so a stop after `rounds` still gives whole patterns.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for turns in range(rounds + 1):
        if turns == rounds:
            warnings.warn(f"packing patterns are not the best yet after {rounds} rounds; padding may be higher", stacklevel=2)
            break
        value, pattern = price(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        turn = inverse @ pattern
        up = turn > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, turn, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * turn
        x[out] = step
        basis[:, out] = pattern
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
    return basis.T.astype(np.int64), np.maximum(x, 0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (class, first rank, ranks, first sequence, pieces a sequence) and the number of sequences.

    A class k holds the lengths from (k - 1) * width + 1 to k * width.
    """
    classes = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(classes):
        return [], 0
    demand = np.array([histogram[int(k)] for k in classes], dtype=np.int64)
    patterns, used = column_generation(classes, demand.astype(float), capacity // width)
    ranks, left, segments, sequence = np.zeros(len(classes), np.int64), demand.copy(), [], 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for k in np.flatnonzero(pattern):
            segments.append((int(classes[k]), int(ranks[k]), int(pattern[k] * times), sequence, int(pattern[k])))
        ranks[:] += pattern * times
        left[:] -= pattern * times
        sequence += times

    for pattern, n in sorted(zip(patterns, np.floor(used + 1e-9).astype(np.int64)), key=lambda p: -p[1]):
        some = pattern > 0
        if n and some.any():
            n = min(int(n), int((left[some] // pattern[some]).min()))
            if n:
                use(pattern, n)
    while left.any():  # first-fit-decreasing over classes, equal sequences at once
        room, pattern = capacity // width, np.zeros(len(classes), np.int64)
        for k in range(len(classes) - 1, -1, -1):
            pattern[k] = min(left[k], room // classes[k])
            room -= pattern[k] * classes[k]
        some = pattern > 0
        use(pattern, int((left[some] // pattern[some]).min()))
    return segments, sequence


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Rows with null or repeated ids are packed each for
    itself. Other columns are left out. An empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    whole, rest = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    rest = rest.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    # At most capacity / width classes; each is numbered in one window for every SALT_ROWS rows.
    histogram = {r[0]: r[1] for r in rest.groupBy("class").count().collect()}
    salts = docs.sparkSession.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in histogram.items()], "class int, salts int")
    rest = rest.join(F.broadcast(salts), "class").withColumn("salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    counts = rest.groupBy("class", "salt").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    segments, n_sequences = plan(histogram, capacity, width)

    within = Window.partitionBy("class", "salt").orderBy(id_col, "start", "ids_crc32")
    ranked = rest.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(counts.select("class", "salt", F.coalesce("before", F.lit(0)).alias("before"))), ["class", "salt"])
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("rank") + F.col("before")).alias("rank"))

    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 40) + table[:, 1]
        for b in batches:
            k, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
            found = table[np.searchsorted(keys, k * (1 << 40) + rank, "right") - 1] if len(k) else table[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found[:, 3] + (rank - found[:, 1]) // np.maximum(found[:, 4], 1), pa.int64())], names=[*b.schema.names[:5], "sequence_id"])

    kind = dict(cut.dtypes)[id_col]
    placed = ranked.mapInArrow(look_up, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint")
    # A sequence holds at most `capacity` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # Whole sequences get ids after the others: numbered inside salts, then shifted by the salts before.
    whole = whole.withColumn("salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(max(1, -(-whole.count() // SALT_ROWS)))).cast("int"))
    shift = whole.groupBy("salt").count().withColumn("before", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    whole = whole.withColumn("rank", F.row_number().over(Window.partitionBy("salt").orderBy(id_col, "start", "ids_crc32")) - 1)
    whole = whole.join(F.broadcast(shift.select("salt", F.coalesce("before", F.lit(0)).alias("before"))), "salt")
    whole = whole.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.lit(n_sequences) + F.col("rank") + F.col("before")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(whole)
