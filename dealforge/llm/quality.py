"""Quality classifier: logistic regression on hashed word n-grams, FTRL-proximal updates.

Features of a text are its words and word pairs, case folded, and the same over word shapes
(kinds of characters, last mark, length), hashed into SIZE buckets; each of the two blocks has
unit length. Training is parameter mixing: a few tasks run the updates over their share of a
bounded sample of labelled rows, and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import SPACES, buffers, chunks, mix, run_hashes, span_hashes, words

BITS = 18
SIZE = 1 << BITS
#: Bound of the training sample, and of the rows that one task runs over.
MAX_SAMPLE, TASK_ROWS = 12_000, 3_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1e-3, 1e-4, 3
BIAS = SIZE
_KIND = np.full(256, 8, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text; the last bucket is the bias."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets, SPACES)
    if len(starts):
        lexical = span_hashes(data, starts, ends)
        kinds = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64)
        last = np.where(_KIND[data[ends - 1]] == 8, data[ends - 1], 0).astype(np.uint64)
        length = np.minimum(np.log2(ends - starts + 1), 7).astype(np.uint64)
        shape = mix(kinds | last << np.uint64(8) | length << np.uint64(16) | _KIND[data[starts]].astype(np.uint64) << np.uint64(24))
    else:
        lexical = shape = np.empty(0, np.uint64)
    shift = np.uint64(64 - BITS)
    blocks = [[(h >> shift).astype(np.int64), (run_hashes(h + np.uint64(s), 2) >> shift).astype(np.int64)] for s, h in ((1, lexical), (2, shape))]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        buckets, values = [np.array([BIAS])], [np.ones(1)]
        for one, two in blocks:
            found, n = np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]]), return_counts=True)
            if len(found):
                x = np.log1p(n)
                buckets.append(found)
                values.append(x / np.sqrt((x * x).sum()))
        yield np.concatenate(buckets), np.concatenate(values)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


class Ftrl:
    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(labelled: DataFrame) -> np.ndarray:
    """labelled: (id, text, label 0/1), at most about MAX_SAMPLE rows. SIZE + 1 weights."""
    n = labelled.select("id").count()
    parts = max(1, round(n / TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for whole in batches:
            for b in chunks(whole):
                rows += [(x, y) for x, y in zip(features(b.column(0)), b.column(1).to_pylist())]
        model = Ftrl()
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(*rows[i][0], rows[i][1])
        if rows:
            w = model.weights(slice(None)).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([len(rows)], pa.int64())], names=["w", "n"])

    spread = labelled.repartition(parts, "id").sortWithinPartitions("id", "text").select("text", F.col("label").cast("int").alias("label"))
    got = spread.mapInArrow(run, "w binary, n bigint").collect()  # parts rows
    if not got:
        return np.zeros(SIZE + 1, np.float32)
    return (sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * r["n"] for r in got) / sum(r["n"] for r in got)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, text, label) of labelled rows where `fold` holds: about MAX_SAMPLE, and twice that at most.

    Labels are thinned by a hash of the id, so that few ids are broadcast. Where ids repeat in docs, the rows are thinned
    again, by a hash of id and text, and rows equal in both are cut in the order of that hash.
    """
    known = labels.filter(fold & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    share = min(1.0, MAX_SAMPLE / max(1, known.select("id").distinct().count()))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_003)) < share * 1_000_003)
    chosen = F.broadcast(chosen.groupBy("id").agg(F.max("label").alias("label")))  # about MAX_SAMPLE ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    n = docs.select(F.col(id_col).alias("id")).join(chosen, "id").count()  # reads ids only
    if n <= 2 * MAX_SAMPLE:
        return rows
    place = F.xxhash64("id", "text", F.lit(29))
    return rows.filter(F.pmod(place, F.lit(1_000_003)) < MAX_SAMPLE / n * 1_000_003).orderBy(place, "id", "text").limit(2 * MAX_SAMPLE)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: the probability of label 1.

    Null and empty texts have the bias alone. With no labelled rows every score is 0.5. Rows with
    null or repeated ids stay; other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                found = [_sigmoid(float(weights[at] @ x)) for at, x in features(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, score double")
