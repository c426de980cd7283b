"""Language identification by nearest centroid.

Texts are vectors of hashed byte trigrams around letters, sublinear counts times idf, unit
length. Each language has a few centroids, clustered by cosine on a bounded sample; a text gets
the language of the nearest one. A text farther from it than
the bound of that language, a low quantile of held-out prose, is rejected. A short text holds few
trigrams and is far from any centroid, so its bound is that of prose thinned to as few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .textkernel import FOLD, buffers, chunks

BITS = 12
SIZE = 1 << BITS
#: Bound of the training sample: so many rows of each language, and at most MAX_SAMPLE in all.
SAMPLE, MAX_SAMPLE = 400, 4096
CLUSTERS = 3
LEAST = 8  # rows of a language
ROWS = 256  # texts counted at a time, each of which is a row of SIZE numbers, however short
FOLDS = 5
REJECTED = 0.005  # the share of a language's held-out prose that its bound leaves out
LEVELS = np.array([4, 8, 16, 32, 64, 128])  # numbers of trigrams that have a bound of their own; fewer than 4 tell nothing
FEW = 20  # with fewer rows of prose a language's bound is half the least cosine
UNKNOWN = "und"
_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ALPHA = re.compile(r"[^\W\d_]")


def counts(texts: pa.Array) -> np.ndarray:
    """One row of trigram counts for each text; zeros for a text without letters."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), dtype=np.float32)
    if not len(data):
        return out
    b = _LETTERS[data].astype(np.uint32)
    lead = np.zeros(len(b), bool)
    lead[1:] = data[:-1] == 0xC3
    b[lead & (data >= 0x80) & (data <= 0x9E)] += 0x20  # Latin-1 capitals to small letters
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    inner = offsets[(offsets > 0) & (offsets < len(b))]
    before[inner] = 0
    after[inner - 1] = 0
    code = ((before * np.uint32(65536) + b * np.uint32(256) + after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ascii_letter = FOLD[data]
    has_ascii = np.concatenate([[0], np.cumsum((ascii_letter >= 97) & (ascii_letter <= 122))])[offsets]
    used = np.flatnonzero(b)
    code, first = code[used], np.searchsorted(used, offsets)
    for i in range(n):
        if has_ascii[i + 1] > has_ascii[i] or (first[i + 1] > first[i] and _ALPHA.search(texts[i].as_py() or "")):
            out[i] = np.bincount(code[first[i] : first[i + 1]], minlength=SIZE)
    return out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from k evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    centres: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # of each centroid, for texts of 2 * LEVELS[-1] trigrams and more
    short_below: np.ndarray | None = None  # of each centroid and each of LEVELS, for texts of so many trigrams up to twice as many; without it, one bound for all

    def bounds(self, nearest: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        if self.short_below is None:
            return np.asarray(self.reject_below)[nearest]
        level = np.searchsorted(LEVELS, trigrams, side="right") - 1
        short = np.where(level < 0, 0.0, self.short_below[nearest, np.maximum(level, 0)])
        return np.where(trigrams >= 2 * LEVELS[-1], self.reject_below[nearest], short)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        tf = counts(texts)
        lettered = tf.any(axis=1)
        if not len(self.languages) or not len(tf):
            return [UNKNOWN] * len(tf), np.zeros(len(tf)), np.ones(len(tf), bool)
        cosine = weigh(tf, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        score = np.where(lettered, np.clip(cosine[np.arange(len(tf)), best], 0, 1), 0.0)
        return [self.languages[j] if ok else UNKNOWN for j, ok in zip(best, lettered)], score, ~lettered | (score < self.bounds(best, tf.sum(axis=1)))


def prose(texts: pa.Array) -> np.ndarray:
    """Whether a text is mostly letters, in words: spaces between, or another script's letters."""
    out = []
    for t in texts.to_pylist():
        b = np.frombuffer((t or "").encode(), np.uint8)
        white, letters = int((b <= 32).sum()), int((_LETTERS[b] > 0).sum())
        out.append(letters >= 0.8 * max(1, len(b) - white) and (white >= 0.05 * len(b) or 2 * int((b >= 128).sum()) > len(b)))
    return np.array(out, bool)


def bound(x: np.ndarray, is_prose: np.ndarray, found: np.ndarray) -> float:
    """The cosine below which a text is not in the language of the rows x, whose centroids are found.

    A low quantile of the cosines of prose to centroids of the other folds.
    """
    if is_prose.sum() < FEW:
        return 0.5 * float((x @ found.T).max(axis=1).min())
    fold = np.arange(len(x)) % FOLDS
    held = np.concatenate([(x[(fold == k) & is_prose] @ cluster(x[fold != k], CLUSTERS).T).max(axis=1) for k in range(FOLDS) if ((fold == k) & is_prose).any()])
    return float(np.quantile(held, REJECTED, method="lower"))


def thinned(tf: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of counts of n trigrams each, drawn from the rows of tf."""
    out = np.zeros_like(tf)
    for row, into in zip(tf, out):
        upto = np.cumsum(row)
        into += np.bincount(np.searchsorted(upto, rng.random(n) * upto[-1], side="right"), minlength=SIZE)
    return out


def short_bounds(tf: np.ndarray, idf: np.ndarray, found: np.ndarray, most: float) -> list[float]:
    """The bound for each of LEVELS: the low quantile of prose thinned so far, and at most the bound of whole texts."""
    rng, out = np.random.default_rng(17), []
    for n in LEVELS:
        rows = tf[tf.sum(axis=1) >= n]
        held = (weigh(thinned(rows, int(n), rng), idf) @ found.T).max(axis=1)
        out.append(min(most, float(np.quantile(held, REJECTED, method="lower"))) if len(held) >= FEW else 0.5 * most)
    return out


def train(labelled: DataFrame) -> Centroids:
    """labelled: (id, text, lang), lang not null. At most MAX_SAMPLE rows are fitted, by hash of id.

    If there are more than MAX_SAMPLE // LEAST languages, the most frequent are learned.
    """
    by_lang = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_SAMPLE // LEAST).collect()}
    if not by_lang:
        return Centroids([], np.empty((0, SIZE), np.float32), np.ones(SIZE, np.float32), np.empty(0), np.empty((0, len(LEVELS))))
    each = max(LEAST, min(SAMPLE, MAX_SAMPLE // len(by_lang)))
    share = F.create_map(*[F.lit(x) for lang, n in by_lang.items() for x in (lang, min(1.0, each / n))])
    unit = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    # About MAX_SAMPLE rows at most; more only where many rows share an id, and these are cut by hash too.
    chosen = labelled.filter(unit < share[F.col("lang")]).orderBy(F.xxhash64("id", F.lit(17)), F.xxhash64("text")).limit(2 * MAX_SAMPLE)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, rows=ROWS):
                tf = np.minimum(counts(b.column(1)), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in tf], pa.binary()), pa.array(prose(b.column(1)))], names=["id", "lang", "tf", "prose"])

    got = chosen.select("id", "text", "lang").mapInArrow(vectors, "id string, lang string, tf binary, prose boolean").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["id"][i].as_py() or ""))
    langs = np.array([got["lang"][i].as_py() for i in order])
    tf = np.stack([np.frombuffer(got["tf"][i].as_py(), "<u2") for i in order]).astype(np.float32) if order else np.empty((0, SIZE), np.float32)
    is_prose = np.array([got["prose"][i].as_py() for i in order], bool)
    used = tf.any(axis=1)
    langs, tf, is_prose = langs[used], tf[used], is_prose[used]
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weigh(tf, idf)
    names, centres, bounds, short = [], [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        found = cluster(own, CLUSTERS)
        names += [str(lang)] * len(found)
        centres.append(found)
        least = bound(own, is_prose[langs == lang], found)
        bounds += [least] * len(found)
        short += [short_bounds(tf[(langs == lang) & is_prose], idf, found, least)] * len(found)
    return Centroids(names, np.concatenate(centres) if centres else np.empty((0, SIZE), np.float32), idf, np.array(bounds), np.array(short, float).reshape(len(names), len(LEVELS)))


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected appended as the last three columns (with
    underscores before the name where docs has such a column); every other column passes through.

    A null text, or one without letters, is `und` with score 0 and rejected. With no labelled
    rows at all every text is. Rows with null or repeated ids stay; an empty table gives none.
    """
    from pyspark.sql import types as T

    at = docs.columns.index(text_col)
    names = fresh(docs, "lang_pred", "lang_score", "lang_rejected")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may stand outside
    new = [T.StructField(n, k) for n, k in zip(("pred", "score", "rejected"), (T.StringType(), T.DoubleType(), T.BooleanType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = [([], np.empty(0), np.empty(0, bool))]
            texts = pa.RecordBatch.from_arrays([whole.column(at)], names=["text"])
            for b in chunks(texts, rows=ROWS):
                parts.append(model.predict(b.column(0)))
            pred, score, rejected = [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*whole.schema.names, *(f.name for f in new)])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *new])).toDF(*docs.columns, *names)


def train_on(docs: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fits on the rows where `fold` (a boolean column) holds and lang is not null."""
    rows = docs.filter(fold & F.col(lang_col).isNotNull())
    return train(rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
