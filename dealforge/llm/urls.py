"""URL filter: rules first, then a ratio of two character language models.

Two variable-order Markov models with Witten-Bell smoothing are counted over the URLs that the
rules accept and reject. A URL without a rule is judged by the difference of the two
log-likelihoods divided by its length, against a threshold calibrated on a fold of the ruled
URLs that the models have not seen. Counts are exact: a gram of ORDERS bytes is one number, and
the table of grams grows with the input. Frequent grams, at most HOT, are sent to every task;
the others are joined to the URLs that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, materialise
from .textkernel import buffers, chunks

ORDERS = 5  # contexts of 0 to 4 characters
PAD, END = 0xFF, 0xFE  # bytes that UTF-8 does not use
FLUSH = 1 << 20  # grams that a task counts at a time
HOT = 1 << 18  # 16 bytes each
BINS = 512
#: (kind, rule): a host, then a path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// to /, ?, # or the end, A-Z lower-cased; path: then to ?, # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDERS bytes up to each byte and the end mark, as one number, and their number in each text."""
    data, offsets = buffers(texts)
    # Texts are laid out with ORDERS - 1 marks before each and one end mark, so contexts never reach over.
    n, pad = len(offsets) - 1, ORDERS - 1
    lengths = np.diff(offsets)
    places = np.arange(len(data)) + np.repeat(np.arange(n) * (pad + 1) + pad, lengths)
    line = np.full(len(data) + n * (pad + 1), PAD, np.int64)
    line[places] = data
    ends = offsets[1:] + np.arange(n) * (pad + 1) + pad
    line[ends] = END
    at = np.sort(np.concatenate([places, ends]))
    return sum(line[at - k] << (8 * k) for k in range(ORDERS)), lengths + 1


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (side, text), side 0 rejected, 1 accepted, 2 not fitted: counts of grams, FLUSH grams at a time."""
    held: list[np.ndarray] = []
    sides: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        found, at = np.unique(np.concatenate(held), return_inverse=True)
        side = np.concatenate(sides)
        n = [np.bincount(at[side == k], minlength=len(found)) for k in (0, 1, 2)]
        held.clear()
        sides.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found, sum(n), n[0], n[1])], names=["g", "n", "n0", "n1"])

    for whole in batches:
        for b in chunks(whole):
            keys, lengths = grams(b.column(1))
            held.append(keys)
            sides.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int8), lengths))
            if sum(map(len, held)) > FLUSH:
                yield counted()
    if held:
        yield counted()


def _low(col: Column, n: int) -> Column:
    return col.bitwiseAND(F.lit((1 << 8 * n) - 1))


def _pair_model(counts: DataFrame) -> DataFrame:
    """(g, p0, p1) of grams of two bytes, of which there are 65,536 at most: made on the driver."""
    got = counts.groupBy(_low(F.col("g"), 2).alias("g")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    g, both = got.column("g").to_numpy(), []
    for c in ("n0", "n1"):
        n = np.zeros((256, 256))
        n[g >> 8, g & 255] = got.column(c).to_numpy()
        single = n.sum(axis=0)
        kinds = (single > 0).sum()
        lower = (single + kinds / 256) / max(single.sum() + kinds, 1) if kinds else np.full(256, 1 / 256)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        both.append(np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)[g >> 8, g & 255])
    return counts.sparkSession.createDataFrame(pa.table({"g": pa.array(g, pa.int64()), "p0": both[0], "p1": both[1]}))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(g, n, r) of (g, n, n0, n1): log-likelihood under accepted less under rejected of the last byte of each gram.

    In each order: (count + followers * lower order) / (total + followers) of the context, where
    followers is its number of distinct next bytes; a context that is not met leaves the lower order.
    """
    lower = F.broadcast(_pair_model(counts))
    for k in range(3, ORDERS + 1):
        own = counts if k == ORDERS else counts.groupBy(_low(F.col("g"), k).alias("g")).agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = Window.partitionBy(F.shiftright("g", 8))
        for s in "01":
            own = own.withColumn(f"t{s}", F.sum(f"n{s}").over(context)).withColumn(f"d{s}", F.count_if(F.col(f"n{s}") > 0).over(context))
        both = own.withColumn("low", _low(F.col("g"), k - 1)).join(lower.withColumnRenamed("g", "low"), "low")
        p = [F.when(F.col(f"t{s}") > 0, (F.col(f"n{s}") + F.col(f"d{s}") * F.col(f"p{s}")) / (F.col(f"t{s}") + F.col(f"d{s}"))).otherwise(F.col(f"p{s}")).alias(f"p{s}") for s in "01"]
        lower = both.select("g", "n", *p) if k == ORDERS else both.select("g", *p)
    return lower.select("g", "n", (F.log("p1") - F.log("p0")).alias("r"))


def scores(rows: DataFrame) -> DataFrame:
    """rows (uid, side, text, ...), uid unique, with url_score appended: a character's mean log ratio."""
    counts = materialise(rows.select("side", "text").mapInArrow(count_batches, "g bigint, n bigint, n0 bigint, n1 bigint").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), "grams")
    ratios = materialise(log_ratios(counts), "ratios")
    least = max(1, -(-(ratios.agg(F.sum("n")).first()[0] or 0) // HOT))  # so at most HOT grams are hot
    got = ratios.filter(F.col("n") >= least).select("g", "r").toArrow().sort_by("g")
    hot, known = got.column("g").to_numpy(), got.column("r").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                keys, lengths = grams(b.column(1))
                at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
                met = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                part = np.add.reduceat(np.where(met, known[at], 0.0), starts[:-1]) if len(lengths) and len(hot) else np.zeros(len(lengths))
                cold = np.concatenate([[0], np.cumsum(~met)])[starts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(part, pa.float64()), pa.ListArray.from_arrays(pa.array(cold, pa.int32()), pa.array(keys[~met], pa.int64()))], names=["uid", "length", "part", "cold"])

    parts = checkpointed(rows.select("uid", "text").mapInArrow(run, "uid bigint, length bigint, part double, cold array<bigint>"))
    rest = parts.select("uid", F.explode("cold").alias("g")).join(ratios, "g").groupBy("uid").agg(F.sum("r").alias("rest"))
    score = (F.col("part") + F.coalesce("rest", F.lit(0.0))) / F.col("length")
    return rows.join(parts.select("uid", "length", "part"), "uid").join(rest, "uid", "left").withColumn("url_score", score).drop("length", "part", "rest")


def threshold_of(scored: DataFrame) -> float:
    """scored: (accepted boolean, url_score) of URLs that were not fitted."""
    binned = scored.select("accepted", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("url_score") + 4) / 8 * BINS).cast("int"))).alias("bin"))
    accepted, rejected = np.zeros(BINS), np.zeros(BINS)
    for side, b, n in binned.groupBy("accepted", "bin").count().collect():  # at most 2 * BINS rows
        (accepted if side else rejected)[b] = n
    if not accepted.sum() or not rejected.sum():
        return 0.0
    # Balanced error if scores from bin t on are accepted; the middle of the best stretch.
    wrong = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum() + np.concatenate([np.cumsum(rejected[::-1])[::-1], [0]]) / rejected.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] / BINS * 8 - 4)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, url_score for each row.

    The longest rule that fits decides (allow before block on a tie); without one the verdict is
    allow if the score reaches the threshold. A null url, or one without ://, has an empty host
    and path and is scored as it is. Rows with null or repeated ids stay; other columns are left
    out. With no ruled URLs of one kind the threshold is 0.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0]))
    for name, pick in (("rule", 1), ("ruled", 0)):
        col = F.lit(None).cast("string")
        for r in reversed(ordered):
            col = F.when(fits(F.col("host"), F.col("path"), r[1]), F.lit(r[pick])).otherwise(col)
        rows = rows.withColumn(name, col)
    # Every fifth ruled URL by hash is left for the threshold.
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    side = F.when(F.col("ruled").isNull() | held, 2).when(F.col("ruled") == "allow", 1).otherwise(0)
    scored = checkpointed(scores(materialise(rows.withColumn("side", side).withColumn("uid", F.monotonically_increasing_id()), "urls")))
    threshold = threshold_of(scored.filter(F.col("ruled").isNotNull() & held).select((F.col("ruled") == "allow").alias("accepted"), "url_score"))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("url_score") >= threshold, "allow").otherwise("block")).alias("verdict"), "url_score")
