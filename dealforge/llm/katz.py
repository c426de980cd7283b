"""Language model scores by Katz backoff over word pairs.

P(w | v) is d c(vw) / c(v) for a pair seen in training, with Good-Turing discounts d of counts to 5, else
alpha(v) P(w); P(w) is d c(w) / N, and what the discounts leave is the probability of a word that
was never seen. alpha(v) = (1 - sum P(w | v)) / (1 - sum P(w)), both over the words seen after v, so that every
context sums to 1 exactly. Where nothing is left by discounts, the total counts one more.

Counts are tables in parts by a hash, whose rows are sorted arrays. Texts are read twice: once for words, once for pairs.
A slice of texts sends each part the distinct pairs of that part once, with their
counts and the documents that they stand in. A part asks the table of words for the counts that it needs, evaluates its
pairs, and answers each slice with sums for its documents. A context of more than a quarter of a part's
tokens is dealt over all parts by the word after it, and its sums are put together from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import SPACES, buffers, chunks, mix, span_hashes, words

K = 5  # the greatest count that is discounted
SLICE = 1 << 20  # tokens; a worker needs some 120 bytes for each
ROWS = 1 << 15  # documents in a slice at most
HOT = 1 << 16  # so many hot contexts at most
SHARES = 4  # a context is hot from the SHARES-th of a part
END, BEGIN = (int(x) for x in mix(np.array([1, 2], np.uint64)).view(np.int64))  # the token after each text, the context before
_STEP = np.uint64(0x9E3779B97F4A7C15)


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """Katz's discount of counts 0 to k (of 0: 1), from how many entries have the count 1, 2, ... k + 1.

    Where a discount would not lie between 0 and 1, k is one less; without any, none is discounted.
    """
    out = np.ones(k + 1)
    for top in range(k, 1, -1):
        if (n[: top + 1] > 0).all():
            r = np.arange(1, top + 1)
            rest = (top + 1) * n[top] / n[0]
            d = ((r + 1) * n[1 : top + 1] / (r * n[:top]) - rest) / (1 - rest) if rest != 1 else np.zeros(top)
            if ((d > 0) & (d <= 1)).all():
                out[1 : top + 1] = d
                break
    return out


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.where(counts < len(d), counts, 0)]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(ids, train, n, doc, word) of about `size` tokens: rows, and for each token its row and hash, END after each row."""
    held, rows, tokens = [], 0, 0
    whole = lambda: (pa.concat_arrays([h[0] for h in held]), *(np.concatenate(x) for x in list(zip(*held))[1:]))
    for batch in batches:
        for some in chunks(batch, rows=ROWS // 2):
            data, offsets = buffers(some.column("text"))
            starts, ends, first = words(data, offsets, SPACES)
            n = np.diff(first) + 1
            out = np.full(len(starts) + len(n), END, np.int64)
            out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n - 1)] = span_hashes(data, starts, ends).view(np.int64)
            held.append((some.column("id"), some.column("train").to_numpy(zero_copy_only=False).astype(bool), n, np.repeat(np.arange(len(n)) + rows, n), out))
            rows, tokens = rows + len(n), tokens + len(out)
            if tokens >= size or rows >= ROWS:
                yield whole()
                held, rows, tokens = [], 0, 0
    if held:
        yield whole()


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list for each size, in order."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if column.length() else np.empty(0, np.int64)


def word_table(rows: DataFrame, parts: int) -> DataFrame:
    """(part, words, counts, totals): sorted words of each part, with their tokens in training and in all rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, _, doc, word in _slices(batches, 2 * SLICE):
            found, index = np.unique(word, return_inverse=True)
            part = _part(found, parts)
            order = np.argsort(part, kind="stable")
            sizes = np.bincount(part, minlength=parts)
            there = np.flatnonzero(sizes)
            known, every = (np.bincount(x, minlength=len(found)).astype(np.int32)[order] for x in (index[train[doc]], index))
            yield pa.RecordBatch.from_arrays([pa.array(there), *(_lists(x, sizes[there]) for x in (found[order], known, every))], names=["part", "words", "counts", "totals"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        found, index = np.unique(_flat(table.column("words")), return_inverse=True)
        sums = [np.bincount(index, weights=_flat(table.column(c)), minlength=len(found)).astype(np.int64) for c in ("counts", "totals")]
        return pa.table([[key[0].as_py()], *(_lists(x, np.array([len(x)])) for x in (found, *sums))], names=["part", "words", "counts", "totals"])

    sent = rows.mapInArrow(send, "part bigint, words array<bigint>, counts array<int>, totals array<int>")
    return sent.groupBy("part").applyInArrow(add, "part bigint, words array<bigint>, counts array<bigint>, totals array<bigint>")


def _profile(table: DataFrame, column: str) -> tuple[int, int, np.ndarray]:
    """Sum and number of an array column's positive entries, and how many are 1, 2, ... K + 1."""
    equal = lambda r: F.sum(F.size(F.filter(column, lambda c: c == r)))
    many = [equal(r).alias(f"n{r}") for r in range(1, K + 2)]
    got = table.agg(F.sum(F.aggregate(column, F.lit(0).cast("bigint"), lambda a, c: a + c)), F.sum(F.size(F.filter(column, lambda c: c > 0))), *many).first()
    return got[0] or 0, got[1] or 0, np.array([x or 0 for x in got[2:]], float)


def pair_rows(rows: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """What slices send to parts: for each context (before) so many words (fan), for each word its training count
    and tokens (reps), for each token its document (less half of ROWS); and once a slice its documents (ids, n, train)."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"part bigint, slice bigint, before array<bigint>, fan array<int>, word array<bigint>, known array<int>, reps array<int>, docs array<smallint>, ids array<{kind}>, n array<bigint>, train array<boolean>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, (ids, train, n, doc, word) in enumerate(_slices(batches, SLICE)):
            found, index = np.unique(word, return_inverse=True)
            before = np.empty(len(word), np.int64)
            before[1:] = index[:-1]
            before[np.cumsum(n) - n] = len(found)  # BEGIN
            names, width = np.append(found, BEGIN), len(found) + 1
            code = before * width + index
            del word, before, index
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order].astype(np.int32)
            seen = train[doc]
            del order
            start = np.flatnonzero(np.diff(code, prepend=-1))
            reps, known = np.diff(np.append(start, len(code))), np.add.reduceat(seen.astype(np.int64), start)
            v, w = names[code[start] // width], names[code[start] % width]
            part = _part(v, parts)
            spread = np.isin(v, hot)
            part[spread] = _part(mix(w[spread].view(np.uint64) * _STEP + v[spread].view(np.uint64)), parts)
            moved = np.argsort(part, kind="stable")
            tokens = np.repeat(reps[moved], reps[moved])  # place of each token after the move
            at = np.repeat(start[moved], reps[moved]) + np.arange(len(tokens)) - np.repeat(np.cumsum(reps[moved]) - reps[moved], reps[moved])
            part, v, w, known, reps, doc = part[moved], v[moved], w[moved], known[moved], reps[moved], doc[at]
            del code, seen, tokens, at, moved, start
            turn = np.flatnonzero(np.append(True, (np.diff(v) != 0) | (np.diff(part) != 0)))
            fan, sizes = np.diff(np.append(turn, len(v))), np.bincount(part, minlength=parts)
            there = np.flatnonzero(sizes)
            contexts, spans = np.bincount(part[turn], minlength=parts)[there], np.bincount(part, weights=reps, minlength=parts).astype(np.int64)[there]
            name = (TaskContext.get().partitionId() << 32) + serial
            home = np.arange(len(there)) == name % len(there)
            slots = np.where(home, len(n), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(there), pa.array(np.full(len(there), name)), _lists(v[turn], contexts), *(_lists(x.astype(np.int32), s) for x, s in ((fan, contexts),)), _lists(w, sizes[there]),
                 _lists(known.astype(np.int32), sizes[there]), _lists(reps.astype(np.int32), sizes[there]), _lists((doc - ROWS // 2).astype(np.int16), spans),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(slots)), pa.int32()), ids), _lists(n.astype(np.int64), slots), _lists(train, slots)],
                names=["part", "slice", "before", "fan", "word", "known", "reps", "docs", "ids", "n", "train"],
            )

    return rows.mapInArrow(send, schema)


class _Pairs:
    """The distinct pairs of a part: v and w, indices in contexts and words, with training counts; row: of each sent pair, its pair."""

    def __init__(self, sent: pa.Table) -> None:
        fan = _flat(sent.column("fan"))
        self.contexts, v = np.unique(_flat(sent.column("before")), return_inverse=True)
        self.words, w = np.unique(_flat(sent.column("word")), return_inverse=True)
        code, self.row = np.unique(np.repeat(v, fan) * len(self.words) + w, return_inverse=True)
        self.v, self.w = code // max(len(self.words), 1), code % max(len(self.words), 1)
        self.count = np.bincount(self.row, weights=_flat(sent.column("known")), minlength=len(code)).astype(np.int64)


class _Model:
    """What a task needs besides its part: totals, discounts of words and of pairs, hot contexts, the number of parts."""

    def __init__(self, total: int, types: int, word_n: np.ndarray, hot: np.ndarray, parts: int) -> None:
        self.total, self.types, self.hot, self.parts = total, types, hot, parts
        self.word_d = discounts(word_n)
        top = np.arange(1, K + 1)
        spared = float((top * word_n[:K] * (1 - self.word_d[1:])).sum())  # tokens' worth that the discounts leave
        self.size = total if spared > 0 else total + 1
        self.unseen = (spared or 1.0) / self.size
        self.pair_d = np.ones(K + 1)

    def word_p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.word_d) / self.size, self.unseen)

    def sums(self, pairs: _Pairs, counts: np.ndarray) -> np.ndarray:
        """For each context: training tokens, discounted tokens, and the probability of its words without it."""
        seen = pairs.count > 0
        add = lambda x: np.bincount(pairs.v[seen], weights=x[seen], minlength=len(pairs.contexts)).astype(float)
        return np.stack([add(pairs.count), add(_discounted(pairs.count, self.pair_d)), add(self.word_p(counts[pairs.w]))])


def weights(tokens: np.ndarray, kept: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, alpha) of contexts by sums(): without a discount the total is one more; an unseen context has alpha 1."""
    total = np.where(kept < tokens, tokens, tokens + 1.0)
    return total, np.where(tokens > 0, (1 - kept / total) / np.maximum(1 - known, 1e-300), 1.0)


def _counts_of(asked: np.ndarray, notes: pa.Table, parts: int) -> np.ndarray:
    """Counts of a part's sorted words, from the answers, which come in the order of ask()."""
    out = np.empty(len(asked), np.int64)
    out[np.argsort(_part(asked, parts), kind="stable")] = _flat(notes.sort_by("to").column("counts"))
    return out


def scores(docs: DataFrame, train: Column, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between white space, A-Z lower-cased, and one end a text. score is the log10 probability
    of the text under the model of the rows where `train` holds; base_score the sum of log10((c + 1) / (N + V + 1)).
    A null or empty text is its end alone. Rows with null or repeated ids stay as they are; other
    columns are not read. Without training rows every word is unseen (probability 1). An empty table gives none.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    table = materialise(word_table(rows, parts), "words")
    total, types, word_n = _profile(table, "counts")
    every = table.agg(F.sum(F.aggregate("totals", F.lit(0).cast("bigint"), lambda a, c: a + c))).first()[0] or 0
    often = table.select(F.explode(F.filter(F.arrays_zip("words", "totals"), lambda x: x["totals"] * min(HOT, SHARES * parts) > every)).alias("x")).select("x.words")
    hot = np.array(sorted({BEGIN, *(r[0] for r in often.collect())}), np.int64)  # HOT at most
    model = _Model(total, types, word_n, hot, parts)
    sent = pair_rows(rows, parts, hot).repartition(parts, "part")
    asked = sent.groupBy("part").applyInArrow(_ask(parts), "to bigint, part bigint, words array<bigint>, many array<bigint>")
    answers = asked.groupBy("to").cogroup(table.groupBy("part")).applyInArrow(_answer, "part bigint, to bigint, counts array<int>, many array<bigint>").repartition(parts, "part")
    first = F.col("many").isNotNull()  # one row of a part
    profile = answers.filter(first).agg(F.array(*[F.coalesce(F.sum(F.get("many", r)), F.lit(0)) for r in range(K + 1)]).alias("pair_n"))
    noted = answers.join(F.broadcast(profile), first, "left")
    partial = sent.groupBy("part").cogroup(noted.groupBy("part")).applyInArrow(_hot_sums(model), "v bigint, x double, y double, z double")
    summed = partial.groupBy("v").agg(*[F.sum(c).alias(c) for c in "xyz"]).agg(F.array_sort(F.collect_list(F.struct("v", "x", "y", "z"))).alias("h"))  # HOT rows at most
    summed = summed.select(*[F.col("h")[c].alias("hot_" + c) for c in "vxyz"])
    noted = noted.join(F.broadcast(summed), first, "left")
    schema = f"slice bigint, docs array<int>, score array<double>, base array<double>, known array<int>, ids array<{kind}>, n array<bigint>, train array<boolean>"
    found = sent.groupBy("part").cogroup(noted.groupBy("part")).applyInArrow(_evaluate(model), schema)
    out = found.groupBy("slice").applyInArrow(_together, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def _ask(parts: int):
    def ask(key: tuple, sent: pa.Table) -> pa.Table:
        """The words of a part, by the part of the word table that has them, and how many of its pairs have a count of 1, 2, ..."""
        pairs = _Pairs(sent)
        to = _part(pairs.words, parts)
        order, sizes = np.argsort(to, kind="stable"), np.bincount(to, minlength=parts)
        there = np.flatnonzero(sizes)
        many = np.bincount(np.minimum(pairs.count, K + 2), minlength=K + 3)[1 : K + 2]
        lists = pa.ListArray.from_arrays(pa.array([0, *[K + 1] * len(there)], pa.int32()), pa.array(many), mask=pa.array(np.arange(len(there)) > 0))
        return pa.table([pa.array(there), pa.array(np.full(len(there), key[0].as_py())), _lists(pairs.words[order], sizes[there]), lists], names=["to", "part", "words", "many"])

    return ask


def _answer(asked: pa.Table, have: pa.Table) -> pa.Table:
    want = _flat(asked.column("words"))
    counts = _flat(have.column("counts"))[np.searchsorted(_flat(have.column("words")), want)]
    sizes = asked.column("words").combine_chunks().value_lengths().to_numpy()
    return pa.table([asked.column("part"), asked.column("to"), _lists(np.minimum(counts, 2**31 - 1).astype(np.int32), sizes), asked.column("many")], names=["part", "to", "counts", "many"])


def _local(model: _Model, sent: pa.Table, notes: pa.Table) -> tuple[_Pairs, np.ndarray, np.ndarray, pa.Table]:
    pairs = _Pairs(sent)
    counts = _counts_of(pairs.words, notes, model.parts)
    row = notes.filter(pa.compute.is_valid(notes.column("many")))
    model.pair_d = discounts(_flat(row.column("pair_n")).astype(float))
    return pairs, counts, model.sums(pairs, counts), row


def _hot_sums(model: _Model):
    def hot_sums(sent: pa.Table, notes: pa.Table) -> pa.Table:
        pairs, _, sums, _ = _local(model, sent, notes)
        own = np.isin(pairs.contexts, model.hot)
        return pa.table([pa.array(pairs.contexts[own]), *(pa.array(s[own]) for s in sums)], names=["v", "x", "y", "z"])

    return hot_sums


def _evaluate(model: _Model):
    def evaluate(sent: pa.Table, notes: pa.Table) -> pa.Table:
        pairs, counts, sums, row = _local(model, sent, notes)
        hot = _flat(row.column("hot_v"))
        own = np.flatnonzero(np.isin(pairs.contexts, hot))
        at = np.searchsorted(hot, pairs.contexts[own])
        for s, c in zip(sums, "xyz"):
            s[own] = _flat(row.column("hot_" + c))[at]
        total, alpha = weights(*sums)
        backed = alpha[pairs.v] * model.word_p(counts[pairs.w])
        p = np.log10(np.where(pairs.count > 0, _discounted(pairs.count, model.pair_d) / total[pairs.v], backed))
        base = np.log10((counts[pairs.w] + 1) / (model.total + model.types + 1))
        reps = _flat(sent.column("reps"))
        each = np.repeat(pairs.row, reps)  # the pair of each token
        docs = sent.column("docs").combine_chunks()
        ends, doc = np.cumsum(docs.value_lengths().to_numpy()), _flat(sent.column("docs")).astype(np.int32) + ROWS // 2
        out = []
        for a, b in zip(np.append(0, ends[:-1]), ends):
            found, index = np.unique(doc[a:b], return_inverse=True)
            token = each[a:b]
            out.append((found, *(np.bincount(index, weights=x) for x in (p[token], base[token], counts[pairs.w[token]] > 0))))
        sizes = np.array([len(o[0]) for o in out])
        score, base_, known = (_lists(np.concatenate([o[k] for o in out]).astype(t), sizes) for k, t in ((1, float), (2, float), (3, np.int32)))
        return pa.table([sent.column("slice"), _lists(np.concatenate([o[0] for o in out]), sizes), score, base_, known, *(sent.column(c) for c in ("ids", "n", "train"))], names=["slice", "docs", "score", "base", "known", "ids", "n", "train"])

    return evaluate


def _together(found: pa.Table) -> pa.Table:
    n, docs = _flat(found.column("n")), _flat(found.column("docs"))
    score, base, known = (np.bincount(docs, weights=_flat(found.column(c)), minlength=len(n)) for c in ("score", "base", "known"))
    ids = found.column("ids").combine_chunks().flatten()
    return pa.table([ids, found.column("train").combine_chunks().flatten(), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "train", "n_tokens", "n_known", "base_score", "score"])
