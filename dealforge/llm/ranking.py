"""Ranked lexical search over inverted treaps.

Documents are taken in slices of about POSTINGS postings, each with one treap for every asked term: a binary
search tree over the documents and at once a heap over the term's impact in them. All treaps of a query are
walked together. A step takes an interval of documents with, for each term, the root of the term's
subtree in it; the sum of the roots' weighted impacts bounds every score inside, and an interval whose bound is under
the query's k-th best score is dropped. Else the document of the greatest root is scored and splits the interval.
Intervals of all queries are stepped in blocks, those of the greatest bounds first.

Two scans read the texts: one counts documents, terms and document frequencies, one builds and searches.
Only k rows a slice and query move. Queries are taken in blocks of bounded terms, so what a task is
given does not grow with them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkernel import buffers, chunks, lut, span_hashes, words

#: Bytes outside terms: ASCII but for letters and digits.
TERM_BYTE = lut([b for b in range(128) if not chr(b).isalnum()])
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
POSTINGS = 2_000_000
BLOCK_TERMS = 100_000
BLOCK_ITEMS = 20_000
STEP = 4096  # intervals in a block


def terms_of(text: str | None) -> list[str]:
    """Distinct terms of a text, in order."""
    return list(dict.fromkeys(_TERM.findall((text or "").translate(_UPPER))))


def _hashes(terms: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(terms, pa.string()))
    return span_hashes(data, offsets[:-1], offsets[1:])


def _found(texts: pa.Array, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and postings (text, index of the asked term, occurrences) in order of text."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets, TERM_BYTE)
    hashes, n = span_hashes(data, starts, ends), np.diff(first)
    at = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
    hit = asked[at] == hashes
    key = np.repeat(np.arange(len(n), dtype=np.int64), n)[hit] * len(asked) + at[hit]
    key, tf = np.unique(key, return_counts=True)
    return n, key // len(asked), key % len(asked), tf


def _slices(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[tuple]:
    """(ids, n, docs, terms, tf) of about POSTINGS postings each; docs count from 0 in ids."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for some in chunks(batch):
            n, doc, term, tf = _found(some.column("text"), asked)
            held.append((some.column("id"), n, doc + rows, term, tf))
            size, rows = size + len(doc) + len(n), rows + len(n)
            if size >= POSTINGS:
                yield pa.concat_arrays([h[0] for h in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])
                held, size, rows = [], 0, 0
    if held:
        yield pa.concat_arrays([h[0] for h in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])


def treaps(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> tuple[np.ndarray, ...]:
    """(root of each term, left, right): treaps over postings ordered by term and doc; -1 is none.

    The parent of a posting is the lesser of the nearest greater ones before and after it; of
    equal impacts the first stands above. Both are found by jumping over what is known to be less, all postings at once.
    """
    n = len(doc)
    edge = np.flatnonzero(np.diff(term)) + 1

    def nearest(value: np.ndarray, cut: np.ndarray, equal: bool) -> np.ndarray:
        """The index before each whose value is greater (or equal) within its term, else -1."""
        before = np.arange(-1, n - 1)
        before[cut] = -1
        open_ = np.flatnonzero(before >= 0)
        while len(open_):
            less = value[before[open_]] < value[open_] if equal else value[before[open_]] <= value[open_]
            open_ = open_[less]
            before[open_] = before[before[open_]]
            open_ = open_[before[open_] >= 0]
        return before

    starts, stops = np.append(0, edge)[:n], np.append(edge, n)
    prev, back = nearest(impact, starts, True), nearest(impact[::-1], n - stops[: len(starts)], False)[::-1]
    following = np.where(back >= 0, n - 1 - back, -1)
    high = np.iinfo(np.int64).max
    a, b = (np.where(x >= 0, impact[x], high) if n else x for x in (prev, following))
    right_child = (prev >= 0) & (a < b)  # hangs right of the one before
    left_child = ~right_child & (following >= 0)
    left, right = np.full(n, -1), np.full(n, -1)
    right[prev[right_child]] = np.flatnonzero(right_child)
    left[following[left_child]] = np.flatnonzero(left_child)
    root = np.full(n_terms, -1)
    top = ~right_child & ~left_child
    root[term[top]] = np.flatnonzero(top)
    return root, left, right


def search_slice(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, queries: list[np.ndarray], weight: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, docs, scores) of the k best documents of a slice for each query; equal scores by `ids`, least first.

    doc, term, impact: postings by term and doc; queries: indices of terms; weight: of each term.
    """
    root, left, right = treaps(doc, term, impact, len(weight))
    left, right = np.append(left, -1), np.append(right, -1)  # index -1 is none
    at = np.append(doc, -1)
    gain = np.append(impact * weight[term], 0)
    width = max(map(len, queries), default=0)
    table = np.full((len(queries), max(width, 1)), -1)
    for q, own in enumerate(queries):
        table[q, : len(own)] = root[own]
    bar, top = np.ones(len(queries), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)

    def within(nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of each subtree's part between low and high, both left out: the first such node on the way down."""
        out = nodes.copy()
        flat, width = out.reshape(-1), nodes.shape[1]
        going = np.flatnonzero(flat >= 0)
        while len(going):
            now, row = flat[going], going // width
            under = at[now] <= low[row]
            wrong = under | (at[now] >= high[row])
            going, now = going[wrong], np.where(under, right[now], left[now])[wrong]
            flat[going] = now
            going = going[now >= 0]
        return out

    stack = [(np.arange(len(queries)), np.full(len(queries), -1), np.full(len(queries), len(ids)), table)]
    while stack:
        q, low, high, nodes = stack.pop()
        gains = gain[nodes]
        keep = gains.sum(axis=1) >= bar[q]  # of an equal bound a document of lesser id may be inside
        if not keep.any():
            continue
        q, low, high, nodes, gains = q[keep], low[keep], high[keep], nodes[keep], gains[keep]
        split = at[nodes[np.arange(len(q)), gains.argmax(axis=1)]]
        here = within(nodes, split - 1, split + 1)
        score = gain[here].sum(axis=1)
        order = np.argsort(q, kind="stable")
        edges = np.flatnonzero(np.diff(q[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            own = order[a:b]
            one = q[own[0]]
            good = own[score[own] >= bar[one]]
            if len(good):
                docs, scores = np.concatenate([top[one][0], split[good]]), np.concatenate([top[one][1], score[good]])
                best = np.lexsort((ids[docs], -scores))[:k]
                top[one] = docs[best], scores[best]
                if len(best) == k:
                    bar[one] = max(bar[one], scores[best[-1]])
        nodes = np.concatenate([within(nodes, low, split), within(nodes, split, high)])
        q, low, high = np.concatenate([q, q]), np.concatenate([low, split]), np.concatenate([split, high])
        bound = gain[nodes].sum(axis=1)
        rest = np.flatnonzero(bound >= bar[q])
        rest = rest[np.argsort(bound[rest], kind="stable")]
        for a in range(0, len(rest), STEP):  # the last, of greatest bounds, is taken first
            some = rest[a : a + STEP]
            stack.append((q[some], low[some], high[some], nodes[some]))
    for one, (docs, scores) in enumerate(top):
        if len(docs):
            yield one, docs, scores


def _search_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, score) of one block of items (row, text), k rows a slice and item at most."""
    texts = [terms_of(t) for _, t in items]
    names = sorted({t for own in texts for t in own})
    rows = [r for r, _ in items]
    hashes = _hashes(names) if names else np.zeros(1, np.uint64)
    order = np.argsort(hashes)
    asked, place = hashes[order], np.empty(len(hashes), np.int64)
    place[order] = np.arange(len(hashes))
    index = dict(zip(names, place.tolist()))
    queries = [np.array([index[t] for t in own], np.int64) for own in texts]
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(asked), np.int64), 0, 0
        for batch in batches:
            for some in chunks(batch):
                n, _, term, _ = _found(some.column("text"), asked)
                df += np.bincount(term, minlength=len(asked))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[there].tolist()], pa.int64())], names=["term", "n"])

    counted = dict(picked.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())  # BLOCK_TERMS + 2 rows at most
    n_docs, n_all = counted.get(-2, 0), counted.get(-1, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(asked))], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_ids, n, doc, term, tf in _slices(batches, asked):
            m = 50 + (50 * n.astype(np.int64) * n_docs) // max(n_all, 1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            order = np.lexsort((doc, term))
            rank = np.empty(len(own_ids), np.int64)  # of ids, null last
            rank[pa.compute.sort_indices(own_ids).to_numpy()] = np.arange(len(own_ids))
            for one, best, scores in search_slice(doc[order], term[order], impact[order], queries, weight, rank, k):
                yield pa.RecordBatch.from_arrays([pa.array([rows[one]] * len(best), pa.int64()), own_ids.take(pa.array(best)), pa.array(scores, pa.int64())], names=["row", "doc_id", "score"])

    return picked.mapInArrow(search, f"row bigint, doc_id {kind}, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (int), doc_id, score: the k best documents of each row of items (item_id, text).

    Documents of score 0 are left out; equal scores come by ascending doc_id, null last. A null or empty text has no
    terms. Every row of items is a query of its own and every row of docs a document, also where ids repeat.
    Terms are known by 64-bit hashes. Other columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    asked = [(n, item, text) for n, (item, text) in enumerate(items.select("item_id", "text").toLocalIterator())]
    blocks, held, size = [], [], 0
    for n, _, text in asked:
        own = len(terms_of(text))
        if held and (size + own > BLOCK_TERMS or len(held) == BLOCK_ITEMS):
            blocks, held, size = [*blocks, held], [], 0
        held.append((n, text))
        size += own
    blocks = [*blocks, held] if held else blocks
    kind = items.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(n, item) for n, item, _ in asked], f"row bigint, item_id {kind}")
    if not blocks:
        return names.join(docs.select(F.col(id_col).alias("doc_id")).limit(0), F.lit(False)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("bigint").alias("score"))
    hits = reduce(DataFrame.unionByName, [_search_block(docs, b, k, id_col, text_col) for b in blocks])
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "row").select("item_id", "rank", "doc_id", "score")
