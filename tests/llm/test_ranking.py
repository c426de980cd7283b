"""Ranked search: against scores in plain Python, over slices, ties, nulls, repeated rows and blocks of queries."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from dealforge.llm import ranking

DOCS = "doc_id bigint, text string, id string, score int"
ITEMS = "item_id bigint, text string, rank int"


def brute(docs, items, k):
    words = [(d[0], Counter(ranking._TERM.findall((d[1] or "").translate(ranking._UPPER)))) for d in docs]
    words = [(d, c) for d, c in words if c]
    n, total = len(words), sum(c.total() for _, c in words)
    out = []
    for item, text, *_ in items:
        scores = []
        for d, c in words:
            m, score = 50 + (50 * c.total() * n) // total, 0
            for t in ranking.terms_of(text):
                df = sum(t in o for _, o in words)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=5):
    found = ranking.ranked_search(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "É9", "Straße"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 25), weights=[1 / (i + 1) for i in range(len(words))]))
    return [(i, text(), "x", 1) for i in range(n)], [(i, text().upper() if i % 2 else text(), 1) for i in range(8)]


@pytest.mark.parametrize("postings", [10, 2_000_000])
def test_equals_plain_scores(spark, monkeypatch, postings):
    monkeypatch.setattr(ranking, "POSTINGS", postings)
    docs, items = corpus(1, 120)
    docs += [(7, docs[7][1], "x", 1), (500, docs[7][1], "x", 1), (None, docs[8][1], "x", 1), (501, None, "x", 1), (502, "w0 " * 50_000, "x", 1)]
    items += [(90, None, 1), (91, "", 1), (92, "nowhere", 1), (None, "w1 w2", 1)]
    assert run(spark, docs, items) == brute(docs, items, 5)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 12)
    docs, items = corpus(2, 50)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(3, 5)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    sizes = [1, 40, 3, 200]
    term = np.repeat(np.arange(4), sizes)
    doc = np.concatenate([np.sort(rng.choice(500, s, replace=False)) for s in sizes])
    impact = rng.integers(0, 9, len(doc))
    root, left, right = ranking.treaps(doc, term, impact, 5)

    def walk(node):
        if node < 0:
            return []
        for child in (left[node], right[node]):
            assert child < 0 or impact[child] <= impact[node]
        return [*walk(left[node]), doc[node], *walk(right[node])]

    for t in range(4):
        assert walk(root[t]) == doc[term == t].tolist()
    assert root[4] == -1


def test_pruning_scores_few_documents(monkeypatch):
    """With one outstanding document of a million-to-one impact most of the others are never scored."""
    n = 20_000
    rng = np.random.default_rng(5)
    impact = rng.integers(1, 1000, n)
    scored = []
    lexsort = np.lexsort
    monkeypatch.setattr(ranking.np, "lexsort", lambda keys: scored.append(len(keys[0])) or lexsort(keys))
    got = list(ranking.search_slice(np.arange(n), np.zeros(n, np.int64), impact, [np.array([0])], np.array([1]), np.arange(n), 10))
    best = sorted(zip(-impact, range(n)))[:10]
    assert got[0][1].tolist() == [d for _, d in best] and sum(scored) < n // 4
