"""Katz scores: against a recursive model in plain Python; each context sums to 1."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import katz

SCHEMA = "doc_id bigint, text string, learn boolean, n bigint, part int"


class Plain:
    """The model by its definition: dictionaries, one probability at a time."""

    def __init__(self, texts):
        self.pairs, self.words, self.after = Counter(), Counter(), {}
        for text in texts:
            before = "<s>"
            for w in self.tokens(text):
                self.pairs[before, w] += 1
                self.words[w] += 1
                self.after.setdefault(before, []).append(w)
                before = w
        self.d1, self.d2 = (katz.discounts(np.array([sum(c == r for c in x.values()) for r in range(1, 7)], float)) for x in (self.words, self.pairs))
        self.n = self.words.total()
        left = self.n - sum(self.cut(c, self.d1) for c in self.words.values())
        self.size = self.n if left > 0 else self.n + 1
        self.unseen = (left or 1) / self.size

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]

    @staticmethod
    def cut(c, d):
        return c * d[c] if c < len(d) else c

    def word(self, w):
        return self.cut(self.words[w], self.d1) / self.size if self.words[w] else self.unseen

    def p(self, v, w):
        if v not in self.after:
            return self.word(w)
        seen, total = set(self.after[v]), len(self.after[v])
        kept = sum(self.cut(self.pairs[v, x], self.d2) for x in seen)
        total += kept >= total
        if w in seen:
            return self.cut(self.pairs[v, w], self.d2) / total
        return (1 - kept / total) / (1 - sum(map(self.word, seen))) * self.word(w)

    def score(self, text):
        own = self.tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip(["<s>", *own], own))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "x" * 300]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30), weights=[1 / (j + 1) for j in range(len(words))])) + rng.choice(["", "\n", " rare%d" % i]), i % 4 > 0, 1, 1) for i in range(n)]
    return rows + [(None, "the w1", True, 1, 1), (3, "the w1", False, 1, 1), (3, "the w1", False, 1, 1), (n, None, True, 1, 1), (n + 1, "", False, 1, 1), (n + 2, "w0 w1 " * 3000, True, 1, 1), (n + 3, "never seen words", None, 1, 1)]


@pytest.mark.parametrize("slice_, hot, parts", [(1 << 21, 1 << 16, 4), (500, 8, 7), (500, 1 << 16, 1)])
def test_equals_plain_model(spark, monkeypatch, slice_, hot, parts):
    monkeypatch.setattr(katz, "SLICE", slice_)
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "SHARES", hot)
    rows = corpus(parts, 150)
    model = Plain([t for _, t, learn, *_ in rows if learn])
    found = katz.scores(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("learn"), parts).collect()
    show = lambda d, t, s, b: (str(d), bool(t), round(s, 6), round(b, 6))
    base = lambda t: sum(math.log10((model.words[w] + 1) / (model.n + len(model.words) + 1)) for w in model.tokens(t))
    assert sorted(show(r.doc_id, r.train, r.score, r.base_score) for r in found) == sorted(show(d, learn, model.score(t), base(t)) for d, t, learn, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in found) == sorted((str(d), len(model.tokens(t)), sum(w in model.words for w in model.tokens(t)), model.n) for d, t, *_ in rows)


def test_every_context_sums_to_one():
    model = Plain([t for _, t, learn, *_ in corpus(9, 80) if learn])
    words = [*model.words, "never seen"]
    assert abs(sum(map(model.word, words)) - 1) < 1e-9
    for v in [*list(model.after)[:20], "not a context"]:
        assert abs(sum(model.p(v, w) for w in words) - 1) < 1e-9


def test_discounts():
    assert np.allclose(katz.discounts(np.array([100, 40, 20, 12, 8, 6.0]))[1:3], [(2 * 40 / 100 - 0.36) / 0.64, (3 * 20 / 80 - 0.36) / 0.64])
    d = katz.discounts(np.array([100, 40, 20, 12, 8, 6.0]))
    assert d[0] == 1 and ((d[1:] > 0) & (d[1:] <= 1)).all()
    assert katz.discounts(np.array([5, 9, 0, 0, 0, 0.0])).tolist() == [1] * 6  # nothing to go by


@pytest.mark.parametrize("rows", [[], [(1, "a b a", False, 1, 1), (2, None, None, 1, 1)]])
def test_without_training_rows(spark, rows):
    found = katz.scores(spark.createDataFrame(rows, SCHEMA), F.col("learn"), 2).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in found) == [(1, 4, 0, 0, 0.0), (2, 1, 0, 0, 0.0)][: len(rows)]
