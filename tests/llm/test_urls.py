"""The URL models against exact counts in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from dealforge.llm import urls


def test_scores_against_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 300)  # so that most grams are joined
    rng = random.Random(2)
    texts = [f"https://{rng.choice(['a.org', 'b.com', 'example.org', 'x.net'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randrange(10**7)}" for _ in range(600)] + ["", "é"]
    held = {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").selectExpr("t", "pmod(xxhash64(t), 5L) = 0 AS h").collect()}
    got = urls.judge(spark.createDataFrame(list(enumerate(texts)), "page_id bigint, url string")).collect()
    ruled = {r.page_id: r.verdict for r in got if r.rule}
    n = [[Counter() for _ in range(5)] for _ in "01"]
    line = lambda t: [255] * 4 + list(t.encode()) + [254]
    for i, v in ruled.items():
        if not held[texts[i]]:
            s = line(texts[i])
            for at in range(4, len(s)):
                for k in range(5):
                    n[v == "allow"][k][tuple(s[at - k : at + 1])] += 1
    followers, total = [[defaultdict(int) for _ in range(5)] for _ in "01"], [[Counter() for _ in range(5)] for _ in "01"]
    for side in (0, 1):
        for k in range(5):
            for g, c in n[side][k].items():
                followers[side][k][g[:-1]] += 1
                total[side][k][g[:-1]] += c

    def p(side, s, at):
        low = 1 / 256
        for k in range(5):
            g = tuple(s[at - k : at + 1])
            d, t = followers[side][k].get(g[:-1], 0), total[side][k][g[:-1]]
            low = (n[side][k][g] + d * low) / (t + d) if t else low
        return low

    for r in got:
        s = line(texts[r.page_id])
        want = sum(math.log(p(1, s, at)) - math.log(p(0, s, at)) for at in range(4, len(s))) / (len(s) - 4)
        assert r.url_score == pytest.approx(want, abs=1e-9)


def test_threshold_has_the_least_balanced_error(spark):
    rng = random.Random(5)
    rows = [(True, rng.gauss(0.6, 0.8)) for _ in range(150)] + [(False, rng.gauss(-0.7, 0.8)) for _ in range(40)]

    def wrong(t):
        sides = [[s for a, s in rows if a == kind] for kind in (True, False)]
        return sum(s < t for s in sides[0]) / len(sides[0]) + sum(s >= t for s in sides[1]) / len(sides[1])

    got = urls.threshold_of(spark.createDataFrame(rows, "accepted boolean, url_score double"))
    assert wrong(got) == pytest.approx(min(wrong(b / urls.BINS * 8 - 4) for b in range(urls.BINS + 1)))


def test_threshold_of_one_side_is_zero(spark):
    assert urls.threshold_of(spark.createDataFrame([(True, 1.5)], "accepted boolean, url_score double")) == 0.0
