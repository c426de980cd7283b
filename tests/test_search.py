"""Standing alerts, opportunity flags and nearest names against plain Python."""

import random
from collections import Counter

from dealforge.operators import ranking
from dealforge.operators import resolve as R

LISTING = "listing_id int, title string, price int, condition string"


def test_flags_on_each_side_of_each_limit(spark):
    rows = [(n, "x", 100, "new") for n in range(6)] + [(10, "x", 20, "fair"), (11, "x", 5, "new"), (12, "x", 74, "as_good_as_new"), (13, "x", 75, "new"), (14, "x", None, "new"), (15, "x", 10, None), (16, "x", 10, "un_opened")]
    got = {r.listing_id for r in ranking.search_flags(spark.createDataFrame(rows, LISTING)).collect() if r.opportunity}
    assert got == {12, 16}  # a median of 100: 75 is not under its share, fair and cheaper than 10 are none
    few = ranking.search_flags(spark.createDataFrame(rows[:3] + rows[-1:], LISTING)).collect()
    assert not any(r.opportunity for r in few)


def test_alerts_by_class(spark):
    rng = random.Random(1)
    words = ["red", "blue", "ring", "steel", "Ñu", "old"]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, *range(0, 60, 7)]), rng.choice(["new", "good", None])) for n in range(80)] + [(90, None, 5, "new")]
    alerts = [(n, " ".join(rng.choices(words, k=rng.randint(0, 3))), rng.choice(["new", None]), rng.choice([None, 7, 21, 50])) for n in range(150)] + [(200, None, None, 5), (201, "nowhere red", None, None)]
    told = [(rng.randint(0, 150), rng.randint(0, 80)) for _ in range(300)]
    plain = lambda t: sorted(set((t or "").lower().replace("ñ", "n").split()))
    wanted = Counter()
    for a, query, condition, most in alerts:
        for i, title, price, had in rows:
            if plain(query) and set(plain(query)) <= set(plain(title)) and price is not None and (most is None or price <= most) and condition in (None, had) and (a, i) not in told:
                wanted[tuple(plain(query)), condition, i] += 1
    got = ranking.alert_matches(spark.createDataFrame(alerts, "alert_id int, query string, condition string, max_price int"), spark.createDataFrame(rows, LISTING), spark.createDataFrame(told, "alert_id int, listing_id int"))
    assert {(tuple(r.words), r.condition, r.listing_id): r.n_alerts for r in got.collect()} == wanted


def plain_jaro_winkler(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return float(a == b)
    second = [c for c, t in zip(b, taken) if t]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def test_nearest_names_equal_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdehilnorst 0123é", k=rng.randint(0, 14)))
    names, asked = sorted({word() for _ in range(400)}), [word() for _ in range(40)] + ["", "aaaa", "é"]
    got, _ = R.nearest_names(asked, names, 8)
    for a in set(asked):
        best = sorted(((-plain_jaro_winkler(a, b), b) for b in names))[:8]
        mine = [(s, b) for x, b, s in got[: len(got)] if x == a][:8]
        assert [round(s, 9) for s, _ in mine] == [round(-s, 9) for s, _ in best] and {b for _, b in mine[:7] if best[7][0] < best[6][0]} == {b for _, b in best[:7] if best[7][0] < best[6][0]}


def test_bounds_leave_most_names_unscored():
    rng = random.Random(5)
    brand = ["vertex", "hack", "flow", "neuron", "ionic", "wonder", "indiga", "elite", "pearl", "icon"]
    names = sorted({f"{rng.choice(brand)} {rng.randint(1, 9)} {''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=6))} {2018 + rng.randint(0, 8)}" for _ in range(4000)})
    asked = [n + "x" for n in rng.sample(names, 50)]
    _, scored = R.nearest_names(asked, names, 8)
    assert scored * 10 <= len(asked) * len(names)


def test_empty_blocks():
    assert R.nearest_names([], ["a"], 3) == ([], 0) and R.nearest_names(["a"], [], 3) == ([], 0)
