"""Stop lists, chains of absorption and dictionaries tied to brands."""

from dealforge.operators import matching as M
from dealforge.operators import stoplists as S


def test_ways_and_order(spark):
    titles = [
        "Pack Nox", "Pala ROX Sparky", "Mirox padel", "Pala HBL Strike", "Kit pala", "Pala Nox kit", "Pala Nox Kits", "Zapatillas Asics", "Pala reacondicionada", "pala + raquetera", "Más  raquetera", "Futura pack", None, "", "Pala Nox AT10",
    ]
    got = S.stopped(spark.createDataFrame(list(enumerate(titles)), "title_id int, title string"), S.stop_list(spark, S.SHOP_CLASSES)).collect()
    assert {r.title_id: (r["class"], r.phrase) for r in got} == {
        0: ("prefix", "pack "), 1: ("brand", "rox "), 3: ("brand", "hbl "), 5: ("bundle", "kit"), 7: ("clothing", "zapatillas"), 8: ("used", "reacondicionad"), 9: ("bundle", "+ raquetera"), 10: ("bundle", "mas raquetera"), 11: ("unlisted", "futura"),
    }


def test_exclusions_of_one_model(spark):
    rows = [(1, "Vertex 03 comfort", "vertex"), (2, "Hack comfort", "hack"), (3, "Niño vertex", "vertex"), (4, "J.R. hack", None)]
    more = spark.createDataFrame([("own", "word", "comfort", 9, 0, "vertex")], "class string, way string, phrase string, place int, nth int, model string")
    phrases = S.stop_list(spark, S.LISTING_CLASSES).unionByName(more, allowMissingColumns=True)
    got = S.stopped(spark.createDataFrame(rows, "title_id int, title string, model string"), phrases).collect()
    assert {r.title_id: r.phrase for r in got} == {1: "comfort", 3: "niño", 4: "j.r"}


def test_chain_of_models_ends_in_one_group(spark):
    """abcd is close to abcde and that to abcdef, but abcd is not close to abcdef."""
    item = "item_id int, brand string, line string, model string, variant string, year int"
    rows = [(1, "B", "L", "abcd", None, 2025), (2, "B", "L", "abcde x", None, 2025), (3, "B", "L", "abcdef x y", None, 2025), (4, "B", "L", "abcd q", None, 2024), (5, "B", "M", "abcdef x y", None, 2025), (6, "B", "L", "zz abcdef x", None, None)]
    got = {r.item_id: (r.keep_id, r.key) for r in M.duplicate_groups(spark.createDataFrame(rows, item)).collect()}
    assert got.keys() == {1, 2, 3} and {k for k, _ in got.values()} == {1} and len({k for _, k in got.values()}) == 1


def test_absorption_equals_plain_chasing(spark):
    import random

    rng = random.Random(7)
    words = ["alfa", "alfas", "alfass", "beta", "betas", "x", "y"]
    texts = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    close = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) == 1 and (a.startswith(b) or b.startswith(a)))
    within = lambda a, b: all(any(close(t, u) for u in b.split()) for t in a.split())
    size = lambda t: len(t.split())
    into = {}
    for t in texts:
        takers = [u for u in texts if (size(t), t) < (size(u), u) and within(t, u)]
        if takers:
            into[t] = min(takers, key=lambda u: (-size(u), u))
    end = lambda t: end(into[t]) if t in into else t
    got = M.absorbed(spark.createDataFrame([("k", t) for t in texts], "k string, text string"), ["k"], "text").collect()
    assert {r.text: r.into for r in got} == {t: end(t) for t in into}


def test_lines_count_in_titles_of_their_brand(spark):
    entries = [("brand", "head", "Head", 1, None), ("brand", "adidas", "Adidas", 1, None), ("brand", "vibora", "Vibor-A", 1, None), ("line", "vibe", "Vibe", 2, "Head"), ("line", "vive", "Vive", 3, "Head"), ("line", "cross it", "Cross It", 2, "Adidas"), ("line", "crossit", "Cross It", 3, "Adidas"), ("line", "drive", "Drive", 4, "Adidas"), ("line", "yarara", "Yarara", 2, "Vibor-A"), ("line", "one", "One", 9, "Head")]
    dictionary = spark.createDataFrame(entries, "kind string, alias string, value string, priority int, brand string")
    titles = ["Head Vibe 2025 Gris/Negro", "Adidas Cross It 3.4 2025", "Vibora Yarara Pro White 2025", "Head Drive 2026", "Adidas Vibe", "Adidas Drive Cross It", "Vibe sin marca", "Head One Vive 2026"]
    got = M.extract_attributes(spark.createDataFrame(list(enumerate(titles)), "offer_id int, title string"), dictionary).collect()
    assert {r.offer_id: (r.brand, r.line, r.year) for r in got} == {
        0: ("Head", "Vibe", 2025), 1: ("Adidas", "Cross It", 2025), 2: ("Vibor-A", "Yarara", 2025), 3: ("Head", None, 2026), 4: ("Adidas", None, None), 5: ("Adidas", "Cross It", None), 6: (None, None, None), 7: ("Head", "Vive", 2026),
    }
