"""Worked examples: each rung of the attribute ladder, the word matcher, landed snapshots and pages."""

import datetime

from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators import matching as M
from dealforge.operators import resolve as R
from dealforge.sources import landed as L

ITEM = "item_id bigint, brand string, line string, variant string, model string, year int"
ASKED = "offer_id bigint, brand string, line string, variant string, model string, year int, player string"


LADDER = [
        # An equal variant by another name, and a line by another name.
        (("B", "jr", "Control", "x", 2025, None), [(1, "B", "Junior", "ctrl", "X", 2025), (2, "B", "Junior", "air", "X", 2025)], [1]),
        # Without a model in the title, a row whose model is the title's variant.
        (("B", "L", "Hybrid", None, None, None), [(1, "B", "L", None, "hyb", 2025), (2, "B", "L", "air", None, 2025)], [1]),
        # The player's name in place of the model, only if the model finds nothing.
        (("B", "L", None, "signature zz", 2025, "Tapia"), [(1, "B", "L", None, "Tapia", 2025), (2, "B", "L", None, "Other", 2025)], [1]),
        # Words dealt to model and variant in another way: only by signature.
        (("B", "L", "woman", "light", 2025, None), [(1, "B", "L", "light", "W 25", 2025), (2, "B", "L", "x", "y", 2025)], [1]),
        # The row with just the title's words.
        (("B", "L", None, "bold", 2025, None), [(1, "B", "L", None, "Bold", 2025), (2, "B", "L", None, "Bold extra", 2025)], [1]),
        # The single row of the title's year, beside one without a year.
        (("B", "L", None, "bold", 2025, None), [(1, "B", "L", None, "Bold", 2025), (2, "B", "L", None, "Bold", None)], [1]),
        # Without a year the newest of rows that differ in nothing else.
        (("B", "L", None, "bold", None, None), [(1, "B", "L", None, "Bold", 2024), (2, "B", "L", None, "Bold", 2026)], [2]),
        # Rows that differ in colour: the one without, as the title has none.
        (("B", "L", None, "bold one", 2025, None), [(1, "B", "L", None, "Bold one red", 2025), (2, "B", "L", None, "Bold one blue", 2025), (3, "B", "L", None, "Bold", 2025)], [1, 2, 3]),
        (("B", "L", None, None, 2025, None), [(1, "B", "L", None, None, 2025), (2, "B", "L", None, "superficie", 2025)], [1, 2]),
        # Nothing fits.
        (("B", "L", None, "bold carbon", 2025, None), [(1, "B", "L", None, "Bold", 2025)], []),
]


def test_attribute_ladder(spark):
    """Each case has a brand and ids of its own."""
    asked = [(n, f"B{n}", *a[1:]) for n, (a, _, _) in enumerate(LADDER)]
    items = [(100 * n + i[0], f"B{n}", *i[2:]) for n, (_, rows, _) in enumerate(LADDER) for i in rows]
    got = M.attribute_candidates(spark.createDataFrame(asked, ASKED), spark.createDataFrame(items, ITEM)).collect()
    for n, (_, _, expected) in enumerate(LADDER):
        assert sorted(r.item_id - 100 * n for r in got if r.offer_id == n) == expected, n


def test_title_and_model_examples(spark):
    rows = spark.createDataFrame([("Vertex 04W Hard Pro+ 226", "Vertex mujer negra raqueta series", "W 25", "mujer")], "a string, b string, c string, d string")
    got = rows.select(X.title_tokens(F.col("a")), X.model_tokens(F.col("b")), X.signature(F.col("c"), F.col("d"), F.lit(2025))).first()
    assert tuple(got) == (["vertex", "04", "woman", "hrd", "proplus", "226"], ["vertex", "woman", "black"], "woman")


def test_model_compatible(spark):
    cases = [("Bold", "Bold soft", False), ("Bold", "Bold black", False), ("Bold", "Bold red", True), (None, "yellow", True), (None, "25", True), (None, "3", False), ("3.4", None, True), ("Superficie completa", "", True), ("Bold", None, False), ("Bolds", "Bold", True)]
    rows = spark.createDataFrame([(n, c, t) for n, (c, t, _) in enumerate(cases)], "n int, c string, t string")
    got = rows.select("n", M.model_compatible(F.col("c"), F.col("t"), F.lit(2025), F.lit(None).cast("int")).alias("fits")).orderBy("n").collect()
    assert [r.fits for r in got] == [fits for _, _, fits in cases]


CATALOGUE = [(1, "Bullpadel", "Neuron", None, "02", 2026), (2, "Bullpadel", "Neuron", None, None, 2025), (3, "Adidas", "Metalbone", None, "3.3", 2025), (4, "Adidas", "Metalbone", None, "3.4", 2025), (5, "Adidas", "Drive", None, "Blue", 2026), (6, "Adidas", "Drive", None, "Black", 2026)]


def test_fuzzy_match(spark):
    cases = [
        ("Bullpadel Neuron", "https://s/pala-bullpadel-neuron-02/", (1, 0.95, "fuzzy")),  # generation from the url
        ("Bullpadel Neuron 2025", None, (2, 1.0, "fuzzy")),
        ("Adidas Drive Blue 2026", None, (5, 1.0, "fuzzy")),
        ("Adidas Drive", None, (None, 0.8, "needs_review")),  # two colours are left
        ("Adidas Drive Carbon 2026", None, (None, 0.5, "needs_review")),  # a telling word is left over
        ("Unknown thing", None, (None, 0.0, "no_match")),
        (None, None, (None, 0.0, "no_match")),
    ]
    rows = spark.createDataFrame([(n, t, u) for n, (t, u, _) in enumerate(cases)], "title_id bigint, title string, url string")
    got = R.fuzzy_match(rows, spark.createDataFrame(CATALOGUE, ITEM)).orderBy("title_id").collect()
    assert [(r.item_id, r.confidence, r.method) for r in got] == [expected for _, _, expected in cases]


def test_snapshot_lives_two_hours(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made))

    now = datetime.datetime(2026, 1, 1, 12)
    path = str(tmp_path / "snap")
    for hour, rows in ((0, 1), (1, 1), (3, 2)):
        assert L.snapshot(spark, path, build, now + datetime.timedelta(hours=hour)).count() == rows


def test_broken_pages_give_no_rows(spark):
    pages = spark.createDataFrame([("s", 1, None), ("s", 2, ""), ("s", 3, "{"), ("s", 4, "<html>")], "store string, page int, body string")
    for rows in (L.shop_products(pages, F.lit("https://s")), L.store_api_products(pages), L.card_offers(pages), L.facet_offers(pages), L.section_offers(pages, F.lit("https://s")), L.thumb_offers(pages), L.catalogue_rows(pages)):
        assert rows.count() == 0


PREPARED = [
    # Shop words, a plus sign, a year written 2.6 and a product code.
    ("Pala de pádel Nox Raptor+ 2.6 228272", ("Nox", "Raptor", None, 2026, "plus", None)),
    # A generation gives the year, and the model if nothing else is left.
    ("Adidas Metalbone 3.4", ("Adidas", "Metalbone", None, 2025, "3.4", None)),
    ("Adidas Metalbone 3.4 2024", ("Adidas", "Metalbone", None, 2024, "3.4", None)),
    # A woman's name or a lone W stands for the variant, but only if there is none.
    ("Adidas Metalbone Bold by Ale Salazar", ("Adidas", "Metalbone", "WOMAN", None, "bold", "Ale Salazar")),
    ("Adidas Metalbone Ctrl by Ale Salazar", ("Adidas", "Metalbone", "CTRL", None, "", "Ale Salazar")),
    ("Adidas Metalbone 04 W Premier 25", ("Adidas", "Metalbone", "WOMAN", 2025, "04 premier", None)),
    ("Adidas Metalbone Élite 1.0 - Superficie completa, Raqueta de segunda mano", ("Adidas", "Metalbone", None, None, "elite 1.0", None)),
    # Without a known line the first word left; without words the player.
    ("Nox Unknown Thing", ("Nox", "Unknown", None, None, "thing", None)),
    ("Nox Ale Salazar Ctrl", ("Nox", "Ale Salazar", "CTRL", None, "", None)),
    ("nothing known", (None, None, None, None, "nothing known", None)),
    (None, (None, None, None, None, "", None)),
]


def test_attributes_of_prepared_titles(spark):
    words = [("brand", "nox", "Nox", 1), ("brand", "adidas", "Adidas", 1), ("line", "raptor", "Raptor", 1), ("line", "metalbone", "Metalbone", 1), ("variant", "ctrl", "CTRL", 1), ("player", "ale salazar", "Ale Salazar", 1), ("woman", "ale salazar", "Ale Salazar", 1)]
    titles = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(PREPARED)], "offer_id int, title string")
    out = M.extract_attributes(titles, spark.createDataFrame(words, "kind string, alias string, value string, priority int"), guess_line=True)
    got = {r.offer_id: (r.brand, r.line, r.variant, r.year, r.model, r.player) for r in out.collect()}
    for n, (title, expected) in enumerate(PREPARED):
        assert got[n] == expected, title


def test_nearest_by_chunks(spark):
    """Equal to brute force for a block of many chunks and join keys, with ties, repeats and nulls."""
    import random

    deal = random.Random(7)
    rows = [(i, i % 10 == 0, [float(deal.randint(-3, 3)) for _ in range(4)]) for i in range(400)] + [(1000, False, None), (1001, True, None), (3, False, [1.0, 1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, label boolean, embedding array<double>")
    got = {r.query_id: (r.best_id, round(r.best, 9), round(r.second, 9)) for r in M.two_nearest(v.filter("vec_id % 50 = 0"), v, "label", chunk=8, spread=4).collect()}

    def sim(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    for i, label, q in rows:
        if i % 50 == 0 and q:
            near = sorted((-round(sim(q, e), 9), j) for j, other, e in rows if other == label and j != i and e)
            assert got[i][1:] == (-near[0][0], -near[1][0]) and got[i][0] in {j for far, j in near if far == near[0][0]}
    assert 1000 not in got
