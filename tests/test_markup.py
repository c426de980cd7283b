"""Pages read as elements: layouts of cards, broken markup, selectors; and what is derived from matches and audits."""

import random
from collections import defaultdict

import pytest

from dealforge.operators import resolve as R
from dealforge.sources import landed as L
from dealforge.sources.markup import parse

CARDS = [
    # Title in the link's attribute, attributes in any order, the price nested.
    '<article data-x=1 class="a product-miniature b"><h3 class="product-title big"><a title="Pala &amp; Uno" href="https://c/1">x</a></h3><div class="product-price"><b>1.299,95</b> €</div><del>1.400,00 €</del><img src="https://c/1.jpg?w=2"></article>',
    # Title from the text, single quotes, no quotes, a lazy image.
    "<div class=js-product-miniature><h2 class='product-title'><a href='https://c/2'>Pala\n <i>Dos</i></a></h2><span itemprop=price>99,90 €</span><img data-src='https://c/2.jpg' src='data:x'></div>",
    # No title element: the first link with a title and no class; sold out by a class inside.
    '<div class="product-miniature"><a class="thumb" title="image" href="https://c/no"><img src="data:y"></a><a title="Pala Tres" href="https://c/3">t</a><span class="price">80,00</span><p class="is-out-of-stock-now"></p></div>',
    # Sold out by a flag; an unclosed tag and a stray end.
    '<article class="product-miniature"></b><p class="product-flag">Fuera de stock<h2 class="product-title"><a href="https://c/4">Pala Cuatro</a></h2><span class="price">50,00</span></article>',
    # Left out: no link to a page, no price, under the floor.
    '<article class="product-miniature"><h2 class="product-title"><a href="/5">Pala</a></h2><span class="price">50,00</span></article>',
    '<article class="product-miniature"><h2 class="product-title"><a href="https://c/6">Pala</a></h2></article>',
    '<article class="product-miniature"><h2 class="product-title"><a href="https://c/7">Pala</a></h2><span class="price">29,99</span></article>',
]


def test_each_layout_of_a_card(spark):
    pages = spark.createDataFrame([("s", 1, "<!doctype html><html><body>" + "".join(CARDS) + "<script>'<article class=\"product-miniature\">'</script>"), ("s", 2, None), ("s", 3, "< <<p")], "store string, page int, body string")
    got = {r.url: (r.title, float(r.price), r.list_price and float(r.list_price), r.image, r.available) for r in L.card_offers(pages).collect()}
    assert got == {
        "https://c/1": ("Pala & Uno", 1299.95, 1400.0, "https://c/1.jpg", True), "https://c/2": ("Pala Dos", 99.9, None, "https://c/2.jpg", True), "https://c/3": ("Pala Tres", 80.0, None, None, False), "https://c/4": ("Pala Cuatro", 50.0, None, None, False),
    }


def test_selectors():
    page = parse('<div id=a class="x y"><p class=y>1<p title="k v">2</div><p class="x">3</p><br><a href="/x/1?q">4</a>')
    texts = lambda s: [e.text() for e in page.find(s)]
    assert texts(".x.y p") == ["12", "2"] and texts("p.x, a") == ["3", "4"] and texts('a[href*="/x/"]') == ["4"] and texts('[title="k v"]') == ["2"] and texts("div .x") == [] and texts("* p[title]") == ["2"]
    with pytest.raises(ValueError):
        page.find("a > b")


def test_deep_pages_do_not_break():
    page = parse("<div>" * 50_000 + "x")
    assert page.text() == "x" and len(page.find("div")) == 50_000


def test_tail_of_a_name_goes(spark):
    from datetime import datetime

    body = '{"products": [{"name": "Nox AT10 Padel - Pala de adulto", "url": "https://m/1", "price": 99.0, "categories": [3]}, {"name": "Padel Nox", "url": "https://m/2", "price": 99.0, "categories": [3]}]}'
    pages, details = spark.createDataFrame([("m", 1, body)], "store string, page int, body string"), spark.createDataFrame([], "url string, body string")
    assert sorted(r.title for r in L.hit_offers(pages, details, 3, datetime(2024, 1, 1), "zapatilla").collect()) == ["Nox AT10", "Padel Nox"]


def test_pending_equals_pairs(spark):
    rng = random.Random(4)
    attributes = lambda: ("B", rng.choice(["l", "L", "m", None]), rng.choice([None, "", "a", "A", "b", "*"]), rng.choice([None, "WOMAN", "w"]), rng.choice([None, 2024, 2025]))
    kind = "brand string, line string, model string, variant string, year int"
    candidates, items = [(n, *attributes()) for n in range(120)], [(n, *attributes()) for n in range(40)]
    low = lambda x: (x or "").lower()
    fits = defaultdict(list)
    for c in candidates:
        for p in items:
            if c[2] and p[2] and low(c[2]) == low(p[2]) and (not c[3] or not p[3] or low(c[3]) == low(p[3])) and c[4] == p[4] and (c[5] is None or p[5] is None or c[5] == p[5]):
                fits[c[0]].append(p[0])
    got = {r.candidate_id: (r.item_id, r.state) for r in R.resolve_pending(spark.createDataFrame(candidates, "candidate_id int, " + kind), spark.createDataFrame(items, "item_id int, " + kind)).collect()}
    assert got == {c[0]: (fits[c[0]][0], "matched") if len(fits[c[0]]) == 1 else (None, "ambiguous" if fits[c[0]] else "pending") for c in candidates}


def test_fixes_by_how_many_they_mend_and_products_touched(spark):
    audit = spark.createDataFrame([(1, "false_positive", "missing_telling", ["hrd", "x"]), (2, "false_positive", "missing_telling", ["hrd"]), (3, "false_positive", "missing_telling", ["hrd"]), (4, "false_positive", "ratio", []), (5, "correct", None, None)], "title_id int, verdict string, suggestion string, words array<string>")
    fixes, words = R.matcher_fixes(audit)
    assert sorted(map(tuple, fixes.collect())) == [("missing_telling", "hrd", 2), ("missing_telling", "hrd x", 1), ("ratio", "", 1)] and sorted(map(tuple, words.collect())) == [("hrd", 3), ("x", 1)]
    matches = spark.createDataFrame([(1, 10, "kept"), (2, 11, "matched"), (3, None, "nullified"), (4, None, "unmatched"), (5, 13, "matched")], "listing_id int, item_id int, outcome string")
    listings = spark.createDataFrame([(1, 10), (2, 12), (3, 14), (4, None), (5, None)], "listing_id int, item_id int")
    assert sorted(r.item_id for r in R.affected(matches, listings).collect()) == [11, 12, 13, 14]
