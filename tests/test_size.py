"""What grows with a table is dealt, not broadcast, and copies are met as one class: against plain Python."""

import pytest

from dealforge.operators import groups as G
from dealforge.operators import matching as M
from dealforge.operators import resolve as R
from dealforge.operators import stoplists as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Titles and a catalogue in small files, whose sizes say little about the rows that they hold."""
    folder = tmp_path_factory.mktemp("stored")
    titles = spark.range(2000).selectExpr("id as title_id", "id as offer_id", "concat('Acme', id % 7, ' falcon pack zapatillas ', id % 3) as title", "cast(null as string) as url")
    items = spark.range(300).selectExpr("id as item_id", "concat('Acme', id % 7) as brand", "'falcon' as line", "cast(null as string) as variant", "cast(id % 3 as string) as model", "2025 as year", "concat('falcon ', id % 3) as name")
    titles.write.parquet(str(folder / "titles"))
    items.write.parquet(str(folder / "items"))
    return spark.read.parquet(str(folder / "titles")), spark.read.parquet(str(folder / "items"))


def test_exploded_titles_are_not_broadcast(spark, stored):
    titles, items = stored
    found = [M.extract_attributes(titles, M.dictionary_of(items)), R.detect_brands(titles, items), S.stopped(titles, S.stop_list(spark, S.SHOP_CLASSES))]
    for df in found:
        assert "BuildLeft" not in plan(df)
        assert df.count() == 2000


def test_a_long_dictionary_is_dealt(spark, stored):
    titles, _ = stored
    rows = titles.selectExpr("title_id", "split(title, ' ')[0] as w")
    words = rows.selectExpr("w", "w as value").distinct()
    long, short = G.looked_up(rows, words, "w", most=3), G.looked_up(rows, words, "w")
    assert "Broadcast" not in plan(long) and "BroadcastHashJoin" in plan(short)
    assert long.count() == short.count() == 2000


def test_catalogue_of_the_word_matcher_is_not_broadcast(stored):
    """Only the dictionary of brands may be; and copies of a product count as often as they stand in the catalogue."""
    titles, items = stored
    out = R.fuzzy_match(titles, items)
    assert all("[run#" in line for line in plan(out).splitlines() if "BroadcastHashJoin" in line)
    same = [i for i in range(300) if i % 7 == 1 and i % 3 == 1]
    row = out.filter("title_id = 1").first()
    assert (row.method, row.candidates) == ("needs_review", same)


def test_copies_are_met_once(spark):
    """Answers where each row has many copies, against plain Python over all pairs."""
    words = ["red hawk", "red owl", "blue hawk fast", "blue owl", "red hawk hawk"]
    rows = [(i, f"B{i % 2}", words[i % 5]) for i in range(60)]
    names = spark.createDataFrame(rows, "item_id int, brand string, name string")
    share = lambda a, b: sum(w in b.split() for w in a.split()) / len(a.split())
    for least in (0.5, 0.0):
        near = {(i, j, round(r, 9)) for i, b, a in rows for r, j in sorted(((share(a, o), j) for j, c, o in rows if c == b and j != i and share(a, o) >= least), key=lambda x: (-x[0], x[1]))[:5]}
        assert {(r.item_id, r.other_id, round(r.ratio, 9)) for r in M.near_names(names, names, ["brand"], least=least).collect()} == near
    like = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    best = {i: min((-like(a, o), j) for j, c, o in rows if c == b and j != i) for i, b, a in rows}
    assert {r.broken_id: (-r.score, r.item_id) for r in M.best_by_jaccard(names, names).collect()} == best


def test_near_candidates_asks_for_every_row(spark):
    """Not only for each fiftieth id: the query against plain Python over all pairs."""
    from dealforge.plans import more
    from dealforge.sources.tables import catalogue

    sf = "/root/testdata/sf0.001"
    rows = [(r.item_id, r.brand, r.name.split(" ")) for r in catalogue(spark, sf).collect()]
    near = set()
    for i, b, t in rows:
        shares = ((sum(w in o for w in t) / len(t), j) for j, c, o in rows if c == b and j != i)
        near |= {(i, j, r) for r, j in sorted((x for x in shares if x[0] >= 0.5), key=lambda x: (-x[0], x[1]))[:5]}
    got = {tuple(r) for r in more.near_candidates(spark, sf).collect()}
    assert got == near and any(i % 50 for i, _, _ in got)


def test_near_names_of_any_length(spark):
    """Short and long names, words that repeat, rows without an id: against plain Python over all pairs."""
    import random

    deal = random.Random(4)
    rows = [(i, f"B{i % 2}", " ".join(deal.choices("abcdefghi", k=deal.randint(1, 9)))) for i in range(150)]
    names = spark.createDataFrame(rows + [(None, "B0", name) for _, _, name in rows[:20] * 6], "item_id int, brand string, name string")
    share = lambda a, b: sum(w in b.split() for w in a.split()) / len(a.split())
    for least, n in ((0.5, 5), (0.3, 2), (1.0, 3)):
        near = {(i, j, round(r, 9)) for i, b, a in rows for r, j in sorted(((share(a, o), j) for j, c, o in rows if c == b and j != i and share(a, o) >= least), key=lambda x: (-x[0], x[1]))[:n]}
        got = [(r.item_id, r.other_id, round(r.ratio, 9)) for r in M.near_names(names, names, ["brand"], least=least, n=n).collect()]
        assert set(got) == near and len(got) == len(near)


def test_names_that_share_a_word_are_not_paired(spark):
    """2,000 names that differ in one of two words: no join makes pairs of all of them."""
    names = spark.range(2000).selectExpr("id as item_id", "'B' as brand", "concat('red x', id) as name")
    out = M.near_names(names, names, ["brand"])
    assert out.filter("item_id = 7").count() == 5
    out.collect()
    todo, most = [out._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        below = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        todo += below
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
    assert 2000 <= most <= 50000


ITEM = "item_id int, brand string, line string, variant string, model string, year int"


def test_copies_of_rows_and_titles_in_the_ladder(spark):
    """Counted as often as they stand in the catalogue; ids that repeat are weighed together; equal rows of one id count once."""
    rows = [(n, "B", "L", "v", "bold", y) for n, y in enumerate([2024, 2025, 2025, None, 2026, 2026])]
    items = spark.createDataFrame(rows + rows[:1], ITEM)
    asked = [(1, 2025), (2, 2025), (3, None), (4, None), (5, 2024), (6, 2030), (7, 2024), (7, 2025)]
    found = spark.createDataFrame([(i, "B", "L", "v", "bold", y) for i, y in asked], "offer_id int, brand string, line string, variant string, model string, year int")
    expected = {1: [1, 2, 3], 2: [1, 2, 3], 3: [4], 4: [4], 5: [0], 6: [3]}
    got = {}
    for r in M.attribute_candidates(found, items).collect():
        got.setdefault(r.offer_id, []).append(r.item_id)
    assert {i: sorted(j) for i, j in got.items() if i < 7} == expected
    counts = {r.offer_id: (r.n, r.hit) for r in M.attribute_counts(found, items).collect()}
    assert {i: c for i, c in counts.items() if i < 7} == {i: (len(j), min(j)) for i, j in expected.items()} and counts[7] == (len({*got[7]}), min(got[7]))


def test_pairs_of_kinds_with_copies(spark):
    rows = [(n, "B", "L", v, m, y) for n, (v, m, y) in enumerate([("v", "bold", 2025), ("v", "bold", 2025), ("v", "bold", None), ("v", "bold", 2024), (None, "bold v", 2025), ("v", "other", 2025)])]
    got = M.duplicate_pairs(spark.createDataFrame(rows, ITEM), spark.createDataFrame([(1,), (2,)], "item_id int")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, "SAFE_DELETE"), (0, 2, "SAFE_DELETE"), (2, 1, "NEEDS_MERGE"), (3, 2, "SAFE_DELETE"), (4, 0, "SAFE_DELETE"), (4, 1, "SAFE_DELETE"), (4, 2, "SAFE_DELETE")]


def test_under_own_reference_leaves_no_listing_out(spark):
    """Each fourth listing counts too; with `sure` the operator still asks for a confidence."""
    from dealforge.operators import ranking
    from dealforge.plans import relational

    got = relational.under_own_reference(spark, "/root/testdata/sf0.001")
    assert got.filter("listing_id % 4 = 0").count() > 0
    rows = spark.createDataFrame([(1, 5.0, 10.0, 0.95), (2, 5.0, 10.0, 1.0), (3, 9.0, 10.0, 1.0)], "listing_id int, price double, reference double, confidence double")
    assert [r.listing_id for r in ranking.under_reference(rows, 0.65, sure=1.0).collect()] == [2] and ranking.under_reference(rows, 0.65).count() == 2


def test_copies_of_vectors_are_equally_like(spark):
    """Copies in different chunks tie to the last bit, the least id first; vectors of another length or with nulls are no match."""
    rows = [(i, 1, [0.1 * (i % 3), 0.7, 0.3, 0.9]) for i in range(150)] + [(200, 1, [1.0, 2.0]), (201, 1, [0.1, None, 0.3, 0.9])]
    v = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = {r.query_id: (r.best_id, r.best, r.second) for r in M.two_nearest(v.filter("vec_id % 50 = 0"), v, "label", chunk=7).collect()}
    assert {q: g[0] for q, g in got.items()} == {0: 3, 50: 2, 100: 1} and all(best == second for _, best, second in got.values())


def test_products_of_one_name_are_not_broadcast(stored):
    """The n of least id of each name are enough for the n closest."""
    titles, items = stored
    out = R.closest_names(titles.filter("title_id < 14"), items, n=4)
    assert all("[run#" in line or "[brand#" in line and "parts" in line for line in plan(out).splitlines() if "BroadcastHashJoin" in line and ", b#" in line)
    first = [i for i in range(300) if i % 7 == 1 and i % 3 == 1][:4]
    assert [r.item_id for r in out.filter("title_id = 1").orderBy("place").collect()] == first


def test_spec_pages_are_searched_once(spark, stored):
    from dealforge.sources import landed as L

    page = "<dl><dt>Peso</dt><dd>-</dd><dt>Forma</dt><dd>x</dd><dt>forma</dt><dd>Redonda</dd><dt>Cara</dt><dd>a</dd><dt>Cara</dt><dd>-</dd></dl>"
    got = L.spec_fields(stored[0].selectExpr("title_id", f"concat('{page}', title) as body"), ["title_id"])
    assert plan(got).count("regexp_extract_all(concat(") + plan(got).count("regexp_extract_all(body") <= 6
    row = got.first()
    assert (row["shape"], row.face, row.low_weight) == ("Redonda", None, None)
