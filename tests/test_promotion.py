"""Promotion within a run: ties, slugs and likeness against plain Python."""

import random

import pytest

from dealforge.operators import groups as G
from dealforge.operators import resolve as R

ITEM = "item_id int, brand string, line string, variant string, model string, year int, name string, slug string"
CANDIDATE = "candidate_id int, title string, sources array<string>"
TWO = ["a", "b"]


@pytest.fixture(scope="module")
def words(spark):
    rows = [("brand", "nox", "Nox", 1), ("brand", "siux", "Siux", 1), ("line", "raptor", "Raptor", 2), ("line", "diablo", "Diablo", 2)]
    return spark.createDataFrame(rows, "kind string, alias string, value string, priority int")


ITEMS = [(1, "Nox", "Raptor", None, "alpha", 2025, "Nox Raptor Alpha 2025", "nox-raptor-alpha-2025"), (2, "Siux", "Diablo", None, "beta gamma delta", 2024, "Siux Diablo Beta Gamma Delta", "siux-diablo-omega"), (3, "Nox", "Raptor", None, "kilo", 2026, "Nox Raptor Kilo", "nox-raptor-zeta-2026")]


def run(spark, words, titles, **more):
    rows = [(n, t, s) for n, (t, s) in enumerate(titles, 1)]
    out = R.promote(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(ITEMS, ITEM), r"\bpelotas\b", dictionary=words, **more)
    return [tuple(r)[1:] for r in sorted(out.collect())]


def test_each_branch(spark, words):
    titles = [
        ("Nox Raptor Alpha 2025", TWO), ("Nox Raptor Sigma", ["a"]), ("Nox Raptor pelotas", TWO), ("Nox thing", TWO), (None, TWO), ("Siux Diablo Omega", TWO), ("Siux Diablo Beta Gamma Deltas", TWO),
        ("Siux Diablo Theta 2026", TWO), ("siux diablo THETA 2026", TWO), ("Theta Siux Diablo 2026", TWO), ("Siux Diablo Iota 2026", TWO),
    ]
    assert run(spark, words, titles) == [
        ("link", 1, None, None), ("wait", None, None, None), ("ignore", None, None, None), ("review", None, None, None), ("ignore", None, None, None), ("link", 2, None, None), ("link", 2, None, None),
        ("insert", None, None, "siux-diablo-theta-2026"), ("link", None, 8, None), ("link", None, 8, None), ("insert", None, None, "siux-diablo-iota-2026"),
    ]


def test_slugs_are_numbered_past_those_in_use(spark, words):
    titles = [("Nox Raptor Zeta 2026", TWO), ("Nox Raptor Zeta 2026", TWO), ("Nox Raptor Zeta-2026", TWO)]
    assert run(spark, words, titles, number_slugs=True, same=100.0) == [("insert", None, None, "nox-raptor-zeta-2026-2"), ("link", None, 1, None), ("link", None, 1, None)]
    assert [r[0] for r in run(spark, words, titles)] == ["link"] * 3  # to the product that has the slug


def test_ties_reach_over_chains(spark):
    rng = random.Random(3)
    rows = [(n, f"a{n // 2}", f"b{(n + 1) // 2}") for n in range(40)] + [(100 + n, rng.choice(["x", "y", None]), f"c{rng.randint(0, 30)}") for n in range(30)]
    first = {r[0]: r[0] for r in rows}
    for _ in rows:
        for at in (1, 2):
            for r in rows:
                for o in rows:
                    if r[at] is not None and r[at] == o[at]:
                        first[r[0]] = min(first[r[0]], first[o[0]])
    got = G.tied(spark.createDataFrame(rows, "id int, x string, y string"), "id", ["x", "y"]).collect()
    assert {r.id: r.first for r in got} == first


def test_numbers_leave_out_what_is_taken(spark):
    taken = ["p", "p-3", "q-2", "r-2"]
    rows = [(1, "p"), (2, "p"), (3, "q"), (4, "q"), (5, "q"), (6, "r"), (7, "s"), (8, "s"), (9, "s-2"), (10, "p")]
    got = {r.id: r.name for r in G.numbered(spark.createDataFrame(rows, "id int, slug string"), "id", "slug", spark.createDataFrame([(t,) for t in taken], "slug string")).collect()}
    assert got == {1: "p-2", 2: "p-4", 10: "p-5", 3: "q", 4: "q-3", 5: "q-4", 6: "r", 7: "s", 8: "s-3", 9: "s-2"}
    assert len({*got.values(), *taken}) == len(rows) + len(taken)


def test_an_id_of_several_rows(spark, words):
    """Each row has its own action, ties and slug; products that a title of the id fits, or is like, count for all of them."""
    same, other = "Nox Raptor Theta 2026", "Siux Diablo Iota 2026"
    rows = [(1, same, TWO), (2, other, TWO), (2, same, TWO), (2, same, ["a"]), (3, "Nox Raptor Sigma", TWO), (3, "Nox Raptor Alpha 2025", ["a"]), (4, "Nox thing", TWO), (4, "Nox Raptor Kilo", TWO), (5, other, TWO), (5, other, TWO)]
    out = R.promote(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(ITEMS, ITEM), r"\bpelotas\b", dictionary=words, same=100.0)
    expected = [
        (1, "insert", None, None, "nox-raptor-theta-2026"), (2, "insert", None, None, "siux-diablo-iota-2026"), (2, "link", None, 1, None), (2, "wait", None, None, None), (3, "link", 1, None, None), (3, "wait", None, None, None),
        (4, "link", 3, None, None), (4, "review", None, None, None), (5, "link", None, 2, None), (5, "link", None, 2, None),
    ]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2]) == expected


def test_promote_equals_its_sql_where_ids_repeat(spark, tmp_path):
    """From 1,000,000 parts on the query's ids for copies are those of other parts."""
    import duckdb

    from dealforge.plans import resolved

    rng = random.Random(5)
    keys = [i * 1_000_000 + n for i in range(3) for n in range(240)]
    rows = [(k, f"{rng.choice(['hot', 'old'])} {rng.choice(['ring', 'bolt', 'gear'])}", f"Brand#{rng.choice([11, 12])}", rng.choice(["SMALL", "LARGE", "MEDIUM", "PROMO"]), 1, 900.0) for k in keys]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((tuple(r) for r in resolved.promote(spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    expected = sorted(db.execute(resolved.ORACLE["promote"]).fetchall(), key=repr)
    assert len({r[0] for r in expected}) < len(expected)
    assert got == expected


def test_names_of_an_id_are_told_apart(spark):
    """The least item of all that are like any name of the id, against plain Python."""
    names = ["alpha beta gamma delta", "alpha beta gammas deltas", "alpha zeta", "omega psi chi phi"]
    items = [(i, "B", names[i % 4]) for i in range(80)]
    asked = [(i % 20, "b", names[i % 3]) for i in range(60)] + [(50 + i, "b", names[i]) for i in range(3)]
    like = lambda a, b: {a, b} <= {*names[:2]} or a == b
    expected = {j: min(k for k, _, o in items for i, _, a in asked if i == j and like(a, o)) for j, _, _ in asked}
    rows = [*asked, (99, "b", None), (98, None, names[0])]
    out = R.alike(spark.createDataFrame(rows, "candidate_id int, brand string, name string"), spark.createDataFrame(items, "item_id int, brand string, name string"))
    assert {r.candidate_id: r.item_id for r in out.collect()} == expected
