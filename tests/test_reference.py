"""Every query against its SQL in DuckDB at the smallest scale, and worked examples of the functions."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators import matching as M
from dealforge.operators import sinks
from dealforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (decimal.Decimal, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def one(spark, **columns):
    return lambda *exprs: spark.createDataFrame([tuple(columns.values())], list(columns)).select(*exprs).first()


def test_text_examples(spark):
    row = one(spark, t="ADIDAS WORLD CUP Énglând 2026 (Pala)", u="https://x.es/pala-bullpadel-neuron-02/", v="https://x.es/bullpadel-neuron-25-113768-p")
    got = row(X.normalize(F.col("t")), X.extract_year(F.col("t")), X.url_generations(F.col("u")), X.url_generations(F.col("v")), X.url_year(F.col("v")))
    assert tuple(got) == ("adidas world cup england 2026 pala", 2026, ["02"], [], 2025)


def test_price_examples(spark):
    row = one(spark, p="1.299,95 EUR", q="x", a=decimal.Decimal("79.95"), b=decimal.Decimal("118.97"))
    got = row(X.parse_price(F.col("p")), X.parse_price(F.col("q")), X.vat_heuristic(F.col("a")), X.vat_heuristic(F.col("b")))
    assert [None if v is None else str(v) for v in got] == ["1299.95", None, "79.95", "143.95"]


def test_html_decode(spark):
    row = one(spark, t="Pala Dunlop Galactica Pro &#8211; Juani &amp;lt; &#x20AC;")
    assert row(X.html_decode(F.col("t")))[0] == "Pala Dunlop Galactica Pro – Juani &lt; €"


@pytest.mark.parametrize(
    "cat, title, cy, ty, fits",
    [("Pro", "Pro", None, None, True), ("Pro", "", None, None, False), ("2", None, 2026, None, True), ("", "2", 2026, None, False), ("", "26", 2026, None, True), ("Elite", "Elite Light", None, None, False), ("Elite", "Elite blue", None, None, True)],
)
def test_model_compatible(spark, cat, title, cy, ty, fits):
    df = spark.createDataFrame([(cat, title, cy, ty)], "c string, t string, cy int, ty int")
    assert df.select(M.model_compatible(F.col("c"), F.col("t"), F.col("cy"), F.col("ty"))).first()[0] is fits


def test_extract_attributes_edges(spark):
    words = spark.createDataFrame([("brand", "nox", "Nox", 1), ("line", "ml10 pro cup", "ML10 Pro Cup", 2), ("line", "ml10", "ML10", 2)], "kind string, alias string, value string, priority int")
    titles = spark.createDataFrame([(1, "NOX ML10 PRO CUP ROUGH 23"), (2, None), (3, "")], "offer_id int, title string")
    got = {r.offer_id: (r.brand, r.line, r.year, r.model) for r in M.extract_attributes(titles, words).collect()}
    assert got == {1: ("Nox", "ML10 Pro Cup", 2023, "rough"), 2: (None, None, None, ""), 3: (None, None, None, "")}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sinks.upsert(old, new, ["k"], [F.asc("v")])
    twice = sinks.upsert(once, new, ["k"], [F.asc("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], [F.asc("v")], "ignore").collect())) == [(1, "a"), (2, "b"), (3, "d")]
