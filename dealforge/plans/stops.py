"""Queries of the stop lists, beside their SQL: the phrases are laid over titles so that each of them is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.operators import stoplists as S
from dealforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def _phrases(classes):
    return [(place, n, name, way, phrase) for place, (name, way, phrases) in enumerate(classes) for n, phrase in enumerate(phrases)]


def _titles(spark, sf, classes):
    """A title for each part: a phrase at the start, after "Pala ", in the middle, at the end, glued to a word, or none."""
    phrases = [p[-1] for p in _phrases(classes)]
    k = F.col("p_partkey")
    phrase = F.get(F.split(F.lit("|".join(phrases)), r"\|"), (k % len(phrases)).cast("int"))
    trimmed, name, form = F.trim(phrase), F.col("p_name"), k % 6
    title = (
        F.when(form == 0, F.concat_ws(" ", F.upper(trimmed), name)).when(form == 1, F.concat_ws(" ", F.lit("Pala"), trimmed, name)).when(form == 2, F.concat_ws(" ", F.split_part(name, F.lit(" "), F.lit(1)), trimmed, F.split_part(name, F.lit(" "), F.lit(2))))
        .when(form == 3, F.concat_ws(" ", name, trimmed)).when(form == 4, F.concat(name, F.lit(" x"), trimmed, F.lit("x"))).otherwise(name)
    )
    return table(spark, sf, "part").select(k.alias("title_id"), title.alias("title"))


def _sql(classes):
    plain = lambda c: f"translate(lower({c}), 'áéíóúñ', 'aeioun')"
    phrases = _phrases(classes)
    values = ", ".join("({}, {}, '{}', '{}', '{}')".format(*p) for p in phrases)
    array = ", ".join(f"'{p[-1]}'" for p in phrases)
    run = lambda c: f"' ' || array_to_string(list_filter(string_split_regex({c}, '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' '"
    return f"""WITH p AS (SELECT *, {plain("phrase")} AS f FROM (VALUES {values}) v(place, nth, class, way, phrase)), n AS (SELECT p_partkey AS title_id, p_name AS name, trim([{array}][1 + p_partkey % {len(phrases)}]) AS t FROM part),
t AS (SELECT title_id, CASE title_id % 6 WHEN 0 THEN upper(t) || ' ' || name WHEN 1 THEN 'Pala ' || t || ' ' || name WHEN 2 THEN split_part(name, ' ', 1) || ' ' || t || ' ' || split_part(name, ' ', 2) WHEN 3 THEN name || ' ' || t WHEN 4 THEN name || ' x' || t || 'x' ELSE name END AS title FROM n),
l AS (SELECT title_id, {plain("title")} AS low FROM t), w AS (SELECT title_id, low, CASE WHEN starts_with(low, 'pala ') THEN low[6:] ELSE low END AS bare, {run("low")} AS run FROM l),
m AS (SELECT title_id, class, phrase, place, nth FROM w JOIN p ON CASE way WHEN 'prefix' THEN starts_with(low, f) OR starts_with(bare, f) WHEN 'part' THEN contains(low, f) WHEN 'word' THEN contains(run, {run("f")}) ELSE contains(run[2:], {run("f")}) END)
SELECT title_id, class, phrase FROM m QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY place, nth) = 1"""


def shop_stops(spark, sf):
    return S.stopped(_titles(spark, sf, S.SHOP_CLASSES), S.stop_list(spark, S.SHOP_CLASSES))


def listing_stops(spark, sf):
    return S.stopped(_titles(spark, sf, S.LISTING_CLASSES), S.stop_list(spark, S.LISTING_CLASSES))


QUERIES |= {"shop_stops": shop_stops, "listing_stops": listing_stops}
ORACLE |= {"shop_stops": _sql(S.SHOP_CLASSES), "listing_stops": _sql(S.LISTING_CLASSES)}
