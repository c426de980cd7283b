"""Queries of the matchers, candidates and audits, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.functions import vocabulary as V
from dealforge.operators import resolve as R
from dealforge.plans.rules import sql_list
from dealforge.sources.tables import CATALOGUE_SQL, catalogue, table

QUERIES: dict = {}
ORACLE: dict = {}
CAT = f"WITH {CATALOGUE_SQL}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def titles(spark, sf):
    """A title for each item: its name and model, cut or with words added, and a year for every second."""
    c = catalogue(spark, sf)
    k = F.col("item_id")
    model = F.when(k % 6 == 0, F.substring_index("model", " ", 1)).otherwise(F.col("model"))
    extra = F.when(k % 5 == 0, "carbon").when(k % 5 == 1, "blue").when(k % 5 == 2, "new pala")
    year = F.when(k % 2 == 0, F.coalesce("year", F.lit(2024)).cast("string"))
    return c.select(k.alias("title_id"), F.concat_ws(" ", "brand", "line", model, extra, year).alias("title"), F.lit(None).cast("string").alias("url"))


TOKENS = f"lambda t: length(t) >= 2 AND t NOT IN {sql_list(V.TITLE_STOP)} AND NOT regexp_matches(t, '^20[0-9][0-9]$')"
MATCHED = f"""{CAT}, p AS (SELECT item_id, brand, year, list_distinct(list_filter(string_split(lower(line || ' ' || model), ' '), {TOKENS})) AS t FROM cat),
q0 AS (SELECT item_id AS title_id, brand, CASE WHEN item_id % 2 = 0 THEN coalesce(year, 2024) END AS ty, lower(concat_ws(' ', replace(brand, '#', ' '), line, CASE WHEN item_id % 6 = 0 THEN split_part(model, ' ', 1) ELSE model END, CASE item_id % 5 WHEN 0 THEN 'carbon' WHEN 1 THEN 'blue' WHEN 2 THEN 'new pala' END)) AS s FROM cat),
q AS (SELECT title_id, brand, ty, list_distinct(list_filter(string_split(s, ' '), {TOKENS})) AS tt FROM q0),
m AS (SELECT q.*, p.item_id, p.t, p.year, len(list_filter(t, lambda w: NOT list_contains(tt, w))) = 0 AS inside, len(list_filter(t, lambda w: w NOT IN {sql_list(V.TITLE_COLOURS)} AND NOT list_contains(tt, w))) = 0 AS plain_inside,
  list_filter(tt, lambda w: w IN {sql_list(V.TITLE_TELLING)} AND NOT list_contains(t, w)) AS extra, list_filter(tt, lambda w: w IN {sql_list(V.TITLE_COLOURS)}) AS tc, list_filter(t, lambda w: w IN {sql_list(V.TITLE_COLOURS)}) AS pc FROM q JOIN p USING (brand)),
h AS (SELECT *, (ty IS NULL OR coalesce(year = ty, false)) AND inside AND len(extra) = 0 AS strict, ty IS NULL AND plain_inside AND NOT (len(tc) > 0 AND len(pc) > 0 AND len(list_intersect(tc, pc)) = 0) AND len(list_filter(extra, lambda w: w NOT IN {sql_list(V.TITLE_COLOURS)})) = 0 AS loose FROM m),
a AS (SELECT * FROM h WHERE strict OR loose QUALIFY strict OR NOT bool_or(strict) OVER (PARTITION BY title_id)),
b AS (SELECT * FROM a QUALIFY len(list_filter(tt, lambda w: w IN {sql_list(V.TITLE_TELLING)} AND list_contains(t, w))) = max(len(list_filter(tt, lambda w: w IN {sql_list(V.TITLE_TELLING)} AND list_contains(t, w)))) OVER (PARTITION BY title_id)),
c AS (SELECT * FROM b QUALIFY len(t) = max(len(t)) OVER (PARTITION BY title_id)),
d AS (SELECT * FROM c QUALIFY coalesce(year, 0) = max(coalesce(year, 0)) OVER (PARTITION BY title_id)),
tw AS (SELECT brand, list_sort(t) AS ts, count(*) AS twins FROM p GROUP BY ALL),
f AS (SELECT title_id, ty, count(*) AS n, min(item_id) AS hit, min(year) AS y, max(twins) AS twins, list_sort(list(item_id)) AS ids FROM d JOIN tw ON tw.brand = d.brand AND tw.ts = list_sort(d.t) GROUP BY ALL),
nr AS (SELECT title_id, item_id, len(list_intersect(t, tt)) / CAST(len(t) AS DOUBLE) AS ratio FROM m WHERE title_id NOT IN (SELECT title_id FROM f)),
ns AS (SELECT title_id, max(ratio) AS ratio, list(item_id ORDER BY ratio DESC, item_id) AS near FROM (SELECT * FROM nr WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY ratio DESC, item_id) <= 5) GROUP BY title_id),
r AS (SELECT q.title_id, CASE WHEN n = 1 THEN hit END AS item_id, CAST(CASE WHEN n = 1 THEN CASE WHEN f.ty IS NOT NULL THEN CASE WHEN y = f.ty THEN 1.0 ELSE 0.95 END WHEN twins > 1 THEN 0.92 ELSE 0.95 END WHEN n > 1 THEN 0.8 ELSE coalesce(ratio, 0) END AS DOUBLE) AS confidence,
  CASE WHEN n = 1 THEN 'fuzzy' WHEN n > 1 OR near IS NOT NULL THEN 'needs_review' ELSE 'no_match' END AS method, CASE WHEN n > 1 THEN ids WHEN n IS NULL THEN near END AS candidates FROM q LEFT JOIN f USING (title_id) LEFT JOIN ns USING (title_id))"""


@query(f"{MATCHED} SELECT * FROM r")
def fuzzy_match(spark, sf):
    return R.fuzzy_match(titles(spark, sf), catalogue(spark, sf))


def _second_hand(spark, sf):
    words = fuzzy_match(spark, sf).select(F.col("title_id").alias("listing_id"), "item_id", "confidence")
    listings = catalogue(spark, sf).select(F.col("item_id").alias("listing_id"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).when(F.col("item_id") % 3 == 1, F.col("item_id") + 1).alias("item_id"))
    vectors = listings.filter("listing_id % 4 <> 0").select("listing_id", (F.col("listing_id") + 7).alias("item_id"), F.when(F.col("listing_id") % 4 == 1, 0.96).otherwise(0.9).alias("confidence"))
    return R.second_hand_match(listings, words, vectors)


SECOND = f"""{MATCHED}, l AS (SELECT item_id AS listing_id, CASE item_id % 3 WHEN 0 THEN item_id WHEN 1 THEN item_id + 1 END AS old FROM cat),
o AS (SELECT listing_id, old, CASE WHEN r.item_id IS NOT NULL AND confidence >= 0.95 THEN r.item_id WHEN listing_id % 4 = 1 THEN listing_id + 7 END AS item_id, CASE WHEN r.item_id IS NOT NULL AND confidence >= 0.95 THEN confidence WHEN listing_id % 4 = 1 THEN CAST(0.96 AS DOUBLE) END AS confidence FROM l JOIN r ON r.title_id = listing_id)"""


@query(f"{SECOND} SELECT listing_id, item_id, confidence, CASE WHEN item_id IS NOT NULL THEN CASE WHEN item_id = old THEN 'kept' ELSE 'matched' END WHEN old IS NOT NULL THEN 'nullified' ELSE 'unmatched' END AS outcome FROM o")
def second_hand(spark, sf):
    return _second_hand(spark, sf)


@query(f"{SECOND}, ch AS (SELECT *, CASE WHEN item_id IS NOT NULL THEN item_id IS DISTINCT FROM old ELSE old IS NOT NULL END AS changed FROM o) SELECT DISTINCT i AS item_id FROM (SELECT unnest([item_id, old]) AS i FROM ch WHERE changed) WHERE i IS NOT NULL")
def second_hand_affected(spark, sf):
    listings = catalogue(spark, sf).select(F.col("item_id").alias("listing_id"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).when(F.col("item_id") % 3 == 1, F.col("item_id") + 1).alias("item_id"))
    return R.affected(_second_hand(spark, sf), listings)


@query("""WITH m AS (SELECT p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'other' END AS seen FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey AS url, seen IS NOT DISTINCT FROM p_name OR seen IS NULL AND url IS NOT NULL AS known FROM part LEFT JOIN m ON url = p_partkey""")
def match_memo(spark, sf):
    """Remembered for the same title, for another, for none, or not at all."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title"))
    k = F.col("url")
    memo = p.filter("url % 5 <> 0").select("url", F.when(k % 3 == 0, F.col("title")).when(k % 3 == 1, "other").alias("title"), k.alias("item_id"), F.lit(1.0).alias("confidence"))
    known, rest = R.memo_split(p, memo, ["url"])
    return known.select("url", F.lit(True).alias("known")).unionByName(rest.select("url", F.lit(False).alias("known")))


@query(f"""{CAT}, c AS (SELECT item_id AS candidate_id, brand, CASE WHEN item_id % 11 = 0 THEN NULL ELSE line END AS line, CASE WHEN item_id % 3 <> 0 THEN lower(model) END AS model, CASE WHEN item_id % 4 = 0 THEN NULL ELSE variant END AS variant, CASE WHEN item_id % 2 = 0 THEN year END AS year FROM cat),
m AS (SELECT candidate_id, count(*) AS n, min(cat.item_id) AS hit FROM c JOIN cat ON c.brand = cat.brand AND c.line = cat.line AND (c.model IS NULL OR c.model = lower(cat.model)) AND c.variant IS NOT DISTINCT FROM cat.variant AND (c.year IS NULL OR cat.year IS NULL OR c.year = cat.year) GROUP BY candidate_id)
SELECT candidate_id, CASE WHEN n = 1 THEN hit END AS item_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'pending' END AS state FROM c LEFT JOIN m USING (candidate_id)""")
def resolve_pending(spark, sf):
    k = F.col("item_id")
    c = catalogue(spark, sf)
    found = c.select(k.alias("candidate_id"), "brand", F.when(k % 11 != 0, F.col("line")).alias("line"), F.when(k % 3 != 0, F.lower("model")).alias("model"), F.when(k % 4 != 0, F.col("variant")).alias("variant"), F.when(k % 2 == 0, F.col("year")).alias("year"))
    return R.resolve_pending(found, c)


#: Candidates: one of each catalogue row, and for every fifth of those that are not in the catalogue two more with the same title.
PROMOTED = f"""{CAT}, c0 AS (SELECT item_id AS k, 0 AS copy FROM cat UNION ALL SELECT item_id, unnest([1, 2]) FROM cat WHERE item_id % 5 = 1 AND item_id % 2 = 1),
c AS (SELECT k + copy * 1000000 AS candidate_id, k % 3 AS sources, k % 13 = 1 AS ball, k % 7 = 2 AS lost, brand, line, variant, 't' || lower(model) AS model, CASE WHEN k % 2 = 0 THEN year END AS y,
  concat_ws(' ', brand, name, 't' || lower(model), CASE WHEN k % 2 = 0 THEN CAST(year AS VARCHAR) END) AS title FROM c0 JOIN cat ON item_id = k),
i AS (SELECT item_id, brand, line, variant, 't' || lower(model) AS model, year, concat_ws(' ', brand, name, 't' || lower(model)) AS name, CASE WHEN item_id % 4 = 0 THEN 'brand-' || item_id ELSE 's-' || item_id END AS slug FROM cat WHERE item_id % 2 = 0),
m0 AS (SELECT candidate_id, i.item_id, i.year AS cy, y FROM c JOIN i USING (brand, line, variant, model) WHERE NOT lost AND (y IS NULL OR i.year IS NULL OR y = i.year)),
m1 AS (SELECT *, count(*) FILTER (y = cy) OVER (PARTITION BY candidate_id) AS exact, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(cy, 0) DESC, item_id) AS newest FROM m0),
m AS (SELECT candidate_id, count(DISTINCT item_id) AS n, min(item_id) AS hit FROM m1 WHERE CASE WHEN y IS NOT NULL THEN exact <> 1 OR y = cy ELSE newest = 1 END GROUP BY candidate_id),
g AS (SELECT *, CASE WHEN sources < 2 THEN 'wait' WHEN ball THEN 'ignore' WHEN lost THEN 'review' WHEN n = 1 THEN 'link' WHEN n > 1 THEN 'review' END AS action FROM c LEFT JOIN m USING (candidate_id)),
w AS (SELECT candidate_id, lower(brand) AS b, list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: len(t) > 1) AS ta FROM g WHERE action IS NULL),
v AS (SELECT item_id, lower(brand) AS b, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: len(t) > 1)) AS tb FROM i),
near AS (SELECT candidate_id, min(item_id) AS near_id FROM w JOIN v USING (b) WHERE len(list_filter(ta, lambda t: len(list_filter(tb, lambda u: starts_with(u, t) OR starts_with(t, u))) > 0)) / greatest(len(ta), len(tb)) * 100 >= 78 GROUP BY candidate_id),
f AS (SELECT *, CASE WHEN action IS NULL AND near_id IS NULL THEN min(CASE WHEN action IS NULL AND near_id IS NULL THEN candidate_id END) OVER (PARTITION BY brand, line, variant, model, y) END AS first FROM g LEFT JOIN near USING (candidate_id))"""


@query(f"""{PROMOTED} SELECT candidate_id, coalesce(action, CASE WHEN near_id IS NOT NULL OR first <> candidate_id THEN 'link' ELSE 'insert' END) AS action, coalesce(CASE WHEN action = 'link' THEN hit END, near_id) AS item_id,
CASE WHEN first <> candidate_id THEN first END AS with_id, CASE WHEN first = candidate_id THEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM f""")
def promote(spark, sf):
    """Every second item is in the catalogue already."""
    from dealforge.operators.matching import dictionary_of

    return R.promote(*_promoted(spark, sf), "pelotas", dictionary=dictionary_of(_promoted_from(spark, sf)))


def _promoted_from(spark, sf):
    return catalogue(spark, sf).withColumn("model", F.concat(F.lit("t"), F.lower("model")))


def _promoted(spark, sf):
    k = F.col("item_id")
    c = _promoted_from(spark, sf)
    copies = F.when((k % 5 == 1) & (k % 2 == 1), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    title = F.when(k % 7 == 2, F.concat(F.lit("unknown thing "), k)).otherwise(F.concat_ws(" ", "brand", "name", "model", F.when(k % 2 == 0, F.col("year").cast("string"))))
    title = F.when(k % 13 == 1, F.concat(title, F.lit(" pelotas"))).otherwise(title)
    found = c.select(k, title.alias("title"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int")).alias("sources"), F.explode(copies).alias("copy"))
    items = c.filter("item_id % 2 = 0").withColumns({"name": F.concat_ws(" ", "brand", "name", "model"), "slug": F.concat(F.when(k % 4 == 0, "brand-").otherwise("s-"), k)})
    return found.select((k + F.col("copy") * 1000000).alias("candidate_id"), "title", "sources"), items


AUDITED = f"""{MATCHED}, s AS (SELECT title_id, tt, CASE WHEN title_id % 3 = 0 THEN title_id + 1 ELSE title_id END AS item_id FROM q),
v AS (SELECT s.title_id, tt, p.t, r.item_id AS now, s.item_id FROM s JOIN r USING (title_id) JOIN p ON p.item_id = s.item_id),
w AS (SELECT *, CASE WHEN now IS NULL THEN 'unmatched' WHEN now = item_id THEN 'correct' ELSE 'false_positive' END AS verdict, list_sort(list_filter(t, lambda w: w IN {sql_list(V.TITLE_TELLING)} AND NOT list_contains(tt, w))) AS missing, list_sort(list_filter(tt, lambda w: w IN {sql_list(V.TITLE_TELLING)} AND NOT list_contains(t, w))) AS extra FROM v)"""
AUDIT = """SELECT title_id, verdict, CASE WHEN verdict = 'false_positive' THEN CASE WHEN len(missing) > 0 THEN 'missing_telling' WHEN len(extra) > 0 THEN 'extra_telling' ELSE 'ratio' END END AS suggestion, CASE WHEN verdict = 'false_positive' THEN CASE WHEN len(missing) > 0 THEN missing ELSE extra END END AS words FROM w"""


@query(f"{AUDITED} {AUDIT}")
def audit_matcher(spark, sf):
    """Every third stored match is the next item's."""
    t = titles(spark, sf)
    stored = t.select("title_id", "title", F.when(F.col("title_id") % 3 == 0, F.col("title_id") + 1).otherwise(F.col("title_id")).alias("item_id"))
    again = R.fuzzy_match(t, catalogue(spark, sf)).select("title_id", "item_id")
    return R.audit_matcher(stored, again, catalogue(spark, sf))


@query(f"{AUDITED}, u AS ({AUDIT}) SELECT suggestion, array_to_string(words, ' ') AS words, count(*) AS n FROM u WHERE verdict = 'false_positive' GROUP BY ALL")
def matcher_fixes(spark, sf):
    return R.matcher_fixes(audit_matcher(spark, sf))[0]


@query("""WITH c AS (SELECT p_partkey AS title_id, unnest([0, 1]) AS side FROM part), m AS (SELECT title_id, side, CASE title_id % 4 WHEN 0 THEN 'same 202' || side WHEN 1 THEN CASE side WHEN 0 THEN 'x Juan Lebron' ELSE 'x' END ELSE 'y' || side END AS model, CASE WHEN title_id % 4 = 0 THEN 2020 + side ELSE 2024 END AS year FROM c)
SELECT title_id, CASE title_id % 4 WHEN 0 THEN 'same_model_other_year' WHEN 1 THEN 'player' WHEN 2 THEN 'no_telling_word' ELSE 'other' END AS category FROM m GROUP BY title_id""")
def ambiguity(spark, sf):
    """Two candidates a title: one model in two years; with a player and without; others, with a telling word or none."""
    k = F.col("title_id")
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("title_id")).withColumn("title", F.when(k % 4 == 3, "some carbon").otherwise("some"))
    sides = t.select("title_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    s = F.col("side")
    model = F.when(k % 4 == 0, F.concat(F.lit("same 202"), s)).when(k % 4 == 1, F.when(s == 0, "x Juan Lebron").otherwise("x")).otherwise(F.concat(F.lit("y"), s))
    return R.ambiguity(t, sides.select("title_id", (k * 2 + s).alias("item_id"), model.alias("model"), F.when(k % 4 == 0, 2020 + s).otherwise(2024).alias("year")))


SAME = "CASE WHEN a[1:1] <> b[1:1] THEN 0 WHEN a[2:2] <> b[2:2] THEN 1 WHEN a[3:3] <> b[3:3] THEN 2 WHEN a[4:4] <> b[4:4] THEN 3 ELSE 4 END"


@query(f"""{CAT}, t AS (SELECT item_id AS title_id, brand, lower(replace(brand, '#', ' ') || ' ' || name || 's') AS a FROM cat WHERE item_id % 50 = 0), n AS (SELECT item_id, brand, lower(replace(brand, '#', ' ') || ' ' || line || ' ' || variant) AS b FROM cat),
s AS (SELECT title_id, item_id, a, b, jaro_similarity(a, b) AS j FROM t JOIN n USING (brand)), w AS (SELECT title_id, item_id, round(CASE WHEN a = b THEN 1 ELSE j + ({SAME}) * 0.1::DOUBLE * (1 - j) END, 9) AS score FROM s)
SELECT title_id, score, place FROM (SELECT title_id, score, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, item_id) AS place FROM w) WHERE place <= 8""")
def closest_names(spark, sf):
    c = catalogue(spark, sf)
    asked = c.filter("item_id % 50 = 0").select(F.col("item_id").alias("title_id"), F.concat("brand", F.lit(" "), "name", F.lit("s")).alias("title"))
    names = c.withColumn("name", F.concat_ws(" ", "brand", "line", "variant"))
    return R.closest_names(asked, names).select("title_id", F.round("score", 9).alias("score"), "place")


@query("""SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 0 THEN 'Drop Shot' WHEN 1 THEN 'Bullpadel' WHEN 2 THEN 'Black Crown' WHEN 3 THEN 'Nox' WHEN 4 THEN p_brand END AS brand FROM part""")
def brand_known(spark, sf):
    """A name of several words; a line that names its brand; both; a known word; a brand of the catalogue only; none."""
    k = F.col("item_id")
    c = catalogue(spark, sf)
    head = F.when(k % 6 == 0, "Pala drop-shot").when(k % 6 == 1, "Hack 03").when(k % 6 == 2, "nox black crown").when(k % 6 == 3, "NOX ml10").when(k % 6 == 4, F.col("brand")).otherwise("nothing")
    return R.detect_brands(c.select(k.alias("title_id"), F.concat(head, F.lit(" "), k).alias("title")), c).select(F.col("title_id").alias("item_id"), "brand")


@query("""SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 + 1 || '.' || p_partkey % 10 END AS version FROM part""")
def url_version(spark, sf):
    """A version in the slug, one with a late title year, and none."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 2, "https://s/plain-2026-p").otherwise(F.concat(F.lit("https://s/drive-"), k % 9 + 1, F.lit("-"), k % 10, F.lit("-blue-p")))
    return table(spark, sf, "part").select(k.alias("item_id"), X.url_version(url, F.when(k % 3 == 1, F.lit(2025))).alias("version"))
