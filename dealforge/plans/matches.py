"""Queries of extraction, matching, duplicates and audits, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators import matching as M
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


def offers(spark, sf):
    """A title for each catalogue row; every second one has the year. T keeps model words apart from variants."""
    c = catalogue(spark, sf)
    year = F.when(F.col("item_id") % 2 == 0, F.col("year").cast("string"))
    return c.select(F.col("item_id").alias("offer_id"), (F.col("item_id") % 7).alias("store_id"), F.concat_ws(" ", "brand", "name", F.concat(F.lit("T"), "model"), year).alias("title"))


def marked(spark, sf):
    return catalogue(spark, sf).withColumn("model", F.concat(F.lit("t"), F.lower("model")))


@query(f"""{CAT} SELECT item_id AS offer_id, brand, line, CASE WHEN item_id % 8 IN (3, 6) THEN 'WOMAN' WHEN item_id % 8 <> 5 THEN variant END AS variant,
CASE WHEN item_id % 8 = 1 THEN 2026 WHEN item_id % 8 IN (2, 7) THEN 2025 WHEN item_id % 8 = 4 THEN 2024 ELSE NULL END::INT AS year,
CASE item_id % 8 WHEN 0 THEN 't' || lower(model) || ' 1.0' WHEN 2 THEN '3.4' ELSE 't' || lower(model) END AS model, CASE item_id % 8 WHEN 3 THEN 'Ale Salazar' WHEN 4 THEN 'Coki Nieto' END AS player FROM cat""")
def extract_attributes(spark, sf):
    """A title for each catalogue row, in one of eight forms that the rules of preparing and leaving words out meet."""
    c, k = catalogue(spark, sf), F.col("item_id") % 8
    line, model = F.col("line"), F.concat(F.lit("T"), "model")
    forms = [
        F.concat_ws(" ", "brand", "name", model, F.lit("1.0 - 1234567")),
        F.concat_ws(" ", F.lit("Pala de pádel"), "brand", "name", model, F.lit("2.6")),
        F.concat_ws(" ", "brand", "name", F.lit("3.4")),
        F.concat_ws(" ", "brand", line, model, F.lit("by Alejandra Salazar")),
        F.concat_ws(" ", "brand", "name", model, F.lit("COKI NIETO 2024 Superficie completa")),
        F.concat_ws(" ", "brand", line, model, F.lit("Edition")),
        F.concat_ws(" ", "brand", line, F.lit("W"), model),
        F.concat_ws(" ", "brand", "name", model, F.lit("3.4, Más raquetera, Más tubo de pelotas")),
    ]
    rows = c.select(F.col("item_id").alias("offer_id"), F.get(F.array(*forms), k.cast("int")).alias("title"))
    players = spark.createDataFrame([("player", "alejandra salazar", "Ale Salazar", 1), ("woman", "alejandra salazar", "Ale Salazar", 1), ("player", "coki nieto", "Coki Nieto", 2)], "kind string, alias string, value string, priority int")
    return M.extract_attributes(rows, M.dictionary_of(c).unionByName(players))


@query(f"{CAT} SELECT item_id AS offer_id, brand FROM cat")
def detect_brand(spark, sf):
    brands = M.dictionary_of(catalogue(spark, sf)).filter("kind = 'brand'")
    return M.extract_attributes(offers(spark, sf), brands).select("offer_id", "brand")


@query(f"""{CAT}, o AS (SELECT item_id AS offer_id, brand, line, variant, model, CASE WHEN item_id % 2 = 0 THEN year END AS year FROM cat),
c AS (SELECT o.*, cat.item_id, cat.year AS cy FROM o JOIN cat USING (brand, line, variant, model) WHERE o.year IS NULL OR cat.year IS NULL OR o.year = cat.year),
y AS (SELECT *, count(*) FILTER (year = cy) OVER (PARTITION BY offer_id) AS exact, row_number() OVER (PARTITION BY offer_id ORDER BY coalesce(cy, 0) DESC, item_id) AS newest FROM c),
k AS (SELECT * FROM y WHERE CASE WHEN year IS NOT NULL THEN exact <> 1 OR year = cy ELSE newest = 1 END),
n AS (SELECT offer_id, count(DISTINCT item_id) AS n, min(item_id) AS hit FROM k GROUP BY offer_id),
s AS (SELECT o.offer_id, o.line = 'anvil' AS excluded, o.offer_id % 10 = 3 AS known, coalesce(n, 0) AS n, hit FROM o LEFT JOIN n USING (offer_id))
SELECT offer_id, CASE WHEN excluded THEN 'excluded' WHEN known THEN 'alias' WHEN n = 1 THEN 'attributes' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS class,
CASE WHEN excluded THEN NULL WHEN known THEN offer_id + 100000 WHEN n = 1 THEN hit END AS item_id, CASE WHEN excluded OR known THEN 0 ELSE n END AS n FROM s""")
def match_cascade(spark, sf):
    # Titles of one store repeat, so that the known ones are told apart by their own store.
    rows = offers(spark, sf).withColumn("store_id", F.col("offer_id"))
    known = rows.filter("offer_id % 10 = 3").select("store_id", X.normalize(F.col("title")).alias("alias"), (F.col("offer_id") + 100000).alias("item_id"))
    return M.match_cascade(rows, known, marked(spark, sf), r"\banvil\b")


@query(f"""{CAT}, o AS (SELECT item_id AS offer_id, brand, line, variant, model, CASE WHEN item_id % 2 = 0 THEN year END AS year FROM cat),
c AS (SELECT o.*, cat.item_id, cat.year AS cy FROM o JOIN cat USING (brand, line, variant, model) WHERE o.year IS NULL OR cat.year IS NULL OR o.year = cat.year),
y AS (SELECT *, count(*) FILTER (year = cy) OVER (PARTITION BY offer_id) AS exact, row_number() OVER (PARTITION BY offer_id ORDER BY coalesce(cy, 0) DESC, item_id) AS newest FROM c),
k AS (SELECT * FROM y WHERE CASE WHEN year IS NOT NULL THEN exact <> 1 OR year = cy ELSE newest = 1 END) SELECT offer_id, item_id FROM k""")
def attr_join(spark, sf):
    """Titles' attributes as the extractor gives them, against the catalogue."""
    c = marked(spark, sf)
    asked = c.select(F.col("item_id").alias("offer_id"), "brand", "line", "variant", "model", F.when(F.col("item_id") % 2 == 0, F.col("year")).alias("year"))
    return M.attribute_candidates(asked, c).select("offer_id", "item_id")


GROUPS = f"""{CAT}, r0 AS (SELECT item_id, replace(lower(brand), '#', ' ') AS b, lower(line) AS l, lower(variant) AS v, lower(CASE WHEN item_id % 4 = 0 THEN split_part(model, ' ', 1) ELSE model END) AS m, year FROM cat),
r AS (SELECT *, coalesce(year, min(year) OVER (PARTITION BY b, l, v, m), 0) AS y FROM r0), g AS (SELECT DISTINCT b, l, v, m, y FROM r),
a AS (SELECT s.b, s.l, s.v, s.m, s.y, w.m AS wide FROM g s JOIN g w USING (b, l, v, y) WHERE len(string_split(s.m, ' ')) < len(string_split(w.m, ' ')) AND len(list_filter(string_split(s.m, ' '), lambda x: NOT list_contains(string_split(w.m, ' '), x))) = 0
  QUALIFY row_number() OVER (PARTITION BY s.b, s.l, s.v, s.m, s.y ORDER BY len(string_split(w.m, ' ')) DESC, w.m) = 1),
f AS (SELECT r.*, b || '|' || l || '|' || coalesce(wide, m) || '|' || v || '|' || y AS key FROM r LEFT JOIN a USING (b, l, v, m, y))"""


@query(f"{GROUPS} SELECT item_id, key, min(item_id) OVER (PARTITION BY key) AS keep_id FROM f QUALIFY count(*) OVER (PARTITION BY key) > 1")
def duplicate_groups(spark, sf):
    """Every fourth model is cut to its first word, so that it is part of a longer one."""
    short = F.when(F.col("item_id") % 4 == 0, F.substring_index("model", " ", 1)).otherwise(F.col("model"))
    return M.duplicate_groups(catalogue(spark, sf).withColumn("model", short))


@query("""WITH s AS (SELECT p_partkey AS item_id, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 99 END AS rank, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS bare FROM part)
SELECT item_id, name, first_value(item_id) OVER (PARTITION BY name ORDER BY rank, bare, item_id) AS keep_id FROM s QUALIFY count(*) OVER (PARTITION BY name) > 1""")
def survivor(spark, sf):
    k = F.col("item_id")
    source = F.when(k % 5 == 0, "padelful").when(k % 5 == 1, "padelzoom").when(k % 5 == 2, "padelnuestro").when(k % 5 == 3, "revision_manual").otherwise("other")
    image = F.when(k % 3 == 1, "data:x").when(k % 3 == 2, "https://s.example/x.jpg")
    return M.survivors(catalogue(spark, sf).select("item_id", "name").withColumns({"source": source, "image": image}), ["name"])


@query(f"""{CAT}, r AS (SELECT item_id, brand AS b, line AS l, lower(variant) AS v, string_split(lower(model), ' ') AS t, year AS y,
  array_to_string(list_sort(list_distinct(list_concat(string_split(lower(model), ' '), [lower(variant)]))), '|') AS s, item_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3) AS held FROM cat),
q AS (SELECT x.item_id AS i, z.item_id AS j, x.held AS hi, z.held AS hj, (x.v = z.v AND (len(list_filter(x.t, lambda w: NOT list_contains(z.t, w))) = 0 OR len(list_filter(z.t, lambda w: NOT list_contains(x.t, w))) = 0)) OR x.s = z.s AS same
  FROM r x JOIN r z ON x.b = z.b AND x.l = z.l AND x.item_id < z.item_id WHERE x.y IS NULL OR z.y IS NULL OR x.y = z.y)
SELECT CASE WHEN NOT hi AND hj THEN i ELSE j END AS item_id, CASE WHEN NOT hi AND hj THEN j ELSE i END AS keep_id, CASE WHEN hi AND hj THEN 'NEEDS_MERGE' ELSE 'SAFE_DELETE' END AS action FROM q WHERE same""")
def pair_self_join(spark, sf):
    held = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity < 3").select(F.col("l_partkey").alias("item_id"))
    return M.duplicate_pairs(catalogue(spark, sf), held)


SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
NEAR = f"""n AS (SELECT q.vec_id AS query_id, v.vec_id, {SIM} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, v.vec_id) AS rn FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
b AS (SELECT query_id, max(CASE WHEN rn = 1 THEN vec_id END) AS best_id, max(CASE WHEN rn = 1 THEN sim END) AS best, max(CASE WHEN rn = 2 THEN sim END) AS second FROM n WHERE rn <= 2 GROUP BY query_id)"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.filter("vec_id % 50 = 0"), v


@query(f"WITH {NEAR} SELECT query_id, best_id, round(best, 5) AS best, round(second, 5) AS second FROM b")
def nn_join(spark, sf):
    return M.two_nearest(*_vectors(spark, sf), "label").withColumn("best", F.round("best", 5)).withColumn("second", F.round("second", 5))


@query(f"WITH {NEAR} SELECT query_id, CASE WHEN best >= 0.3::DOUBLE THEN best_id END AS match_id, floor(CASE WHEN best - second < 0.03::DOUBLE THEN best * 0.88::DOUBLE ELSE best END * 100 + 0.5) / 100 AS score FROM b")
def embedding_match(spark, sf):
    return M.embedding_match(*_vectors(spark, sf), "label", least=0.3)


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf):
    v = table(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select(F.col("vec_id").alias("id"), F.round(X.cosine(F.col("embedding"), F.col("next")), 5).alias("sim"))


@query("""WITH t AS (SELECT p_partkey AS item_id, string_split(p_name, ' ') AS a, list_filter(string_split(lower(p_type), ' '), lambda x: length(x) > 1) AS b0, p_partkey % 3 AS k FROM part),
s AS (SELECT item_id, a, CASE k WHEN 0 THEN list_concat(list_transform(a, lambda x: x[1:2]), b0) WHEN 1 THEN [a[1] || 'x'] ELSE b0 END AS b FROM t)
SELECT item_id, CAST(len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) AS DOUBLE) / greatest(len(a), len(list_distinct(b))) * 100 AS similarity FROM s""")
def token_similarity(spark, sf):
    """Against prefixes and other words; against a longer first word; against other words."""
    p = table(spark, sf, "part")
    a = F.split("p_name", " ")
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, F.concat_ws(" ", F.transform(a, lambda x: F.substring(x, 1, 2)), F.upper("p_type"))).when(k == 1, F.concat(a[0], F.lit("x"))).otherwise(F.col("p_type"))
    return p.select(F.col("p_partkey").alias("item_id"), X.token_similarity(F.col("p_name"), other).alias("similarity"))


@query(f"""{CAT}, x AS (SELECT item_id, brand, list_distinct(string_split(lower(name || ' ' || model), ' ')) AS t FROM cat), b AS (SELECT * FROM x WHERE item_id % 10 = 0), c AS (SELECT * FROM x WHERE item_id % 10 <> 0),
s AS (SELECT b.item_id AS broken_id, c.item_id, CAST(len(list_intersect(b.t, c.t)) AS DOUBLE) / len(list_distinct(list_concat(b.t, c.t))) AS score FROM b JOIN c USING (brand))
SELECT broken_id, item_id, score FROM s WHERE score >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY broken_id ORDER BY score DESC, item_id) = 1""")
def jaccard_best(spark, sf):
    """Every tenth row has lost its line."""
    rows = catalogue(spark, sf).withColumn("name", F.concat_ws(" ", "name", "model"))
    return M.best_by_jaccard(rows.filter("item_id % 10 = 0"), rows.filter("item_id % 10 <> 0"))
