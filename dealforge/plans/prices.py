"""Queries of the pricing operators, each beside its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from dealforge.functions.urls import url_guard
from dealforge.operators import pricing as P
from dealforge.sources.tables import AS_OF, CATALOGUE_SQL, OBSERVATIONS_SQL, catalogue, observations

DAYS = 730
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


WITH = f"WITH {OBSERVATIONS_SQL}, {CATALOGUE_SQL}"
SINCE = f"day <= DATE '{AS_OF}' AND day >= DATE '{AS_OF}' - {DAYS}"
NEWEST = "day DESC, order_key DESC, line_number DESC, price DESC"
MEAN = "CAST(sum(price) AS DOUBLE) / count(*)"


def latest(source: str) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY item_id, store_id ORDER BY {NEWEST}) = 1)"


def half_up(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def summary(source: str) -> str:
    return f"SELECT item_id, {half_up(MEAN)} AS reference_price, min(price) AS min_price, max(price) AS max_price, count(*) AS n_stores FROM {source} GROUP BY item_id"


@query(f"{WITH} SELECT item_id, store_id, price, day, order_key, line_number FROM {latest('obs')}")
def latest_per_store(spark, sf_dir):
    return P.latest_per_store(observations(spark, sf_dir)).select("item_id", "store_id", "price", "day", "order_key", "line_number")


@query(f"{WITH} {summary(latest(f'(SELECT * FROM obs WHERE available AND store_id <> 2 AND {SINCE})'))}")
def reference_price(spark, sf_dir):
    return P.reference_price(observations(spark, sf_dir), AS_OF, DAYS)


@query(f"""{WITH}, a AS (SELECT *, count(DISTINCT CASE WHEN confidence = 1 THEN store_id END) OVER (PARTITION BY item_id) AS sure FROM obs WHERE confidence >= 0.95 AND {SINCE}),
b AS (SELECT *, max(CAST(store_id NOT IN (2, 9) AS INTEGER)) OVER (PARTITION BY item_id) AS strong FROM a WHERE sure < 2 OR confidence = 1),
c AS (SELECT item_id, url, price, store_id FROM b WHERE strong = 0 OR store_id NOT IN (2, 9) QUALIFY row_number() OVER (PARTITION BY item_id, url ORDER BY price, store_id) = 1),
p AS (SELECT item_id, {MEAN} AS m, count(DISTINCT store_id) AS n_stores FROM c GROUP BY item_id),
q AS (SELECT item_id, n_stores, m, CAST(list_price AS DOUBLE) AS l, n_stores < 2 OR m / CAST(list_price AS DOUBLE) > 1.4 AS from_list FROM p JOIN cat USING (item_id))
SELECT item_id, n_stores, {half_up('CASE WHEN from_list THEN l ELSE m END')} AS reference_price, from_list FROM q""")
def reference_price_v9(spark, sf_dir):
    return P.reference_price_v9(observations(spark, sf_dir), catalogue(spark, sf_dir), AS_OF, DAYS)


@query(f"""{WITH}, a AS (SELECT *, bool_or(store_id <> 2) OVER (PARTITION BY item_id) AS others FROM obs WHERE {SINCE}),
c AS (SELECT item_id, url, min(price) AS price FROM a WHERE NOT others OR store_id <> 2 GROUP BY ALL)
SELECT item_id, {half_up(MEAN)} AS reference_price, count(*) AS n_urls FROM c GROUP BY item_id""")
def reference_price_bulk(spark, sf_dir):
    return P.reference_price_bulk(observations(spark, sf_dir), AS_OF, DAYS)


@query(f"{WITH}, a AS (SELECT * FROM obs WHERE store_id <> 2 QUALIFY day >= max(day) OVER (PARTITION BY item_id) - 90) {summary(latest('a'))}")
def reference_price_anchor(spark, sf_dir):
    return P.reference_price_anchor(observations(spark, sf_dir), 90)


CHEAPEST = "QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY effective, store_id, order_key DESC, line_number DESC) = 1"
EFFECTIVE = "CAST(price * (1 - pct) AS DECIMAL(26,8))"


@query(f"{WITH} SELECT item_id, store_id, effective, order_key, line_number FROM (SELECT *, {EFFECTIVE} AS effective FROM obs) {CHEAPEST}")
def cheapest_per_item(spark, sf_dir):
    return P.cheapest_per_item(observations(spark, sf_dir)).select("item_id", "store_id", "effective", "order_key", "line_number")


CODES = "codes AS (SELECT s_suppkey AS store_id, CAST((s_suppkey % 4) * 0.05 AS DECIMAL(6,4)) AS live_pct, CASE WHEN s_suppkey % 3 = 0 THEN 'brand#' || (s_suppkey % 25 + 1) END AS only_brand FROM supplier WHERE s_suppkey % 2 = 0)"


def codes(spark, sf_dir):
    """Every second store has a live code; a third of these for one brand only."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 2 = 0")
    only = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("brand#"), F.col("s_suppkey") % 25 + 1))
    return s.select(F.col("s_suppkey").alias("store_id"), ((F.col("s_suppkey") % 4) * F.lit(0.05)).cast("decimal(6,4)").alias("live_pct"), only.alias("only_brand"))


DEALS_NOW = datetime(2001, 11, 5)


def deal_items(spark, sf_dir):
    """The catalogue with the time when each item's reference was made: up to 400 days ago."""
    return catalogue(spark, sf_dir).withColumn("updated", F.lit(DEALS_NOW).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("item_id") % 5 * 100).cast("int")))


def judge(spark, sf_dir, how):
    obs = observations(spark, sf_dir)
    references = P.reference_price(obs, AS_OF, DAYS)
    return how(obs, deal_items(spark, sf_dir), references, codes(spark, sf_dir), now=DEALS_NOW, hours=24 * DAYS)


JUDGED = f"""{WITH}, {CODES},
it AS (SELECT item_id, brand, model, year, TIMESTAMP '{DEALS_NOW}' - to_days(CAST(item_id % 5 * 100 AS INTEGER)) AS updated FROM cat),
rf AS ({summary(latest(f'(SELECT * FROM obs WHERE available AND store_id <> 2 AND {SINCE})'))}),
w AS (SELECT obs.*, brand, model, year, seen_at <= updated + INTERVAL 3 HOUR AS fresh FROM obs JOIN it USING (item_id) WHERE seen_at BETWEEN TIMESTAMP '{DEALS_NOW}' - to_hours({24 * DAYS}) AND TIMESTAMP '{DEALS_NOW}' AND available AND confidence >= 0.95 AND store_id <> 2),
l AS (SELECT * FROM w WHERE fresh OR NOT (SELECT coalesce(bool_or(fresh), false) FROM w) QUALIFY row_number() OVER (PARTITION BY item_id, store_id ORDER BY seen_at DESC, order_key DESC, line_number DESC, price DESC) = 1),
u AS (SELECT l.*, CASE WHEN live_pct > 0 AND only_brand IS NOT NULL AND lower(only_brand) <> lower(brand) THEN CAST(0 AS DECIMAL(6,4)) WHEN live_pct > 0 THEN live_pct ELSE pct END AS used_pct FROM l LEFT JOIN codes USING (store_id)),
e AS (SELECT *, CAST(price * (1 - used_pct) AS DECIMAL(26,8)) AS effective FROM u QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY effective, store_id) = 1),
s AS (SELECT e.*, count(*) OVER (PARTITION BY url) AS sharing, reference_price AS ref, n_stores, CAST(min_price AS DOUBLE) AS low, CAST(max_price AS DOUBLE) AS high, CAST(effective AS DOUBLE) / reference_price AS ratio FROM e LEFT JOIN rf USING (item_id)),
j AS (SELECT *, CASE WHEN year IS NULL OR year < 2024 THEN 'year' WHEN n_stores IS NULL THEN 'no_reference' WHEN n_stores < 3 THEN 'few_stores' WHEN low > 0 AND high / low > CASE WHEN n_stores >= 5 THEN 4.0::DOUBLE ELSE 2.5::DOUBLE END THEN 'spread' WHEN ref < 50 THEN 'low_reference'
  WHEN low > 0 AND CAST(price AS DOUBLE) / low < 0.75::DOUBLE THEN 'under_minimum'
  WHEN regexp_matches(url, '20[0-9][0-9]') AND CAST(regexp_extract(url, '20[0-9][0-9]') AS INTEGER) <> year THEN 'guard_A'
  WHEN NOT regexp_matches(url, '20[0-9][0-9]') AND regexp_extract(url, '/[^/]*-(19|2[0-9])-[^/]{{0,2}}$', 1) <> '' AND 2000 + CAST(regexp_extract(url, '/[^/]*-(19|2[0-9])-[^/]{{0,2}}$', 1) AS INTEGER) <> year THEN 'guard_B'
  WHEN sharing > 1 THEN 'guard_C' WHEN ratio > 0.75::DOUBLE THEN 'no_discount' END AS reason FROM s)"""


@query(f"""{JUDGED} SELECT item_id, store_id, n_stores, {half_up('CAST(price AS DOUBLE)')} AS price, {half_up('CAST(effective AS DOUBLE)')} AS effective_price, ref AS reference_price,
CAST(floor((1 - ratio) * 100 + 0.5) AS BIGINT) AS discount_pct, used_pct, seen_at, CASE WHEN ratio <= CAST(0.65 AS DOUBLE) THEN 'CHOLLO' ELSE 'OFERTA' END AS tag FROM j WHERE reason IS NULL""")
def deals(spark, sf_dir):
    return judge(spark, sf_dir, P.deals)


@query(f"{JUDGED} SELECT item_id, store_id, n_stores, reason FROM j WHERE reason IS NOT NULL")
def deal_rejections(spark, sf_dir):
    return judge(spark, sf_dir, P.deal_rejections)


@query(f"""{WITH} SELECT item_id, day, {half_up(MEAN)} AS mean_price, {half_up('median(CAST(price AS DOUBLE))')} AS median_price, min({EFFECTIVE}) AS min_effective, count(*) AS n FROM obs GROUP BY item_id, day""")
def daily_series(spark, sf_dir):
    return P.daily_series(observations(spark, sf_dir))


@query(f"{WITH}, m AS (SELECT item_id, min(price) AS min_price FROM obs GROUP BY item_id) SELECT item_id, min_price, max(day) AS last_day FROM m JOIN obs USING (item_id) WHERE price = min_price GROUP BY ALL")
def historic_min(spark, sf_dir):
    return P.historic_min(observations(spark, sf_dir))


@query(f"""{WITH}, e AS (SELECT *, {EFFECTIVE} AS effective FROM obs), s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY item_id, store_id ORDER BY available DESC, effective, order_key DESC, line_number DESC) = 1)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY available DESC, effective, store_id) AS place, store_id, effective, available FROM s QUALIFY place <= 3""")
def top3_stores(spark, sf_dir):
    return P.top_stores(observations(spark, sf_dir))


@query(f"""{WITH}, w AS (SELECT *, row_number() OVER x AS rn, first_value(order_key) OVER x AS winner_order, first_value(line_number) OVER x AS winner_line FROM obs
WINDOW x AS (PARTITION BY item_id, store_id ORDER BY day, order_key, line_number))
SELECT item_id, store_id, winner_order, winner_line, order_key AS lost_order, line_number AS lost_line FROM w WHERE rn > 1""")
def collisions(spark, sf_dir):
    return P.collisions(observations(spark, sf_dir))


@query(f"""{WITH}, p AS (SELECT item_id, count(*) AS n, {MEAN} AS ref, CAST(min(price) AS DOUBLE) AS low FROM {latest('obs')} GROUP BY item_id)
SELECT count(*) AS items, count(*) FILTER (n >= 2) AS two_stores, count(*) FILTER (n >= 3) AS three_stores, count(*) FILTER (ref IS NULL) AS without,
count(*) FILTER (low / ref <= CAST(0.70 AS DOUBLE)) AS at_70, count(*) FILTER (low / ref <= CAST(0.82 AS DOUBLE)) AS at_82 FROM cat LEFT JOIN p USING (item_id)""")
def coverage_report(spark, sf_dir):
    return P.coverage(observations(spark, sf_dir), catalogue(spark, sf_dir))


@query(f"""{WITH}, {CODES}, u AS (SELECT obs.*, CASE WHEN live_pct > 0 AND only_brand IS NOT NULL AND lower(only_brand) <> lower(brand) THEN CAST(0 AS DECIMAL(6,4)) WHEN live_pct > 0 THEN live_pct ELSE pct END AS used_pct
FROM obs JOIN cat USING (item_id) LEFT JOIN codes USING (store_id)) SELECT order_key, line_number, item_id, store_id, used_pct, CAST(price * (1 - used_pct) AS DECIMAL(26,8)) AS effective FROM u""")
def effective_price(spark, sf_dir):
    return P.live_effective(observations(spark, sf_dir), codes(spark, sf_dir), catalogue(spark, sf_dir)).select("order_key", "line_number", "item_id", "store_id", "used_pct", "effective")


@query(f"""{WITH} SELECT item_id, count(*) AS n, count(DISTINCT store_id) AS n_stores, min(confidence) AS low, max(confidence) AS high, CAST(floor(CAST(sum(confidence) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS DECIMAL(4,3)) AS mean_confidence FROM obs GROUP BY item_id""")
def confidence_profile(spark, sf_dir):
    mean = F.sum("confidence").cast("double") / F.count("*")
    return observations(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("store_id").alias("n_stores"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), (F.floor(mean * 1000 + 0.5) / 1000).cast("decimal(4,3)").alias("mean_confidence"))


@query(f"{WITH}, u AS (SELECT url, count(DISTINCT item_id) AS n FROM obs GROUP BY url) SELECT url, n AS n_items FROM u WHERE n > 1")
def shared_url(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("url").agg(F.countDistinct("item_id").alias("n_items")).filter("n_items > 1")


@query("""WITH p AS (SELECT p_partkey AS item_id, 2018 + p_partkey % 9 AS y, CASE WHEN p_partkey % 3 = 0 THEN 'Counter Veron' ELSE p_type END AS model,
  CASE p_partkey % 4 WHEN 0 THEN 'https://s.example/p-' || p_partkey % 97 || '-x' WHEN 1 THEN 'https://s.example/counter-origin-' || p_partkey || 'x' WHEN 2 THEN 'https://www.padelproshop.com/p-2' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') ELSE 'https://s.example/pala-20' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || '-' || p_partkey || 'x' END AS url FROM part),
n AS (SELECT url, count(*) AS n FROM p GROUP BY url)
SELECT item_id, CASE WHEN regexp_matches(url, '20[0-9][0-9]') AND CAST(regexp_extract(url, '20[0-9][0-9]') AS INTEGER) <> y THEN 'A'
WHEN NOT regexp_matches(url, '20[0-9][0-9]') AND regexp_extract(url, '/[^/]*-(19|2[0-9])-[^/]{0,2}$', 1) <> '' AND 2000 + CAST(regexp_extract(url, '/[^/]*-(19|2[0-9])-[^/]{0,2}$', 1) AS INTEGER) <> y THEN 'B'
WHEN n > 1 THEN 'C' WHEN contains(url, 'counter-origin') AND model = 'Counter Veron' THEN 'D'
WHEN contains(url, 'padelproshop.com') AND 2000 + CAST(regexp_extract(url, '-2([0-9][0-9])$', 1) AS INTEGER) BETWEEN 2018 AND 2030 AND 2000 + CAST(regexp_extract(url, '-2([0-9][0-9])$', 1) AS INTEGER) <> y THEN 'E' END AS reason FROM p JOIN n USING (url)""")
def url_guards(spark, sf_dir):
    k = F.col("p_partkey")
    two = F.lpad((k % 30).cast("string"), 2, "0")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://s.example/p-"), k % 97, F.lit("-x"))).when(k % 4 == 1, F.concat(F.lit("https://s.example/counter-origin-"), k, F.lit("x")))
    url = url.when(k % 4 == 2, F.concat(F.lit("https://www.padelproshop.com/p-2"), two)).otherwise(F.concat(F.lit("https://s.example/pala-20"), two, F.lit("-"), k, F.lit("x")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("item_id"), (2018 + k % 9).alias("year"), F.when(k % 3 == 0, "Counter Veron").otherwise(F.col("p_type")).alias("model"), url.alias("url"))
    rows = rows.join(rows.groupBy("url").agg(F.count("*").alias("n")), "url")
    return rows.select("item_id", url_guard(F.col("url"), F.col("year"), F.col("model"), F.col("n")).alias("reason"))


@query(f"""{WITH}, f AS (SELECT obs.item_id, seen_at <= TIMESTAMP '{DEALS_NOW}' - to_days(CAST(item_id % 5 * 100 AS INTEGER)) + INTERVAL 3 HOUR AS fresh FROM obs JOIN cat USING (item_id))
SELECT item_id, count(*) AS n FROM f WHERE fresh OR NOT (SELECT bool_or(fresh) FROM f) GROUP BY item_id""")
def freshness_guard(spark, sf_dir):
    return P.fresh_rows(observations(spark, sf_dir), deal_items(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n"))
