"""Queries of filters, joins, aggregates, windows, sorts, sets and keyed writes, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealforge.functions.text import round_half_up
from dealforge.operators import ranking, sinks
from dealforge.sources.tables import CATALOGUE_SQL, LISTINGS_SQL, NOW, catalogue, listings, table

QUERIES: dict = {}
ORACLE: dict = {}
LST = f"WITH {LISTINGS_SQL}"
CAT = f"WITH {CATALOGUE_SQL}"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"{LST} SELECT listing_id, price FROM lst WHERE price >= 20 AND price <= 2000 AND seller <> 3")
def filter_compare(spark, sf):
    return listings(spark, sf).filter(F.col("price").between(20, 2000) & (F.col("seller") != 3)).select("listing_id", "price")


@query(f"{LST} SELECT listing_id, condition FROM lst WHERE condition IN ('new', 'good') AND seller NOT IN (1, 2, 3)")
def filter_in(spark, sf):
    return listings(spark, sf).filter(F.col("condition").isin("new", "good") & ~F.col("seller").isin(1, 2, 3)).select("listing_id", "condition")


@query(f"{LST} SELECT listing_id, platform FROM lst WHERE condition IS NULL AND title IS NOT NULL")
def filter_null(spark, sf):
    return listings(spark, sf).filter(F.col("condition").isNull() & F.col("title").isNotNull()).select("listing_id", "platform")


@query(f"{LST} SELECT listing_id, price FROM lst WHERE condition IS NULL OR price < 5")
def filter_or(spark, sf):
    return listings(spark, sf).filter(F.col("condition").isNull() | (F.col("price") < 5)).select("listing_id", "price")


@query("SELECT o_orderkey AS id FROM orders WHERE list_contains(string_split(o_orderpriority, '-'), 'URGENT')")
def filter_array_contains(spark, sf):
    return table(spark, sf, "orders").filter(F.array_contains(F.split("o_orderpriority", "-"), "URGENT")).select(F.col("o_orderkey").alias("id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def filter_json_path(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query(f"{LST} SELECT listing_id, title, price FROM lst WHERE contains(lower(title), 'red') AND contains(lower(title), 'bolt') AND condition IN ('new', 'as_good_as_new') AND price BETWEEN 1 AND 500")
def keyword_search(spark, sf):
    rows = ranking.keyword_search(listings(spark, sf), ["red", "bolt"], conditions=["like_new"], low=1, high=500)
    return rows.select("listing_id", "title", "price")


@query(f"{LST} SELECT listing_id, title FROM lst WHERE contains(lower(title), 'small ring')")
def phrase_search(spark, sf):
    return listings(spark, sf).filter(F.lower("title").contains("small ring")).select("listing_id", "title")


@query(f"{LST} SELECT listing_id, CASE WHEN regexp_matches(lower(title), '^old') THEN 'used' WHEN contains(lower(title), 'anvil') THEN 'clothing' WHEN regexp_matches(lower(title), '\\bpromo\\b') THEN 'pack' END AS reason FROM lst")
def title_exclusion(spark, sf):
    return listings(spark, sf).select("listing_id", ranking.exclusion_reason(F.col("title"), [("used", "^old"), ("clothing", "anvil"), ("pack", "(?<![a-z0-9_])promo(?![a-z0-9_])")]).alias("reason"))


@query(f"{LST} SELECT listing_id FROM lst WHERE NOT regexp_matches(lower(title), 'broken|old|plate') AND NOT coalesce(CAST(nullif(regexp_extract(title, '20[0-9][0-9]'), '') AS INTEGER) < 2024, false)")
def listing_exclusion(spark, sf):
    return ranking.without_used(listings(spark, sf), ["broken", "old", "plate"], 2024).select("listing_id")


@query(f"{LST} SELECT listing_id FROM lst WHERE len(string_split(trim(title), ' ')) >= 4 AND price >= 15 AND regexp_matches(lower(title), 'ring|bolt|gear')")
def listing_quality(spark, sf):
    rows = listings(spark, sf).filter((F.size(F.split(F.trim("title"), " ")) >= 4) & (F.col("price") >= 15) & F.lower("title").rlike("ring|bolt|gear"))
    return rows.select("listing_id")


@query(f"{LST} SELECT item_id FROM cat WHERE brand IN ('Brand#2', 'Brand#5') AND model = 'SMALL' AND contains(lower(name), 'r') AND item_id IN (SELECT item_id FROM lst WHERE price < 10)")
def facet_search(spark, sf):
    cheap = listings(spark, sf).filter("price < 10").select("item_id")
    return catalogue(spark, sf).filter(F.col("brand").isin("Brand#2", "Brand#5") & (F.col("model") == "SMALL") & F.lower("name").contains("r")).join(cheap, "item_id", "left_semi").select("item_id")


@query(f"{LST} SELECT 'L' || listing_id AS external_id, title, price, coalesce(condition, 'unknown') AS condition, 'EUR' AS currency FROM lst")
def project_offer(spark, sf):
    return listings(spark, sf).select(F.concat(F.lit("L"), "listing_id").alias("external_id"), "title", "price", F.coalesce("condition", F.lit("unknown")).alias("condition"), F.lit("EUR").alias("currency"))


@query(f"{LST} SELECT listing_id, CASE condition WHEN 'new' THEN 'Nuevo' WHEN 'as_good_as_new' THEN 'Como nuevo' WHEN 'good' THEN 'Bueno' ELSE 'Usado' END AS label FROM lst")
def condition_map(spark, sf):
    return listings(spark, sf).select("listing_id", ranking.condition_label(F.col("condition")).alias("label"))


@query("SELECT o_orderkey AS order_key, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE contains(lower(n_name), 'a') OR contains(lower(c_mktsegment), 'mach')")
def sql_join_like(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.filter(F.lower("n_name").contains("a") | F.lower("c_mktsegment").contains("mach")).select(F.col("o_orderkey").alias("order_key"), F.col("c_name").alias("customer"), F.col("n_name").alias("nation"))


@query("SELECT l_orderkey AS order_key, l_linenumber AS line_number, CASE WHEN n > 0 THEN total END AS reference FROM lineitem LEFT JOIN (SELECT o_orderkey, o_totalprice AS total, CAST(o_orderstatus = 'F' AS INTEGER) AS n FROM orders) ON l_orderkey = o_orderkey")
def left_reference(spark, sf):
    build = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("reference"))
    return table(spark, sf, "lineitem").join(build, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), "reference")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) OR p_partkey IN (SELECT event_id % 200 FROM events)")
def semi_join(spark, sf):
    some = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")).union(table(spark, sf, "events").select(F.col("event_id") % 200))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(some, "id", "left_semi")


@query("""SELECT c_custkey AS player, count(*) AS played FROM customer JOIN (SELECT o_orderkey, o_custkey AS p1, (o_custkey + 1) % (SELECT count(*) FROM customer) AS p2 FROM orders) m ON c_custkey = p1 OR c_custkey = p2 GROUP BY c_custkey""")
def either_key_join(spark, sf):
    players = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"))
    n = players.agg(F.count("*").alias("n"))
    games = table(spark, sf, "orders").select("o_custkey").crossJoin(F.broadcast(n))  # one row
    keys = games.select(F.explode(F.array_distinct(F.array("o_custkey", (F.col("o_custkey") + 1) % F.col("n")))).alias("player"))
    return keys.groupBy("player").agg(F.count("*").alias("played")).join(players, "player", "left_semi")


@query("""WITH b AS (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'own' END, flag, 'none') AS image FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def coalesce_join(spark, sf):
    b = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    rows = table(spark, sf, "orders").join(b, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce(F.when(F.col("o_orderstatus") == "P", "own"), "flag", F.lit("none")).alias("image"))


@query(f"{LST}, ph AS (SELECT DISTINCT lower(name) AS phrase FROM cat) SELECT phrase, count(*) AS n, min(price) AS low FROM ph JOIN lst ON contains(lower(title), phrase) GROUP BY phrase")
def phrase_join(spark, sf):
    phrases = catalogue(spark, sf).select(F.lower("name").alias("phrase")).distinct()
    return ranking.phrase_join(listings(spark, sf), phrases).groupBy("phrase").agg(F.count("*").alias("n"), F.min("price").alias("low"))


@query(f"{LST} SELECT seller, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(CAST(price AS DOUBLE)), 4) END AS median_price FROM lst GROUP BY seller")
def median_min_support(spark, sf):
    return listings(spark, sf).groupBy("seller").agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, F.round(F.median(F.col("price").cast("double")), 4)).alias("median_price"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY o_orderpriority")
def count_filter(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM orders) AS orders, (SELECT max(ts) FROM events) AS last_event")
def scalar_summary(spark, sf):
    one = [table(spark, sf, t).agg(c) for t, c in (("part", F.count("*").alias("parts")), ("orders", F.count("*").alias("orders")), ("events", F.max("ts").alias("last_event")))]
    return reduce(lambda a, b: a.crossJoin(b), one)  # one row each


@query("SELECT l_suppkey AS store_id, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def group_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("store_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "store_id")


@query("SELECT DISTINCT p_brand AS brand FROM part")
def distinct_sorted(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct().orderBy("brand")


@query("SELECT o_custkey AS player, year(o_orderdate) AS season, count(*) AS played, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) FILTER (o_orderstatus = 'P') AS drawn, floor(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*) + 0.5) AS pct FROM orders GROUP BY ALL")
def win_rates(spark, sf):
    won = F.count_if(F.col("o_orderstatus") == "F")
    out = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").cast("bigint").alias("season")).agg(F.count("*").alias("played"), won.alias("won"), F.count_if(F.col("o_orderstatus") == "P").alias("drawn"))
    return out.withColumn("pct", F.floor(F.col("won") * F.lit(100.0) / F.col("played") + 0.5).cast("double"))


@query(f"{LST} SELECT min(price) AS best, floor(CAST(sum(price) AS DOUBLE) / count(*) + 0.5) AS mean, count(*) FILTER (platform = 'view') AS first_platform, count(*) FILTER (platform = 'click') AS second_platform FROM lst WHERE contains(lower(title), 'gear')")
def search_summary(spark, sf):
    rows = listings(spark, sf).filter(F.lower("title").contains("gear"))
    return rows.agg(F.min("price").alias("best"), F.floor(F.sum("price").cast("double") / F.count("*") + 0.5).cast("double").alias("mean"), F.count_if(F.col("platform") == "view").alias("first_platform"), F.count_if(F.col("platform") == "click").alias("second_platform"))


@query("SELECT lower(p_name) AS query, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def top_searches(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_name").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10)


SERIES = "WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


@query(f"SELECT * FROM (SELECT event_id, user_id, event_type, value, lag(value) OVER w AS previous FROM events {SERIES}) WHERE value < previous")
def price_drops(spark, sf):
    return ranking.price_drops(table(spark, sf, "events")).select("event_id", "user_id", "event_type", "value", "previous")


# All rows lie in January, when Madrid is one hour ahead of UTC.
@query(f"""WITH s AS (SELECT event_type, user_id, ts, value, value < lag(value) OVER w AS fell FROM events {SERIES}),
d AS (SELECT event_type, hour(ts + INTERVAL 1 HOUR) AS h, dayofweek(ts + INTERVAL 1 HOUR) AS wd FROM s WHERE fell),
hh AS (SELECT event_type, arg_max(h, n * 100 - h) AS top_hour FROM (SELECT event_type, h, count(*) AS n FROM d GROUP BY ALL) GROUP BY event_type),
ww AS (SELECT event_type, arg_max(wd, n * 100 - wd) AS top_weekday FROM (SELECT event_type, wd, count(*) AS n FROM d GROUP BY ALL) GROUP BY event_type)
SELECT event_type AS store, count(*) AS observations, count(DISTINCT user_id) AS items, count(DISTINCT CAST(ts + INTERVAL 1 HOUR AS DATE)) AS days, count(*) FILTER (fell) AS drops, any_value(top_hour) AS top_hour, any_value(top_weekday) AS top_weekday,
  count(DISTINCT CAST(ts + INTERVAL 1 HOUR AS DATE)) >= 14 AS reliable FROM s LEFT JOIN hh USING (event_type) LEFT JOIN ww USING (event_type) GROUP BY event_type""")
def price_patterns(spark, sf):
    return ranking.price_patterns(table(spark, sf, "events"))


OPPORTUNITY = f"""{LST}, ph AS (SELECT DISTINCT lower(name) AS phrase FROM cat),
j AS (SELECT lst.*, phrase FROM ph JOIN lst ON contains(lower(title), phrase) WHERE condition IN ('new', 'as_good_as_new') AND price >= 1 AND ts >= TIMESTAMP '{NOW}' - INTERVAL 25 DAY),
m AS (SELECT phrase, median(CAST(price AS DOUBLE)) AS med FROM j GROUP BY phrase HAVING count(*) >= 5),
s AS (SELECT listing_id, phrase, price, condition, likes, med, (med - CAST(price AS DOUBLE)) / med AS disc, CAST(floor(epoch(TIMESTAMP '{NOW}' - ts) / 86400) AS INTEGER) AS age, CAST(nullif(regexp_extract(coalesce(product, phrase), '20[0-9][0-9]'), '') AS INTEGER) AS y FROM j JOIN m USING (phrase) WHERE CAST(price AS DOUBLE) < med * 0.75::DOUBLE),
o AS (SELECT listing_id, phrase, floor(floor(disc * 100 + 0.5) + 0.1::DOUBLE * (med - CAST(price AS DOUBLE)) + CASE WHEN y IS NULL THEN -10 ELSE CASE y WHEN 2026 THEN 10 WHEN 2025 THEN 5 WHEN 2024 THEN 2 WHEN 2023 THEN -5 WHEN 2022 THEN -15 WHEN 2021 THEN -20 ELSE -25 END END
  + CASE WHEN condition = 'new' THEN 8 ELSE 0 END + CASE WHEN age > 45 THEN -60 WHEN age > 30 THEN -40 WHEN age > 21 THEN -25 WHEN age > 14 THEN -15 WHEN age > 7 THEN -5 ELSE 0 END + 8 * ln(1 + likes) + 0.5) AS score FROM s)"""


@query(f"{OPPORTUNITY} SELECT listing_id, phrase, CAST(score AS BIGINT) AS score FROM o QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, phrase) = 1")
def opportunity_score(spark, sf):
    phrases = catalogue(spark, sf).select(F.lower("name").alias("phrase")).distinct()
    return ranking.opportunities(listings(spark, sf), phrases, NOW, days=25, least_price=1)


@query(f"""{OPPORTUNITY}, b AS (SELECT listing_id, CAST(max(score) AS BIGINT) AS score FROM o GROUP BY listing_id),
n AS (SELECT listing_id, score, row_number() OVER (ORDER BY score DESC, listing_id) AS place FROM b ORDER BY place LIMIT 40), p AS (SELECT listing_id, place AS previous FROM (SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS place FROM b) WHERE place <= 40)
SELECT listing_id, score, place, previous, previous - place AS moved, CASE WHEN previous IS NULL THEN 'new' WHEN place < previous THEN 'up' WHEN place > previous THEN 'down' ELSE 'same' END AS trend FROM n LEFT JOIN p USING (listing_id)""")
def rank_trend(spark, sf):
    scored = opportunity_score(spark, sf).select("listing_id", "score")
    before = ranking.top(scored.select("listing_id"), [F.asc("listing_id")], 40).select("listing_id", F.col("place").alias("previous"))
    return ranking.trend(ranking.top(scored, [F.desc("score"), F.asc("listing_id")], 40), before)


@query("SELECT p_partkey AS id, p_size AS size, p_retailprice AS price FROM part")
def sort_multi(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).orderBy(F.desc_nulls_last("size"), F.asc_nulls_last("price"), "id")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60) WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_verified(spark, sf):
    """The top 20 that pass a check, made on the first 60 only."""
    first = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(60)
    return first.filter("o_orderstatus <> 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT p_partkey AS id FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def page_slice(spark, sf):
    return table(spark, sf, "part").orderBy("p_name", "p_partkey").offset(100).limit(50).select(F.col("p_partkey").alias("id"))


@query(f"{LST} SELECT platform, listing_id, price FROM lst WHERE platform IN ('view', 'click') AND price < 3")
def union_sources(spark, sf):
    rows = listings(spark, sf).filter("price < 3").select("platform", "listing_id", "price")
    return rows.filter("platform = 'view'").unionByName(rows.filter("platform = 'click'")).orderBy("price", "listing_id")


@query(f"{LST} SELECT item_id, min(listing_id) AS listing_id FROM lst WHERE platform IN ('view', 'click') GROUP BY item_id")
def union_dedup(spark, sf):
    rows = listings(spark, sf).select("item_id", "listing_id", "platform")
    return rows.filter("platform = 'view'").unionByName(rows.filter("platform = 'click'")).groupBy("item_id").agg(F.min("listing_id").alias("listing_id"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01'")
def set_except(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("id")).subtract(rows.filter("l_shipdate >= timestamp_ntz'2001-10-01'").select("l_partkey"))


STATE = f"""{LST}, old AS (SELECT item_id, platform, max(price) AS price, bool_or(likes > 10) AS active FROM lst WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), new AS (SELECT item_id, platform, min(price) AS price FROM lst WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL)"""


@query(f"""{STATE} SELECT item_id, platform, CASE WHEN o.price IS NULL THEN 'insert' WHEN n.price IS NULL THEN CASE WHEN active THEN 'expire' ELSE 'keep' END WHEN NOT active THEN 'reactivate' ELSE 'keep' END AS action,
n.price IS NOT NULL AND (o.price IS NULL OR NOT active OR n.price < o.price * 0.99) AS notify FROM old o FULL JOIN new n USING (item_id, platform)""")
def state_sync(spark, sf):
    rows = listings(spark, sf)
    old = rows.filter("ts < timestamp_ntz'2024-01-15'").groupBy("item_id", "platform").agg(F.max("price").alias("price"), F.bool_or(F.col("likes") > 10).alias("active"))
    new = rows.filter("ts >= timestamp_ntz'2024-01-15'").groupBy("item_id", "platform").agg(F.min("price").alias("price"))
    return sinks.state_sync(old, new, ["item_id", "platform"]).select("item_id", "platform", "action", "notify")


@query("""WITH x AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, value, event_id FROM events) SELECT user_id, event_type, day, value, event_id FROM x QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id DESC) = 1""")
def daily_upsert(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value", "event_id")
    return sinks.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id", "event_type", "day"], [F.desc("event_id")], ranked=False)


@query("SELECT event_type AS title, min(value) AS low, max(value) AS high, count(*) AS seen, count(DISTINCT user_id) AS n_sources FROM events GROUP BY event_type")
def candidate_merge(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("title"), F.col("value").alias("price"), F.col("user_id").cast("string").alias("source"))
    return sinks.merge_candidates(rows).select("title", "low", "high", "seen", F.size("sources").cast("bigint").alias("n_sources"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'")
def ttl_evict(spark, sf):
    return sinks.keep_since(table(spark, sf, "events"), "ts", NOW, hours=48).select("event_id", "user_id")


@query("""WITH s AS (SELECT l_suppkey AS store_id, l_partkey AS item_id, max(l_shipdate) >= TIMESTAMP '1998-01-01' AS seen FROM lineitem GROUP BY ALL), g AS (SELECT store_id, count(*) FILTER (seen) >= 0.5 * count(*) AND count(*) FILTER (seen) > 0 AS ok FROM s GROUP BY store_id) SELECT store_id, item_id FROM s JOIN g USING (store_id) WHERE ok AND NOT seen""")
def deactivate_unseen(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("item_id"), "l_shipdate")
    return sinks.deactivate_unseen(rows.select("store_id", "item_id").distinct(), rows.filter("l_shipdate >= timestamp_ntz'1998-01-01'").select("store_id", "item_id").distinct(), "store_id", ["store_id", "item_id"])


@query("SELECT s_suppkey AS store_id FROM supplier WHERE NOT (s_acctbal < 0 AND s_suppkey % 2 = 0)")
def backoff_filter(spark, sf):
    failed = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("store_id"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(NOW) + F.expr("interval 1 day")).otherwise(F.lit(NOW) - F.expr("interval 1 day")).alias("until"))
    return sinks.without_backoff(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id")), failed, "store_id", NOW)


@query("""WITH k AS (SELECT s_suppkey AS store_id, 'C' || s_suppkey AS code, s_suppkey % 3 = 0 AS auto FROM supplier WHERE s_suppkey % 2 = 0), f AS (SELECT s_suppkey AS store_id, 'C' || (s_suppkey + s_suppkey % 5) AS code FROM supplier WHERE s_suppkey % 5 <> 1)
SELECT store_id, coalesce(f.code, k.code) AS code, CASE WHEN k.code IS NULL THEN 'insert' WHEN f.code IS NULL THEN CASE WHEN auto THEN 'deactivate' ELSE 'keep' END WHEN f.code <> k.code THEN 'update' ELSE 'keep' END AS action FROM k FULL JOIN f USING (store_id)""")
def coupon_sync(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"))
    known = s.filter("store_id % 2 = 0").select("store_id", F.concat(F.lit("C"), "store_id").alias("code"), (F.col("store_id") % 3 == 0).alias("auto"))
    found = s.filter("store_id % 5 <> 1").select("store_id", F.concat(F.lit("C"), F.col("store_id") + F.col("store_id") % 5).alias("code"))
    return sinks.coupon_sync(known, found)


@query(f"""{LST} SELECT listing_id, item_id, price, floor((1 - CAST(price AS DOUBLE) / 40) * 100 + 0.5) AS discount FROM lst WHERE condition = 'new' AND price <= 26""")
def new_under_reference(spark, sf):
    rows = listings(spark, sf).filter("condition = 'new'").withColumn("reference", F.lit(40.0))
    return ranking.under_reference(rows, share=0.65).select("listing_id", "item_id", "price", round_half_up((1 - F.col("price").cast("double") / F.col("reference")) * 100).cast("double").alias("discount"))


ALERTS = """a AS (SELECT c_custkey AS alert_id, list_sort([['red', 'blue', 'small', 'old'][1 + c_custkey % 4], ['ring', 'steel', 'brass', 'case', 'copper'][1 + c_custkey % 5]]) AS words,
  CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'good' END AS condition, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 7 * 10 AS DECIMAL(10,2)) END AS max_price FROM customer)"""


def _alerts(spark, sf):
    """Alerts of two words, some for one condition, some without a limit."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.get(F.split(F.lit(words), " "), (k % n).cast("int"))
    asked = F.concat_ws(" ", pick("red blue small old", 4), pick("ring steel brass case copper", 5))
    return table(spark, sf, "customer").select(k.alias("alert_id"), asked.alias("query"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "good").alias("condition"), F.when(k % 10 != 0, (k % 7 * 10).cast("decimal(10,2)")).alias("max_price"))


@query(f"""{LST}, {ALERTS}, m AS (SELECT words, condition, listing_id, price, alert_id FROM a JOIN (SELECT listing_id, price, condition AS had, string_split(lower(title), ' ') AS tw FROM lst) ON list_contains(tw, words[1]) AND list_contains(tw, words[2]) AND (condition IS NULL OR condition = had) AND (max_price IS NULL OR price <= max_price))
SELECT words, condition, listing_id, price, count(*) AS n_alerts FROM m WHERE NOT EXISTS (SELECT 1 FROM lst t WHERE t.listing_id % 3 = 0 AND t.listing_id = m.listing_id AND t.seller = m.alert_id) GROUP BY ALL""")
def alert_matches(spark, sf):
    """Every third listing was told to the alert of its seller's number."""
    rows = listings(spark, sf)
    told = rows.filter("listing_id % 3 = 0").select(F.col("seller").alias("alert_id"), "listing_id")
    return ranking.alert_matches(_alerts(spark, sf), rows, told)


@query(f"WITH {ALERTS} SELECT alert_id, words, condition, max_price FROM a")
def alert_members(spark, sf):
    return ranking.alert_classes(_alerts(spark, sf))


@query(f"{CAT} SELECT brand, item_id, list_price FROM cat QUALIFY row_number() OVER (PARTITION BY brand ORDER BY list_price DESC, item_id) <= 12")
def brand_page(spark, sf):
    w = Window.partitionBy("brand").orderBy(F.desc("list_price"), "item_id")
    return catalogue(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 12").select("brand", "item_id", "list_price")


@query("""WITH f AS (SELECT o_custkey AS user_id, l_partkey AS item_id, max(CAST(l_extendedprice * 0.9 AS DECIMAL(15,2))) AS wanted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), p AS (SELECT l_partkey AS item_id, min(CAST(l_extendedprice AS DECIMAL(15,2))) AS price FROM lineitem GROUP BY l_partkey)
SELECT user_id, item_id, price FROM f JOIN p USING (item_id) WHERE price <= wanted AND user_id % 5 <> 0""")
def favourite_drops(spark, sf):
    """Every fifth user was told of a lower price before."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), (F.col("l_extendedprice") * 0.9).cast("decimal(15,2)").alias("wanted"))
    fav = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("user_id", "item_id").agg(F.max("wanted").alias("wanted"))
    told = fav.filter("user_id % 5 = 0").select("user_id", "item_id", F.lit(0).cast("decimal(15,2)").alias("price"))
    return ranking.favourite_drops(fav, lines.select("item_id", "price"), told)


@query(f"""{LST}, r AS (SELECT *, coalesce(condition IN ('new', 'un_opened', 'as_good_as_new', 'Nuevo con etiqueta', 'Nuevo sin etiqueta') AND price >= 10, false) AS valid FROM lst WHERE contains(lower(title), 'ring')),
m AS (SELECT median(CAST(price AS DOUBLE)) AS med, count(*) AS n FROM r WHERE valid) SELECT listing_id, valid AND coalesce(n >= 5 AND CAST(price AS DOUBLE) < med * 0.75::DOUBLE, false) AS opportunity FROM r, m""")
def search_flags(spark, sf):
    return ranking.search_flags(ranking.keyword_search(listings(spark, sf), ["ring"])).select("listing_id", "opportunity")


@query("""WITH s AS (SELECT *, coalesce(value < lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), false) AS fell FROM events), d AS (SELECT event_type AS store, CAST(hour(ts + INTERVAL 1 HOUR) AS BIGINT) AS h, CAST(dayofweek(ts + INTERVAL 1 HOUR) AS BIGINT) AS w FROM s WHERE fell)
SELECT store, 'hour' AS kind, h AS slot, count(*) AS drops FROM d GROUP BY ALL UNION ALL SELECT store, 'weekday', w, count(*) FROM d GROUP BY ALL""")
def drop_histogram(spark, sf):
    return ranking.drop_histogram(table(spark, sf, "events"))


@query(f"{LST}, r AS (SELECT l_partkey AS item_id, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) / 800 * 100 + 0.5) / 100 AS reference FROM lineitem GROUP BY l_partkey) SELECT listing_id, lst.item_id, reference FROM lst JOIN r ON r.item_id = lst.item_id WHERE condition = 'new' AND CAST(price AS DOUBLE) <= reference * 0.65::DOUBLE")
def under_own_reference(spark, sf):
    """New listings against their own product's reference, by an inner join with a condition on it."""
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(round_half_up(F.sum(price).cast("double") / F.count("*") / 800, 2).alias("reference"))
    rows = listings(spark, sf).filter("condition = 'new'").join(refs, "item_id")
    return ranking.under_reference(rows, share=0.65).select("listing_id", "item_id", "reference")


@query("""WITH o AS (SELECT c_custkey AS key, CAST(c_custkey % 4 AS BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey), t AS (SELECT coalesce(o.key, w.key) AS key, CAST(coalesce(o.n, 0) + coalesce(w.n, 0) AS BIGINT) AS n FROM o FULL JOIN w ON o.key = w.key)
SELECT key, n FROM t ORDER BY n DESC, key LIMIT 10""")
def counter_top(spark, sf):
    """Stored counters plus new ones, and the ten greatest."""
    old = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4).cast("bigint").alias("n"))
    return sinks.count_up(old, table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))).orderBy(F.desc("n"), "key").limit(10)
