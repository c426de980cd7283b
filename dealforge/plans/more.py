"""Queries of guarded writes, re-keying, dictionaries and match rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators import matching as M
from dealforge.operators import sinks
from dealforge.sources.tables import CATALOGUE_SQL, catalogue, table

QUERIES: dict = {}
ORACLE: dict = {}
CAT = f"WITH {CATALOGUE_SQL}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD'))")
def guarded_upsert(spark, sf):
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.when(F.col("c_mktsegment") == "MACHINERY", "matched").when(F.col("c_mktsegment") == "HOUSEHOLD", "ignorada").alias("state"))
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return sinks.guarded(new, current, "customer").select("id")


@query("WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS keep FROM part) SELECT keep AS item_id, count(*) AS n FROM lineitem JOIN m ON p_partkey = l_partkey GROUP BY keep")
def rekey_merge(spark, sf):
    mapping = M.survivors(catalogue(spark, sf).select("item_id", "name"), ["name"]).filter("item_id <> keep_id")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return sinks.rekey(rows, mapping, "item_id").groupBy("item_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN m ELSE c_mktsegment END AS image FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def fill_image(spark, sf):
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).alias("image"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("image"))
    return sinks.fill_null(own, new, "id", "image")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = events.user_id AND o.event_type = events.event_type) GROUP BY ALL")
def insert_ignore(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return sinks.insert_ignore(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id", "event_type"], [F.asc("event_id")])


@query(f"""{CAT}, c AS (SELECT DISTINCT 'variant' AS kind, variant AS alias FROM cat WHERE variant < 'm'), n AS (SELECT DISTINCT 'variant' AS kind, variant AS alias FROM cat EXCEPT SELECT * FROM c)
SELECT kind, alias, row_number() OVER (ORDER BY late, -length(alias) * late, alias) AS priority FROM (SELECT *, 0 AS late FROM c UNION ALL SELECT *, 1 FROM n)""")
def dictionary_merge(spark, sf):
    found = M.dictionary_of(catalogue(spark, sf)).filter("kind = 'variant'")
    curated = found.filter("alias < 'm'").withColumn("priority", F.row_number().over(Window.partitionBy("kind").orderBy("alias")))
    return M.merge_dictionaries(curated, found).select("kind", "alias", F.col("priority").cast("bigint").alias("priority"))


@query("""WITH c AS (SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'Bluesky' WHEN 2 THEN 'ZZ' ELSE 'OLD' END || p_partkey % 100 AS code FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS brand FROM part)
SELECT item_id, arg_max(brand, length(brand)) FILTER (starts_with(upper(code), upper(brand))) AS brand FROM c LEFT JOIN b ON starts_with(upper(code), upper(brand)) GROUP BY item_id""")
def code_brand(spark, sf):
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "RED").when(k % 4 == 1, "Bluesky").when(k % 4 == 2, "ZZ").otherwise("OLD")
    p = table(spark, sf, "part")
    return M.brand_of_code(p.select(k.alias("item_id"), F.concat(head, k % 100).alias("code")), p.select(F.split("p_name", " ")[0].alias("brand")), "item_id")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS found FROM events")
def json_find_key(spark, sf):
    """A key's first number, at any depth."""
    nested = F.concat(F.lit('{"a": {"b": [1, '), "props", F.lit("]}}"))
    return table(spark, sf, "events").select("event_id", F.regexp_extract(nested, '"k"\\s*:\\s*([0-9]+)', 1).try_cast("int").alias("found"))


@query(f"""{CAT}, s AS (SELECT a.item_id, b.item_id AS other_id, CAST(len(list_filter(string_split(a.name, ' '), lambda w: list_contains(string_split(b.name, ' '), w))) AS DOUBLE) / len(string_split(a.name, ' ')) AS ratio FROM cat a JOIN cat b ON a.brand = b.brand AND a.item_id <> b.item_id)
SELECT * FROM s WHERE ratio >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ratio DESC, other_id) <= 5""")
def near_candidates(spark, sf):
    c = catalogue(spark, sf)
    return M.near_names(c, c, ["brand"])


@query("""WITH n AS (SELECT l_suppkey AS id, count(*) AS seen, min(l_extendedprice) AS low, max(l_extendedprice) AS high, list_sort(list_distinct(list(l_shipmode))) AS sources FROM (SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice, l_returnflag AS l_shipmode FROM lineitem WHERE l_linenumber <= 3) GROUP BY l_suppkey),
c AS (SELECT s_suppkey AS id, CAST(5 AS BIGINT) AS seen, CAST(100 AS DECIMAL(15,2)) AS low, CAST(200 AS DECIMAL(15,2)) AS high, ['old', 'R'] AS sources FROM supplier WHERE s_suppkey % 2 = 0)
SELECT CAST(coalesce(n.id, c.id) AS VARCHAR) AS title, least(n.low, c.low) AS low, greatest(n.high, c.high) AS high, CAST(coalesce(n.seen, 0) + coalesce(c.seen, 0) AS BIGINT) AS seen, list_sort(list_distinct(list_concat(coalesce(n.sources, []), coalesce(c.sources, [])))) AS sources FROM n FULL JOIN c ON n.id = c.id""")
def candidate_counter(spark, sf):
    """Stored candidates meet new sightings."""
    new = table(spark, sf, "lineitem").filter("l_linenumber <= 3").select(F.col("l_suppkey").cast("string").alias("title"), F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), F.col("l_returnflag").alias("source"))
    old = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("title"), F.lit(100).cast("decimal(15,2)").alias("low"), F.lit(200).cast("decimal(15,2)").alias("high"), F.lit(5).cast("bigint").alias("seen"), F.array(F.lit("old"), F.lit("R")).alias("sources"))
    return sinks.merge_into_candidates(old, new)


@query("SELECT p_partkey AS item_id, p_size AS size FROM part")
def replace_table(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    return sinks.replace_table(p.withColumn("size", F.lit(0)), p)


@query("SELECT p_partkey AS item_id, p_size AS size FROM part")
def replace_table_refused(spark, sf):
    """No new rows: the old ones stay."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    return sinks.replace_table(p, p.filter("item_id < 0"))


@query("""WITH m AS (SELECT p_partkey AS item_id, min(p_partkey) OVER (PARTITION BY p_name) AS keep_id FROM part), d AS (SELECT *, chr(39) AS q FROM m WHERE item_id <> keep_id)
SELECT keep_id, item_id, 0 AS step, 'UPDATE snapshots SET item_id = ' || q || keep_id || q || ' WHERE item_id = ' || q || item_id || q || ';' AS statement FROM d
UNION ALL SELECT keep_id, item_id, 1, 'UPDATE aliases SET item_id = ' || q || keep_id || q || ' WHERE item_id = ' || q || item_id || q || ';' FROM d
UNION ALL SELECT keep_id, item_id, 2, 'UPDATE listings SET item_id = ' || q || keep_id || q || ' WHERE item_id = ' || q || item_id || q || ';' FROM d
UNION ALL SELECT keep_id, item_id, 3, 'DELETE FROM items WHERE id = ' || q || item_id || q || ';' FROM d""")
def repair_plan(spark, sf):
    pairs = M.survivors(catalogue(spark, sf).select("item_id", "name"), ["name"]).filter("item_id <> keep_id")
    return sinks.repair_plan(pairs)


@query("""WITH r AS (SELECT l_partkey AS item_id, CAST(sum(l_extendedprice) AS DOUBLE) / count(*) / 20 AS ref FROM (SELECT l_partkey, CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice FROM lineitem) GROUP BY l_partkey), p AS (SELECT p_partkey AS item_id, CAST(CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS DOUBLE) AS l FROM part),
x AS (SELECT item_id, ref, l, coalesce(l > 0 AND (ref > l * 1.4::DOUBLE OR ref < l * 0.5::DOUBLE), false) AS clamped FROM r LEFT JOIN p USING (item_id)) SELECT item_id, round(CASE WHEN clamped THEN l ELSE ref END, 6) AS reference_price, clamped FROM x""")
def clamp_reference(spark, sf):
    mean = F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / F.count("*") / 20
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(mean.alias("reference_price"))
    items = catalogue(spark, sf).withColumn("list_price", F.when(F.col("item_id") % 7 == 0, 0).otherwise(F.col("list_price")).cast("decimal(10,2)"))
    return sinks.clamp_reference(refs, items).withColumn("reference_price", F.round("reference_price", 6))


@query("""WITH t AS (SELECT event_id AS listing_id, row_number() OVER (ORDER BY event_id) AS place, CAST(value AS DECIMAL(10,2)) AS price FROM events WHERE event_id % 3 = 0), c AS (SELECT event_id AS listing_id, CAST(value + event_id % 2 AS DECIMAL(10,2)) AS price FROM events WHERE event_id % 4 <> 0)
SELECT t.listing_id, place, coalesce(c.price, t.price) AS price, coalesce(c.price <> t.price, false) AS synced FROM t LEFT JOIN c USING (listing_id)""")
def sync_prices(spark, sf):
    e = table(spark, sf, "events")
    rank = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("listing_id"), F.col("value").cast("decimal(10,2)").alias("price"))
    top = rank.withColumn("place", F.row_number().over(Window.orderBy("listing_id")).cast("bigint"))  # a top list is small
    return sinks.sync_prices(top, e.filter("event_id % 4 <> 0").select(F.col("event_id").alias("listing_id"), (F.col("value") + F.col("event_id") % 2).cast("decimal(10,2)").alias("price")))


@query("""SELECT l_suppkey AS store_id, count(*) AS scraped, count(*) FILTER (l_linenumber < 3) AS matched, count(*) FILTER (l_quantity > 48) AS inserted, count(*) FILTER (l_discount >= 0.1) AS errors,
CASE WHEN count(*) FILTER (l_discount >= 0.1) > 0 AND count(*) FILTER (l_quantity > 48) = 0 THEN 'error' WHEN count(*) FILTER (l_discount >= 0.1) > 0 THEN 'partial' ELSE 'success' END AS status FROM lineitem GROUP BY l_suppkey""")
def run_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "store_id")
    return sinks.run_metrics(rows, ["store_id"], F.col("l_linenumber") < 3, F.col("l_quantity") > 48, F.col("l_discount") >= 0.1)


MAPPED = "m AS (SELECT p_partkey AS item_id, min(p_partkey) OVER (PARTITION BY p_name) AS keep_id FROM part)"


def _rekeyed(spark, sf):
    items = catalogue(spark, sf)
    mapping = M.survivors(items.select("item_id", "name"), ["name"]).filter("item_id <> keep_id").select("item_id", "keep_id")
    lines = table(spark, sf, "lineitem")
    snapshots = lines.select(F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), (F.col("l_linestatus") == "O").alias("available"))
    aliases = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alias_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("store_id"), F.col("l_returnflag").alias("alias"))
    candidates = items.select(F.col("item_id"), F.col("name").alias("title"))
    return sinks.rekey_all(snapshots, aliases, candidates, items.select("item_id", "list_price"), mapping)


@query(f"""WITH {MAPPED} SELECT keep_id AS item_id, l_suppkey AS store_id, l_returnflag AS alias, arg_min(alias_id, row_no) AS alias_id FROM (SELECT m.keep_id, l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS alias_id,
  row_number() OVER (PARTITION BY m.keep_id, l_suppkey, l_returnflag ORDER BY m.keep_id <> m.item_id, l_orderkey * 10 + l_linenumber) AS row_no FROM lineitem JOIN m ON m.item_id = l_partkey) GROUP BY ALL""")
def rekey_aliases(spark, sf):
    return _rekeyed(spark, sf)["aliases"]


@query(f"""WITH {MAPPED}, s AS (SELECT keep_id AS item_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS mean FROM lineitem JOIN m ON m.item_id = l_partkey WHERE l_linestatus = 'O' GROUP BY keep_id),
k AS (SELECT keep_id AS item_id, count(*) AS n FROM m GROUP BY keep_id)
SELECT k.item_id, CAST(CASE WHEN n > 1 AND mean IS NOT NULL THEN floor(mean * 100 + 0.5) / 100 ELSE p_retailprice END AS DECIMAL(10,2)) AS list_price FROM k JOIN part ON p_partkey = k.item_id LEFT JOIN s USING (item_id)""")
def rekey_items(spark, sf):
    return _rekeyed(spark, sf)["items"]
