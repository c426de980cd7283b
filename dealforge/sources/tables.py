"""The driver's tables, and views of them as a catalogue, price observations and listings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 11, 4)
NOW = datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, brand, name, line, variant, model, year (null for every tenth), list_price."""
    words = F.split("p_name", " ")
    year = F.when(F.col("p_partkey") % 10 != 0, (2018 + F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), words[1].alias("line"), words[0].alias("variant"), F.col("p_type").alias("model"), year.alias("year"), F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each price that a store showed for an item."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    seen = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    url = F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/p-"), F.col("l_partkey") % 1000, F.lit("-"), F.col("l_linenumber") % 3)
    confidence = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.95).otherwise(0.9).cast("decimal(3,2)")
    return seen.select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("store_id"),
        (F.col("p_retailprice") * (50 + F.col("l_quantity")) / 75).cast("decimal(18,4)").alias("price"),
        F.col("l_discount").cast("decimal(6,4)").alias("pct"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        confidence.alias("confidence"),
        (F.col("l_linestatus") == "O").alias("available"),
        url.alias("url"),
        (F.col("l_shipdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).alias("seen_at"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each second-hand advertisement."""
    items = catalogue(spark, sf_dir).filter("item_id < 200").select("item_id", "name", "model", "year")
    title = F.concat_ws(" ", "name", "model", F.col("year").cast("string"))
    rows = table(spark, sf_dir, "events").withColumn("item_id", F.col("event_id") % 200)
    condition = F.when(F.col("event_type") == "view", "new").when(F.col("event_type") == "click", "as_good_as_new").when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "signup", "fair")
    likes = F.get_json_object("props", "$.k").try_cast("int") % 21
    return rows.join(items, "item_id", "left").select(F.col("event_id").alias("listing_id"), "item_id", title.alias("title"), F.col("value").cast("decimal(10,2)").alias("price"), condition.alias("condition"), F.col("user_id").alias("seller"), "ts", likes.alias("likes"), F.col("event_type").alias("platform"), F.when(F.col("event_id") % 3 != 0, F.concat_ws(" ", "name", F.col("year").cast("string"))).alias("product"))


#: The same views in SQL, as common table expressions.
CATALOGUE_SQL = """cat AS (SELECT p_partkey AS item_id, p_brand AS brand, p_name AS name, split_part(p_name, ' ', 2) AS line, split_part(p_name, ' ', 1) AS variant, p_type AS model,
  CAST(CASE WHEN p_partkey % 10 <> 0 THEN 2018 + p_partkey % 9 END AS INTEGER) AS year, CAST(p_retailprice AS DECIMAL(10,2)) AS list_price FROM part)"""
OBSERVATIONS_SQL = """obs AS (SELECT l_partkey AS item_id, l_suppkey AS store_id, CAST(p_retailprice * (50 + l_quantity) / 75 AS DECIMAL(18,4)) AS price, CAST(l_discount AS DECIMAL(6,4)) AS pct,
  CAST(l_shipdate AS DATE) AS day, l_orderkey AS order_key, l_linenumber AS line_number, CAST(CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.95 ELSE 0.9 END AS DECIMAL(3,2)) AS confidence,
  l_linestatus = 'O' AS available, 'https://s' || l_suppkey || '.example/p-' || (l_partkey % 1000) || '-' || (l_linenumber % 3) AS url,
  CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS seen_at FROM lineitem JOIN part ON p_partkey = l_partkey)"""
LISTINGS_SQL = CATALOGUE_SQL + """, lst AS (SELECT event_id AS listing_id, event_id % 200 AS item_id, concat_ws(' ', c.name, c.model, CAST(c.year AS VARCHAR)) AS title, CAST(value AS DECIMAL(10,2)) AS price,
  CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'as_good_as_new' WHEN 'purchase' THEN 'good' WHEN 'signup' THEN 'fair' END AS condition, user_id AS seller, ts,
  CAST(json_extract_string(props, '$.k') AS INTEGER) % 21 AS likes, event_type AS platform, CASE WHEN event_id % 3 <> 0 THEN concat_ws(' ', c.name, CAST(c.year AS VARCHAR)) END AS product FROM events LEFT JOIN (SELECT * FROM cat WHERE item_id < 200) c ON c.item_id = event_id % 200)"""
