"""Queries of the text, HTML, URL and price functions, beside their SQL where RE2 can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '{X.MARKED}', '{X.PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("digest"))


@query(f"SELECT item_id, len(list_filter(string_split({norm('text')}, ' '), lambda t: t <> '')) AS n FROM benchmark")
def tokenize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n"))


@query("SELECT p_partkey AS item_id, lower(split_part(p_name, ' ', 1)) || '|' || lower(p_type) AS tokens FROM part")
def tokenize_model(spark, sf):
    words = X.model_tokens(F.concat_ws(" ", F.split("p_name", " ")[0], F.lit("Edition"), "p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.array_join(words, "|").alias("tokens"))


@query("SELECT p_partkey AS item_id, array_to_string(list_sort(list_distinct([lower(p_type), lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))])), '|') AS signature FROM part")
def signature(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), X.signature(F.concat_ws(" ", "p_type", F.lit("2024")), F.col("p_name"), F.lit(2024)).alias("signature"))


@query("SELECT p_partkey AS item_id, replace(lower(p_name), ' ', '-') || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS r FROM part)")
def slugify(spark, sf):
    """Slugs, with -2, -3 where one repeats."""
    from pyspark.sql import Window

    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), X.slugify(F.col("p_name")).alias("s"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("item_id")))
    return rows.select("item_id", F.when(F.col("r") > 1, F.concat_ws("-", "s", "r")).otherwise(F.col("s")).alias("slug"))


@query("SELECT p_partkey AS item_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2018 + p_partkey % 9 WHEN p_partkey % 3 = 1 THEN 2020 + p_partkey % 10 END AS INTEGER) AS year FROM part")
def extract_year(spark, sf):
    k = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", F.when(k % 3 == 0, (2018 + k % 9).cast("string")).when(k % 3 == 1, (20 + k % 10).cast("string")).otherwise(F.lit("v7")))
    return table(spark, sf, "part").select(k.alias("item_id"), X.extract_year(title).alias("year"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS digest FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(X.html_text(F.col("html")), 256).alias("digest"))


@query("SELECT p_partkey AS item_id, p_name || ' & <' || p_size || '> é –' AS title FROM part")
def html_decode(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit(" &amp; &lt;"), F.col("p_size"), F.lit("&gt; &#233; &#x2013;"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), X.html_decode(raw).alias("title"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '#.*$', ''), '/+$', '') AS url FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_normalize(F.col("url")).alias("url"))


@query("SELECT DISTINCT regexp_replace(regexp_replace(lower(u), '#.*$', ''), '/+$', '') AS link FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS u FROM pages) WHERE starts_with(u, '/')")
def sale_links(spark, sf):
    """Distinct normalised links of the page's own site."""
    links = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("u"))
    return links.filter(F.col("u").startswith("/")).select(X.url_normalize(F.col("u")).alias("link")).distinct()


@query("SELECT p_partkey AS item_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2020 + p_partkey % 10 END AS INTEGER) AS year, CASE WHEN p_partkey % 2 = 1 THEN '0' || (1 + p_partkey % 9) ELSE '' END AS generation FROM part")
def url_signals(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 2 == 0, F.concat(F.lit("-"), (20 + k % 10).cast("string"), F.lit("-113768-p"))).otherwise(F.concat(F.lit("-0"), (1 + k % 9).cast("string"), F.lit("/")))
    url = F.concat(F.lit("https://shop.example/p/"), X.slugify(F.col("p_name")), tail)
    return table(spark, sf, "part").select(k.alias("item_id"), X.url_year(url).alias("year"), F.array_join(X.url_generations(url), ",").alias("generation"))


@query("SELECT p_partkey AS item_id, p_brand || ' ' || p_name || ' ' || p_type AS name FROM part")
def canonical_name(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type", F.lit(None).cast("string")).alias("name"))


@query("SELECT p_partkey AS item_id, CAST(p_retailprice AS DECIMAL(10,2)) + 1000 AS price FROM part")
def parse_price(spark, sf):
    cents = (F.col("p_retailprice").cast("decimal(10,2)") + 1000).cast("string")
    text = F.concat(F.substring(cents, 1, 1), F.lit("."), F.replace(F.substring(cents, 2, 9), F.lit("."), F.lit(",")), F.lit(" €"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), X.parse_price(text).cast("decimal(13,2)").alias("price"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey * 7 / 100.0 AS DECIMAL(12,2)) AS price FROM orders")
def minor_units(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.minor_units((F.col("o_orderkey") * 7).cast("decimal(18,0)")).alias("price"))


@query("""WITH g AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS net, CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.21 AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS gross FROM part)
SELECT p_partkey AS item_id, CASE WHEN CAST(gross * 100 AS BIGINT) % 100 >= 90 OR CAST(gross * 100 AS BIGINT) % 100 <= 5 OR CAST(gross * 100 AS BIGINT) % 100 = 50 THEN gross ELSE net END AS price FROM g""")
def vat_heuristic(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), X.vat_heuristic(F.col("p_retailprice").cast("decimal(12,2)")).alias("price"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def epoch_to_day(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.to_date(F.timestamp_seconds(seconds)).alias("day"))


@query("SELECT p_partkey AS item_id, CAST(300 + p_size - CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END AS INTEGER) AS low, CAST(300 + p_size + 10 AS INTEGER) AS high FROM part")
def weight_range(spark, sf):
    size = F.col("p_size")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(300 + size, F.lit(" g"))).otherwise(F.concat(F.lit("de "), 300 + size, F.lit(" a "), 310 + size, F.lit(" gr, 12345")))
    low, high = X.weight_range(text)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), low.alias("low"), high.alias("high"))


@query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.price'), json_extract_string(props, '$.k')) AS INTEGER) AS found FROM events")
def json_coalesce(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.price"), F.get_json_object("props", "$.k")).try_cast("int").alias("found"))


@query("SELECT event_id, CASE WHEN m < 60 THEN 'hace ' || m || ' min' WHEN m < 1440 THEN 'hace ' || (m // 60) || ' h' ELSE 'hace ' || (m // 1440) || ' d' END AS age FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 60000000) AS BIGINT) AS m FROM events)")
def relative_age(spark, sf):
    from dealforge.sources.tables import NOW

    m = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000)
    age = F.when(m < 60, F.concat(F.lit("hace "), m, F.lit(" min"))).when(m < 1440, F.concat(F.lit("hace "), F.floor(m / 60), F.lit(" h"))).otherwise(F.concat(F.lit("hace "), F.floor(m / 1440), F.lit(" d")))
    return table(spark, sf, "events").select("event_id", age.alias("age"))
