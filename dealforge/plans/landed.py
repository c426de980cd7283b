"""Queries of the store adapters: pages are laid out from the part table, parsed back, and held against its rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from dealforge.sources import landed as L
from dealforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
NOW = datetime(2026, 6, 15)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def parts(spark, sf):
    """k, store, page, price and old price as texts; every fifth is under the floor, every fourth has an old price."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), F.col("p_name").alias("name"), (k % 3).cast("string").alias("store"), F.floor(k / 30).cast("int").alias("page"), F.when(k % 5 == 0, k % 30).otherwise(40 + k % 200).cast("decimal(12,2)").alias("price"))
    return p.withColumn("old", F.when(F.col("k") % 4 == 0, F.col("price") + 20).when(F.col("k") % 4 == 1, F.col("price") - 5).cast("decimal(12,2)"))


PARTS = """p0 AS (SELECT p_partkey AS k, p_name AS name, CAST(p_partkey % 3 AS VARCHAR) AS store, CAST(p_partkey // 30 AS INTEGER) AS page, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 30 ELSE 40 + p_partkey % 200 END AS DECIMAL(12,2)) AS price FROM part),
p AS (SELECT *, CAST(CASE WHEN k % 4 = 0 THEN price + 20 WHEN k % 4 = 1 THEN price - 5 END AS DECIMAL(12,2)) AS old FROM p0)"""
OFFER = "store, name AS title, price, CASE WHEN old > price THEN old END AS list_price"


def pages(rows, entry, shell=lambda body: body, json: bool = False):
    """(store, page, body): entries of a store's page in order of k."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"])
    return rows.groupBy("store", "page").agg(each.alias("es")).select("store", "page", shell(F.to_json("es") if json else F.array_join("es", "")).alias("body"))


def js(rows, **fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _shop(rows):
    money = lambda c: F.col(c).cast("string")
    variants = F.array(F.struct(F.lit("1.00").alias("price"), F.lit(None).cast("string").alias("compare_at_price"), F.lit(False).alias("available"), F.lit("x").alias("sku")), F.struct(money("price").alias("price"), money("old").alias("compare_at_price"), F.lit(True).alias("available"), F.concat(F.lit("s"), "k").alias("sku")))
    kind = F.when(F.col("k") % 7 == 0, "Balls").otherwise("Palas")
    return F.struct(F.col("name").alias("title"), F.concat(F.lit("h"), "k").alias("handle"), kind.alias("product_type"), F.struct(F.concat(F.lit("//cdn/"), "k", F.lit(".jpg")).alias("src")).alias("image"), variants.alias("variants"))


@query(f"WITH {PARTS} SELECT {OFFER}, 'https://s' || store || '/products/h' || k AS url, 'https://cdn/' || k || '.jpg' AS image, 's' || k AS sku, true AS available FROM p WHERE price >= 30 AND k % 7 <> 0")
def shop_products(spark, sf):
    body = pages(parts(spark, sf), _shop(None), lambda b: F.concat(F.lit('{"products":'), b, F.lit("}")), json=True)
    return L.shop_products(body, F.concat(F.lit("https://s"), "store"), "Palas")


@query(f"WITH {PARTS}, n AS (SELECT store, page, count(*) AS n FROM p GROUP BY ALL) SELECT store, min(page) AS last FROM n WHERE n < 10 GROUP BY store")
def short_page(spark, sf):
    body = pages(parts(spark, sf), _shop(None), lambda b: F.concat(F.lit('{"products":'), b, F.lit("}")), json=True)
    return L.short_page(body, "$.products", 10)


@query(f"""WITH {PARTS}, f AS (SELECT *, CASE WHEN k % 2 = 0 THEN price - 7 END AS fresh FROM p WHERE price >= 30)
SELECT {OFFER.replace('price, CASE WHEN old > price THEN old END', "CASE WHEN fresh >= 30 THEN CAST(fresh AS DECIMAL(12,2)) ELSE price END AS price, CASE WHEN fresh >= 30 THEN CASE WHEN old > fresh THEN old END WHEN old > price THEN old END")}, 'https://s' || store || '/products/h' || k AS url, k % 2 <> 0 AS available FROM f WHERE k % 7 <> 0""")
def refreshed_prices(spark, sf):
    """The page of every second product has another price, and says that it is sold out."""
    rows = parts(spark, sf)
    v = F.array(F.struct((F.col("price") - 7).cast("string").alias("price"), F.col("old").cast("string").alias("compare_at_price"), F.lit(False).alias("available")))
    details = rows.filter("k % 2 = 0").select(F.concat(F.lit("https://s"), "store", F.lit("/products/h"), "k").alias("url"), F.to_json(F.struct(F.struct(F.col("name").alias("title"), v.alias("variants")).alias("product"))).alias("body"))
    return L.refreshed(shop_products(spark, sf), details).drop("image", "sku")


@query(f"WITH {PARTS}, q AS (SELECT k, name, store, CASE WHEN k % 4 = 1 THEN old ELSE price END AS price, CASE WHEN k % 4 = 0 THEN old WHEN k % 4 = 1 THEN price END AS old FROM p) SELECT {OFFER}, 'https://w/' || k AS url, 'https://w/' || k || '.png' AS image, 's' || k AS sku, k % 6 <> 0 AS available FROM q WHERE price >= 30")
def store_api_products(spark, sf):
    """The sale price is the old one of every fourth; with none, the regular price counts."""
    minor = lambda c: (c * 100).cast("bigint").cast("string")
    k, price, old = F.col("k"), F.col("price"), F.col("old")
    prices = F.struct(F.when(k % 4 == 1, minor(old)).when(k % 4 == 0, minor(price)).otherwise("").alias("sale_price"), F.when(k % 4 == 0, minor(old)).otherwise(minor(price)).alias("regular_price"), F.lit(2).alias("currency_minor_unit"))
    entry = F.struct(F.col("name"), F.concat(F.lit("https://w/"), k).alias("permalink"), F.concat(F.lit("s"), k).alias("sku"), (k % 6 != 0).alias("is_in_stock"), F.array(F.struct(F.concat(F.lit("https://w/"), k, F.lit(".png")).alias("src"))).alias("images"), prices.alias("prices"))
    return L.store_api_products(pages(parts(spark, sf), entry, json=True))


def _euro(c):
    return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))


def _card():
    k = F.col("k")
    old = F.when(F.col("old").isNotNull(), F.concat(F.lit('<span class="regular-price">'), _euro("old"), F.lit(" €</span>"))).otherwise("")
    flag = F.when(k % 6 == 0, F.lit('<li class="product-flag">Agotado</li>')).otherwise("")
    return F.concat(F.lit('<article class="js product-miniature"><h2 class="product-title"><a href="https://c/'), k, F.lit('" title="'), F.col("name"), F.lit(' &amp; co">'), F.col("name"), F.lit('</a></h2><img data-src="https://c/'), k, F.lit('.jpg?x=1" src="data:a"><span class="price">'), _euro("price"), F.lit(" €</span>"), old, flag, F.lit("</article>"))


@query(f"WITH {PARTS} SELECT {OFFER.replace('name AS', chr(110) + 'ame || ' + chr(39) + ' & co' + chr(39) + ' AS')}, 'https://c/' || k AS url, 'https://c/' || k || '.jpg' AS image, CAST(NULL AS VARCHAR) AS sku, k % 6 <> 0 AS available FROM p WHERE price >= 30")
def card_offers(spark, sf):
    return L.card_offers(pages(parts(spark, sf), _card(), lambda b: F.concat(F.lit("<body>"), b, F.lit("</body>"))))


@query(f"WITH {PARTS}, n AS (SELECT store, page, count(*) AS n FROM p GROUP BY ALL) SELECT store, page, CAST(n AS INTEGER) AS last FROM n")
def pager_pages(spark, sf):
    """The greatest page number among links."""
    entry = F.concat(F.lit('<a href="?page='), F.col("k") - F.col("page") * 30 - F.col("k") % 3, F.lit('">'))
    rows = parts(spark, sf).withColumn("n", F.col("k"))
    n = rows.groupBy("store", "page").agg(F.count("*").alias("c"))
    body = n.select("store", "page", F.array_join(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.concat(F.lit('<a href="/x?page='), i, F.lit('">'), i, F.lit("</a>"))), " ").alias("body"))
    return body.select("store", "page", L.pager_last(F.col("body")).alias("last"))


@query(f"WITH {PARTS} SELECT store, name AS title, price, CAST(NULL AS DECIMAL(12,2)) AS list_price, 'https://f/' || k AS url, CAST(NULL AS VARCHAR) AS image, CAST(NULL AS VARCHAR) AS sku, true AS available FROM p WHERE price BETWEEN 20 AND 2000")
def facet_offers(spark, sf):
    card = F.concat(F.lit('<div class="col-md-pala"><a href="https://f/'), "k", F.lit('"><div class="text-title-price"><p>'), "name", F.lit('</p><span class="color-blue">'), _euro("price"), F.lit("</span></div></a></div>"))
    return L.facet_offers(pages(parts(spark, sf), card, lambda b: F.to_json(F.struct(b.alias("template")))))


@query(f"WITH {PARTS}, q AS (SELECT k, name, store, list_sort(list_filter([price, old], lambda x: x BETWEEN 40 AND 2000)) AS ps FROM p) SELECT store, name AS title, ps[1] AS price, CASE WHEN ps[-1] > ps[1] THEN ps[-1] END AS list_price, 'https://s/products/' || k AS url, 'https://cdn.x/' || k || '.webp' AS image, CAST(NULL AS VARCHAR) AS sku, k % 6 <> 0 AS available FROM q WHERE len(ps) > 0")
def section_offers(spark, sf):
    k = F.col("k")
    old = F.when(F.col("old").isNotNull(), F.concat(F.lit("<s>"), _euro("old"), F.lit("€</s>"))).otherwise("")
    card = F.concat(F.lit('<product-card data-hover-title="'), "name", F.lit('"><a href="/products/'), k, F.lit('?v=1"><img src="//cdn.x/'), k, F.lit('.webp">'), _euro("price"), F.lit("€"), old, F.when(k % 6 == 0, "Sold out").otherwise(""), F.lit("</product-card>"))
    return L.section_offers(pages(parts(spark, sf), card), F.lit("https://s"))


@query(f"WITH {PARTS}, q AS (SELECT k, name, store, CASE WHEN k % 3 = 0 THEN price ELSE least(price, coalesce(old, price)) END AS price, CASE WHEN k % 3 = 0 THEN old ELSE greatest(price, coalesce(old, price)) END AS old FROM p) SELECT {OFFER}, 'https://o/' || k AS url, 'https://o/' || k || '.jpg' AS image, CAST(NULL AS VARCHAR) AS sku, true AS available FROM q WHERE price >= 30")
def thumb_offers(spark, sf):
    """Every third has price-new and price-old; the others one or two prices in one element."""
    k = F.col("k")
    euro = lambda c: F.concat(_euro(c), F.lit(" €"))
    two = F.concat(F.lit('<p class="price-new">'), euro("price"), F.lit("</p>"), F.when(F.col("old").isNotNull(), F.concat(F.lit('<p class="price-old">'), euro("old"), F.lit("</p>"))).otherwise(""))
    one = F.concat(F.lit('<p class="price">'), euro("price"), F.when(F.col("old").isNotNull(), F.concat(F.lit(" "), euro("old"))).otherwise(""), F.lit("</p>"))
    card = F.concat(F.lit('<div class="product-thumb x"><img src="https://o/'), k, F.lit('.jpg?w=2"><h4 class="name"><a class="y" href="https://o/'), k, F.lit('"><b>'), "name", F.lit("</b></a></h4>"), F.when(k % 3 == 0, two).otherwise(one), F.lit("</div>"))
    return L.thumb_offers(pages(parts(spark, sf), card), with_tax=False)


@query(f"WITH {PARTS} SELECT {OFFER}, 'https://h/' || k AS url, 'i' || k AS image, CAST(NULL AS VARCHAR) AS sku, true AS available, CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 15 END AS coupon_pct, CASE k % 4 WHEN 0 THEN 'CART' || k WHEN 1 THEN 'CUPON_PRODUCTO' END AS coupon FROM p WHERE price >= 30 AND k % 6 <> 0 AND NOT contains(name, 'ring')")
def hit_offers(spark, sf):
    """Pages with a cart coupon, an optional one, a late one, and none."""
    k = F.col("k")
    rows = parts(spark, sf)
    entry = F.struct(F.col("name"), F.concat(F.lit("https://h/"), k).alias("url"), F.concat(F.lit("i"), k).alias("image"), F.col("price").cast("double").alias("price"), F.col("old").cast("double").alias("list_price"), F.array((k % 6).cast("int"), F.lit(9)).alias("categories"))
    entry = F.struct(*[entry[c].alias(c) for c in ("name", "url", "image", "price", "list_price")], F.when(k % 6 == 0, F.array(F.lit(9))).otherwise(F.array(F.lit(5), F.lit(9))).alias("categories"))
    body = pages(rows, entry, lambda b: F.concat(F.lit('{"products":'), b, F.lit("}")), json=True)
    cart = F.concat(F.lit('<div class="coupon_flag cart"><span class="ttl">Cup&oacute;n Extra 10 %</span></div><i class="code_coupon_text">CART'), k, F.lit("</i>"))
    html = F.when(k % 4 == 0, cart).when(k % 4 == 1, "Aplicar 15 % cup&oacute;n de descuento <b>V&aacute;lido hasta el 20 de julio de 2026</b>").when(k % 4 == 2, "Aplicar 15% cupón de descuento <b>Válido hasta el 1 de junio de 2026</b>").otherwise("nothing")
    return L.hit_offers(body, rows.select(F.concat(F.lit("https://h/"), k).alias("url"), html.alias("body")), 5, NOW, "ring")


@query("""SELECT CAST(p_partkey // 30 AS INTEGER) AS page, p_partkey // 30 < 2 AS more, 's' || p_partkey AS slug, p_name AS name, p_brand AS brand, p_type AS model, CAST(2020 + p_partkey % 5 AS INTEGER) AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Redonda' END AS shape, CAST(340 + p_partkey % 20 AS INTEGER) AS low_weight,
CASE WHEN p_partkey % 3 <> 0 THEN CAST(365 + p_partkey % 10 AS INTEGER) END AS high_weight, CAST(p_partkey % 10 AS DOUBLE) AS rating, CAST(p_partkey % 7 AS DOUBLE) AS power, CASE WHEN p_partkey % 4 = 0 THEN CAST(8 AS DOUBLE) END AS control, CAST(NULL AS DOUBLE) AS rebound, CAST(NULL AS DOUBLE) AS handling, CAST(NULL AS DOUBLE) AS sweet_spot,
CASE WHEN p_partkey % 5 = 0 THEN 'carbon' END AS faces, CAST(NULL AS VARCHAR) AS core, 'tube' AS frame, CAST(p_partkey % 300 AS DECIMAL(12,2)) AS list_price, CASE WHEN p_partkey % 2 = 0 THEN ['a', 'b'] ELSE [] END AS players FROM part""")
def rest_catalogue(spark, sf):
    k = F.col("p_partkey")
    maps = lambda **m: F.map_filter(F.create_map(*[x for n, c in m.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    weight = F.when(k % 3 != 0, F.array((340 + k % 20).cast("int"), (365 + k % 10).cast("int"))).otherwise(F.array((340 + k % 20).cast("int")))
    r = F.struct(
        F.concat(F.lit("s"), k).alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), (2020 + k % 5).alias("season"), F.when(k % 2 == 0, "Redonda").alias("shape"), weight.alias("weight"), (k % 10).cast("string").alias("rating"),
        maps(power=(k % 7).cast("double"), control=F.when(k % 4 == 0, 8.0)).alias("ratings"), maps(faces=F.when(k % 5 == 0, "carbon"), frame=F.lit("tube")).alias("materials"), (k % 300).cast("double").alias("pvp"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("players"),
    )
    rows = table(spark, sf, "part").groupBy(F.floor(k / 30).cast("int").alias("page")).agg(F.collect_list(r).alias("rackets"))
    body = F.to_json(F.struct(F.struct("rackets", F.struct((F.col("page") < 2).alias("hasMore")).alias("pagination")).alias("data")))
    return L.catalogue_rows(rows.select("page", body.alias("body")))


@query("""SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 'Redonda' WHEN 1 THEN 'Diamante' WHEN 2 THEN 'Hybrid' END AS shape, CASE WHEN p_partkey % 2 = 0 THEN 'Alto' ELSE 'x' END AS balance, CASE WHEN p_partkey % 3 = 0 THEN 350 ELSE 350 + p_partkey % 9 END AS low_weight, CASE WHEN p_partkey % 3 = 0 THEN 370 ELSE 370 + p_partkey % 9 END AS high_weight,
CASE WHEN p_partkey % 5 <> 0 THEN 'Carbon ' || p_partkey END AS face, 'EVA & soft' AS core, CAST(NULL AS VARCHAR) AS frame FROM part""")
def spec_pages(spark, sf):
    """Shape in a table, balance and weight in a list, face and core in attribute items; a dash is no value."""
    k = F.col("p_partkey")
    shape = F.when(k % 4 == 0, "Redonda (control)").when(k % 4 == 1, "diamante").when(k % 4 == 2, "Hybrid").otherwise("-")
    weight = F.when(k % 3 == 0, "360 gr").otherwise(F.concat_ws("-", (350 + k % 9).cast("string"), F.concat((370 + k % 9).cast("string"), F.lit("g"))))
    html = F.concat(F.lit("<table><tr><th>Forma</th><td> "), shape, F.lit("</td></tr></table><dl><dt>Balance</dt><dd>"), F.when(k % 2 == 0, "muy ALTO").otherwise("x"), F.lit("</dd><dt>Peso</dt><dd>"), weight, F.lit('</dd></dl><div class="woocommerce-product-attributes-item"><span class="woocommerce-product-attributes-item__label">Cara</span><span class="woocommerce-product-attributes-item__value"><p>'))
    html = F.concat(html, F.when(k % 5 == 0, "-").otherwise(F.concat(F.lit("Carbon "), k)), F.lit('</p></span></div><div><span class="woocommerce-product-attributes-item__label">Núcleo</span><span class="woocommerce-product-attributes-item__value">EVA &amp; soft</span></div>'))
    return L.spec_fields(table(spark, sf, "part").select(k.alias("item_id"), html.alias("body")), ["item_id"])


@query("WITH k AS (SELECT event_type, max(struct_pack(ts := ts, event_id := event_id)) AS last FROM events WHERE event_id % 97 = 5 GROUP BY event_type) SELECT event_id FROM events LEFT JOIN k USING (event_type) WHERE last IS NULL OR struct_pack(ts := ts, event_id := event_id) > last")
def until_known(spark, sf):
    e = table(spark, sf, "events")
    return L.until_known(e, e.filter("event_id % 97 = 5"), "event_id", "event_type", "ts").select("event_id")
