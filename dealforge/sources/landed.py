"""Offers read from landed pages of stores: JSON bodies and HTML, one row a page.

A fetcher lands (store, page, body); these parse bodies inside code generation and give offers (store, title,
price, list_price, url, image, sku, available). Broken bodies give no rows. Of a store's offers with one
url the first page's is kept. Prices are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators.pricing import first_by
from dealforge.sources.markup import Element, parse

FLOOR = 30
MONEY = "decimal(12,2)"
# Words of a card that say it cannot be bought.
SOLD_OUT = r"(?i)agotado|sold.?out|sin\s+stock|no\s+disponible|fuera|out-of-stock"


def money(text: Column) -> Column:
    return text.try_cast(MONEY)


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _first(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])


def _https(image: Column) -> Column:
    return F.when(image.startswith("//"), F.concat(F.lit("https:"), image)).otherwise(image)


def _offers(rows: DataFrame, floor: float) -> DataFrame:
    """Rows with a title, url and price of `floor` at least; the list price only where it is higher."""
    rows = rows.filter(F.col("title").isNotNull() & F.col("url").isNotNull() & (F.col("price") >= floor))
    rows = rows.withColumn("list_price", F.when(F.col("list_price") > F.col("price"), F.col("list_price")))
    rows = first_by(rows, ["store", "url"], [F.asc("page"), F.asc("pos")])
    return rows.select("store", "title", "price", "list_price", "url", "image", "sku", "available")


SHOP_PRODUCT = "struct<title:string,handle:string,product_type:string,available:boolean,image:struct<src:string>,images:array<struct<src:string>>,variants:array<struct<price:string,compare_at_price:string,available:boolean,sku:string>>>"


def shop_products(pages: DataFrame, site: Column, kind: str | None = None, floor: float = FLOOR) -> DataFrame:
    """Of each product the first variant that is available, else the first."""
    body = F.from_json("body", f"products array<{SHOP_PRODUCT}>")
    rows = pages.select("store", "page", site.alias("site"), F.posexplode(body["products"]).alias("pos", "p"))
    rows = rows.filter(F.col("p.product_type") == kind) if kind else rows
    able = F.filter("p.variants", lambda v: F.coalesce(v["available"], F.lit(False)))
    rows = rows.withColumn("v", F.coalesce(F.get(able, 0), F.get("p.variants", 0))).filter("v is not null")
    return _offers(
        rows.select(
            "store", "page", "pos", F.col("p.title").alias("title"), money(F.col("v.price")).alias("price"), money(F.col("v.compare_at_price")).alias("list_price"),
            F.concat("site", F.lit("/products/"), F.col("p.handle")).alias("url"), _https(_first(F.col("p.image.src"), F.get("p.images", 0)["src"])).alias("image"), _first(F.col("v.sku")).alias("sku"), F.col("v.available").alias("available"),
        ),
        floor,
    )


def short_page(pages: DataFrame, path: str, limit: int) -> DataFrame:
    """(store, last): the first page with fewer than `limit` entries at a JSON array path, after which none is asked for."""
    n = F.coalesce(F.json_array_length(F.get_json_object("body", path)), F.lit(0))
    return pages.filter(n < limit).groupBy("store").agg(F.min("page").alias("last"))


def refreshed(listed: DataFrame, details: DataFrame, floor: float = FLOOR) -> DataFrame:
    """listed with price, list price and availability of the product's own page, where that was read
    (details: url, body); a fresh price under the floor changes neither price."""
    p = F.from_json("body", f"product {SHOP_PRODUCT}")["product"]
    v = F.get(p["variants"], 0)
    fresh = details.select("url", money(v["price"]).alias("_p"), money(v["compare_at_price"]).alias("_c"), F.coalesce(v["available"], p["available"]).alias("_a"), v.isNotNull().alias("_v")).filter("_v")
    rows = listed.join(fresh.groupBy("url").agg(*[F.first(c).alias(c) for c in ("_p", "_c", "_a")]), "url", "left")
    use = F.coalesce(F.col("_p") >= floor, F.lit(False))
    out = rows.withColumn("list_price", F.when(use, F.when(F.col("_c") > F.col("_p"), F.col("_c"))).otherwise(F.col("list_price")))
    return out.withColumn("price", F.when(use, F.col("_p")).otherwise(F.col("price"))).withColumn("available", F.coalesce("_a", "available")).select(*listed.columns)


def store_api_products(pages: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Prices in minor units; the sale price where it is positive, else the regular one."""
    kind = "array<struct<name:string,permalink:string,sku:string,is_in_stock:boolean,images:array<struct<src:string>>,prices:struct<sale_price:string,regular_price:string,currency_minor_unit:int>>>"
    rows = pages.select("store", "page", F.posexplode(F.from_json("body", kind)).alias("pos", "p"))
    unit = F.pow(F.lit(10), F.coalesce(F.col("p.prices.currency_minor_unit"), F.lit(2))).cast("decimal(10,0)")
    sale, regular = ((F.col(f"p.prices.{c}").try_cast("decimal(12,0)") / unit).cast(MONEY) for c in ("sale_price", "regular_price"))
    return _offers(
        rows.select(
            "store", "page", "pos", _first(F.col("p.name")).alias("title"), F.when(sale > 0, sale).otherwise(regular).alias("price"), regular.alias("list_price"),
            _first(F.col("p.permalink")).alias("url"), F.get("p.images", 0)["src"].alias("image"), _first(F.col("p.sku")).alias("sku"), F.coalesce(F.col("p.is_in_stock"), F.lit(True)).alias("available"),
        ),
        floor,
    )


def blocks(pages: DataFrame, mark: str, html: Column | None = None) -> DataFrame:
    """(store, page, pos, block): what follows each place of `mark`, a regular expression, up to the next one."""
    parts = F.split(F.col("body") if html is None else html, mark, -1)
    return pages.select("store", "page", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "block"))


def pager_last(html: Column, pattern: str = r"[?&/]page[=/]([0-9]+)") -> Column:
    """The greatest page number among a page's links; 1 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int"))), F.lit(1))


def _text(html: Column) -> Column:
    return X.html_decode(F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " ")))


# Where a card has what. The first element in the page's order counts.
CARD = ".js-product-miniature, article.product-miniature, .product-miniature"
CARD_TITLE = "h2.product-title a, h3.product-title a, .product-title a"
CARD_PRICE = '[itemprop="price"], span.price, .product-price, .price'
CARD_OLD = ".regular-price, .old-price, .product-price-old, del"
CARD_FLAGS = ".product-flag, .flag-product, .product-availability, .availability"
CARD_GONE = ("fuera", "agotado", "out-of-stock")
CARD_ROW = "store string, page bigint, pos bigint, title string, price_text string, old_text string, url string, image string, available boolean"


def _card(card: Element) -> tuple:
    """title, price and old price as texts, url, image, available; a title link is in the product's title, else the first with a title and no class."""
    link = card.first(CARD_TITLE) or next((a for a in card.find("a[title]") if not a.attrs.get("class")), None)
    text = lambda selector: e.text() if (e := card.first(selector)) else None
    picture = card.first("img")
    image = (picture.attrs.get("data-src") or picture.attrs.get("src") or "") if picture else ""
    flags = " ".join(e.text() for e in card.find(CARD_FLAGS)).lower()
    gone = any(w in flags for w in CARD_GONE) or "out-of-stock" in card.attrs.get("class", "").lower() or card.first('[class*="out-of-stock"]') is not None
    title = (link.attrs.get("title") or link.text()).strip() if link else None
    url = link.attrs.get("href", "") if link else ""
    return title or None, text(CARD_PRICE), text(CARD_OLD), url if url.startswith("http") else None, None if image.startswith("data:") else image.split("?")[0] or None, not gone


def card_offers(pages: DataFrame, cards: str = CARD, floor: float = FLOOR) -> DataFrame:
    """Cards with a title link, a price, perhaps an old price, an image and flags of their stock, read as elements (markup.py).

    A card within a card is none of its own. Cards without a title, a link to a page or a price are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for store, page, body in zip(*(c.to_pylist() for c in batch.columns)):
                found = parse(body).find(cards)
                inside = {id(x) for e in found for x in e.walk()}
                rows = [(store, page, n, *_card(e)) for n, e in enumerate(e for e in found if id(e) not in inside)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()])], names=["store", "page", "pos", "title", "price_text", "old_text", "url", "image", "available"])

    kind = dict(pages.dtypes)
    rows = pages.select(F.col("store").cast("string"), F.col("page").cast("bigint"), "body").mapInArrow(read, CARD_ROW)
    price = lambda c: X.parse_price(_group(F.col(c), r"([0-9.]+,[0-9]{2})")).cast(MONEY)
    return _offers(rows.select(F.col("store").cast(kind["store"]), "page", "pos", "title", price("price_text").alias("price"), price("old_text").alias("list_price"), "url", "image", F.lit(None).cast("string").alias("sku"), "available"), floor)


def facet_offers(pages: DataFrame, low: float = 20, high: float = 2000) -> DataFrame:
    """Cards in the HTML fragment at $.template of a JSON body: a link around a paragraph and a price."""
    b = F.col("block")
    url = F.nullif(_group(b, r'<a\b[^>]*?\bhref="([^"]+)"'), F.lit("#"))
    price = F.replace(F.trim(_group(b, r'class="[^"]*color-blue[^"]*"[^>]*>\s*([0-9]+(?:[.,][0-9]+)?)')), F.lit(","), F.lit(".")).try_cast(MONEY)
    rows = blocks(pages, r'class="[^"]*col-md-pala', F.get_json_object("body", "$.template"))
    empty = F.lit(None).cast("string")
    rows = rows.select("store", "page", "pos", _first(_text(F.regexp_extract(b, r"(?s)<p\b[^>]*>(.*?)</p>", 1))).alias("title"), price.alias("price"), F.lit(None).cast(MONEY).alias("list_price"), url.alias("url"), empty.alias("image"), empty.alias("sku"), F.lit(True).alias("available"))
    return _offers(rows.filter(F.col("price") <= high), low)


def section_offers(pages: DataFrame, site: Column, low: float = 40, high: float = 2000) -> DataFrame:
    """Section fragments: of all prices of a card within bounds the least is the price, the greatest the list price."""
    b = F.col("block")
    found = F.transform(F.regexp_extract_all(b, F.lit(r"([0-9]+[,.]?[0-9]*)\s*€"), F.lit(1)), lambda t: F.replace(F.regexp_replace(t, "[^0-9,]", ""), F.lit(","), F.lit(".")).try_cast(MONEY))
    prices = F.filter(found, lambda p: p.between(low, high))
    title = _first(F.replace(F.replace(F.regexp_extract(b, 'data-hover-title="([^"]+)"', 1), F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')))
    image = _https(_group(b, r"(?i)((?://|https://)cdn\.[^\"'\s]+\.(?:jpg|jpeg|png|webp)[^\"'\s]*)"))
    rows = blocks(pages, "<product-card").withColumn("prices", prices).filter(F.size("prices") > 0).join(pages.select("store", "page", site.alias("site")).distinct(), ["store", "page"])
    rows = rows.select("store", "page", "pos", title.alias("title"), F.array_min("prices").alias("price"), F.array_max("prices").alias("list_price"), F.concat("site", _group(b, r'href="(/products/[^"?]+)')).alias("url"), image.alias("image"), F.lit(None).cast("string").alias("sku"), (~b.rlike(r"(?i)agotado|sold.?out|sin\s+stock|no\s+disponible")).alias("available"))
    return _offers(rows, low)


def thumb_offers(pages: DataFrame, with_tax: bool = True, floor: float = FLOOR) -> DataFrame:
    """Thumbnail blocks: price-new and price-old, else the least and greatest price with a euro sign; tax
    is added where the sum then looks like a retail price."""
    b = F.col("block")
    name = r'(?s)class="[^"]*\bname\b[^"]*".{0,500}?<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    part = lambda c: _text(_group(b, rf'(?s)class="[^"]*{c}[^"]*"[^>]*>(.*?)</'))
    new, old = (X.parse_price(part(c)) for c in ("price-new", "price-old"))
    plain = F.filter(F.transform(F.regexp_extract_all(part(r"\bprice\b"), F.lit(r"([0-9.,]+)\s*€"), F.lit(1)), X.parse_price), lambda p: p > 0)
    tax = X.vat_heuristic if with_tax else (lambda p: p)
    image = _first(F.regexp_extract(b, r'data-src="([^"]+)"', 1), F.regexp_extract(b, r'<img[^>]+src="([^"]+)"', 1))
    rows = blocks(pages, r'class="product-thumb[^"]*"').withColumns({"net": F.coalesce(new, F.array_min(plain)), "was": F.when(new.isNotNull(), old).otherwise(F.array_max(plain))}).filter(F.col("net") >= floor)
    rows = rows.select(
        "store", "page", "pos", _first(_text(F.regexp_extract(b, name, 2))).alias("title"), tax(F.col("net")).cast(MONEY).alias("price"), F.when(F.col("was") > F.col("net"), tax(F.col("was"))).cast(MONEY).alias("list_price"),
        _group(b, name).alias("url"), F.when(~image.startswith("data:"), F.regexp_replace(image, r"\?.*$", "")).alias("image"), F.lit(None).cast("string").alias("sku"), F.lit(True).alias("available"),
    )
    return _offers(rows, floor)


# Months as product pages write them.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def page_coupon(html: Column, now: datetime) -> Column:
    """(pct, code) of a product page: the coupon of the cart, else the optional one unless it is past its day; null without."""
    cart = _group(html, r'(?is)coupon_flag\s+cart.{0,400}?ttl">Cup(?:&oacute;n|ón)\s+Extra\s+([0-9]{1,2})\s*%').try_cast("int")
    code = F.coalesce(F.trim(_group(html, r'(?i)code_coupon_text"[^>]*>([^<]+)<')), F.lit("CUPON_CARRITO"))
    opt = r"(?is)Aplicar\s+([0-9]{1,2})\s*%\s*cup(?:&oacute;n|ón)\s+de\s+descuento.{0,300}?V(?:&aacute;lido|álido)\s+hasta\s+el\s+([^<]{1,40})"
    until = F.lower(F.regexp_extract(html, opt, 2))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(until, "([a-z]{4,})", 1))
    day = F.try_make_timestamp_ntz(F.regexp_extract(until, "(20[0-9]{2})", 1).try_cast("int"), month.cast("int"), F.regexp_extract(until, r"\b([0-9]{1,2})\b", 1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    late = F.coalesce(day < F.lit(now).cast("timestamp_ntz"), F.lit(False))
    pct = _group(html, opt).try_cast("int")
    return F.when(cart.isNotNull(), F.struct(cart.alias("pct"), code.alias("code"))).when(pct.isNotNull() & ~late, F.struct(pct.alias("pct"), F.lit("CUPON_PRODUCTO").alias("code")))


# Fixed value: what the service puts behind a product's name.
HIT_TAIL = r"(?i)\s+Padel\s*-\s*.+$"


def hit_offers(pages: DataFrame, details: DataFrame, category: int, now: datetime, excluded: str, floor: float = FLOOR) -> DataFrame:
    """Products of a search service in a category, each with the coupon of its own page (details: url, body). The tail of a name goes."""
    kind = "struct<name:string,url:string,image:string,price:double,list_price:double,categories:array<int>>"
    rows = pages.select("store", "page", F.posexplode(F.from_json("body", f"products array<{kind}>")["products"]).alias("pos", "p"))
    rows = rows.filter(F.array_contains("p.categories", category) & ~F.lower("p.name").rlike(excluded))
    title = F.trim(F.regexp_replace("p.name", HIT_TAIL, ""))
    rows = rows.select("store", "page", "pos", title.alias("title"), F.col("p.price").cast(MONEY).alias("price"), F.col("p.list_price").cast(MONEY).alias("list_price"), F.col("p.url").alias("url"), F.col("p.image").alias("image"), F.lit(None).cast("string").alias("sku"), F.lit(True).alias("available"))
    coupons = details.select("url", page_coupon(F.col("body"), now).alias("c")).filter("c is not null").groupBy("url").agg(F.max("c").alias("c"))
    return _offers(rows, floor).join(coupons, "url", "left").select("store", "title", "price", "list_price", "url", "image", "sku", "available", F.col("c.pct").alias("coupon_pct"), F.col("c.code").alias("coupon"))


def catalogue_rows(pages: DataFrame) -> DataFrame:
    """A REST catalogue's rows, nested parts flattened: weight bounds, ratings, materials. `more` says whether a page names a next one."""
    kind = "struct<slug:string,title:string,brand:string,model:string,season:int,shape:string,weight:array<int>,rating:string,ratings:map<string,double>,materials:map<string,string>,pvp:double,players:array<string>>"
    body = F.from_json("body", f"data struct<rackets:array<{kind}>,pagination:struct<hasMore:boolean>>")["data"]
    rows = pages.select("page", F.coalesce(body["pagination"]["hasMore"], F.lit(False)).alias("more"), F.explode(body["rackets"]).alias("r"))
    at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return rows.select(
        "page", "more", "r.slug", F.col("r.title").alias("name"), "r.brand", "r.model", F.col("r.season").alias("year"), "r.shape", F.get("r.weight", 0).alias("low_weight"), F.get("r.weight", 1).alias("high_weight"), F.col("r.rating").try_cast("double").alias("rating"),
        *[at("r.ratings", k).alias(n) for k, n in (("power", "power"), ("control", "control"), ("rebound", "rebound"), ("maneuverability", "handling"), ("sweetSpot", "sweet_spot"))],
        *[at("r.materials", k).alias(k) for k in ("faces", "core", "frame")], F.col("r.pvp").cast(MONEY).alias("list_price"), F.coalesce("r.players", F.array().cast("array<string>")).alias("players"),
    )


# The names that pages give to one property.
SPEC_NAMES = {"shape": ["forma", "shape", "tipo"], "balance": ["balance", "equilibrio"], "weight": ["peso", "weight", "peso (gr)", "peso gr"], "face": ["cara", "superficie", "material cara", "golpeo"], "core": ["núcleo", "nucleo", "core", "interior", "alma"], "frame": ["marco", "frame", "perfil"]}


def spec_entries(html: Column) -> Column:
    """(k, v) of each property, from table rows, definition lists and attribute items of a page, in this order; of equal ones the last counts."""
    cell = r"<t[hd]\b[^>]*>(.*?)</t[hd]>"
    layouts = [rf"(?s)<tr\b[^>]*>\s*{cell}\s*{cell}", r"(?s)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>", r'(?s)attributes-item__label"[^>]*>(.*?)</\w+>\s*<[^>]*attributes-item__value"[^>]*>(.*?)</\w+>']
    entries = [F.arrays_zip(F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), lambda k: F.lower(_text(k))).alias("k"), F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(2)), _text).alias("v")) for p in layouts]
    return F.filter(F.concat(*entries), lambda e: (e["k"] != "") & (e["v"] != ""))


def spec_fields(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and shape, balance, low and high weight, face, core and frame of a product page. Each page is searched once, its values then read from a column."""
    rows = pages.select(*keys, spec_entries(F.col("body")).alias("_e"))
    last = lambda k: F.try_element_at(F.filter("_e", lambda e: e["k"] == k), F.lit(-1))["v"]
    names = {n: F.coalesce(*[F.when(last(k) != "-", last(k)) for k in ks]).alias(n) for n, ks in SPEC_NAMES.items()}
    rows = rows.select(*keys, *names.values())
    named = lambda c, pairs: _chain(F.lower(c), pairs).otherwise(c)
    shape = named(F.col("shape"), [("redond", "Redonda"), ("lagrim", "Lágrima"), ("diam", "Diamante")])
    balance = named(F.col("balance"), [("alto", "Alto"), ("medio", "Medio"), ("bajo", "Bajo")])
    low, high = X.weight_range(F.col("weight"), 281, 449)
    return rows.select(*keys, shape.alias("shape"), balance.alias("balance"), low.alias("low_weight"), high.alias("high_weight"), F.col("face").alias("face"), F.col("core").alias("core"), F.col("frame").alias("frame"))


def _chain(low: Column, pairs: list[tuple[str, str]]) -> Column:
    out = F.when(low.contains(pairs[0][0]), pairs[0][1])
    for part, name in pairs[1:]:
        out = out.when(low.contains(part), name)
    return out


def until_known(rows: DataFrame, known: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Of each group, newest first, the rows before the first known one: those newer than its newest known row."""
    seen = rows.join(known.select(key).distinct(), key, "left_semi").groupBy(group).agg(F.max(F.struct(order, key)).alias("_last"))
    return rows.join(seen, group, "left").filter(F.col("_last").isNull() | (F.struct(order, key) > F.col("_last"))).drop("_last")


def snapshot(spark: SparkSession, path: str, build, now: datetime, hours: int = 2) -> DataFrame:
    """The table at `path` if it was made within the last hours; else build() is written there and read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where):
        kept = spark.read.parquet(path)
        first = kept.select("made_at").first()
        if first is None or first[0] >= now - timedelta(hours=hours):
            return kept.drop("made_at")
    build().withColumn("made_at", F.lit(now).cast("timestamp_ntz")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("made_at")
