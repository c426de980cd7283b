"""Queries of the word rules: every pair of worked titles and models meets, and the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.functions import coupons
from dealforge.functions import text as X
from dealforge.functions import vocabulary as V
from dealforge.operators import matching as M
from dealforge.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

TITLES = [
    "Vertex 04W Hard Pro+ 226", "Bullpadel Hack 3 Control 2025", "Adidas Metalbone HRD+ 3.4 2026", "Nox AT10 18K Luxury Genius", "Pala de padel Head Delta Pro Plus", "Electra ST 2 Soft",
    "Vertex mujer negra raqueta series", "Black Crown 14", "Siux Pegasus Pro Line 12K", "Flow05 Light W", "Énergy PWR hyb 360 ctr", "LITE x 7",
]
MODELS = [
    None, "", "Bold", "Bold soft", "Bold black", "negra", "W 25", "Mujer 2025", "Superficie completa", "3.4", "Ctrl 3.4", "Woman Jr Boy", "Girl Junior", "Elite", "Carbon Control", "v3p4",
    "26", "Bolds", "Bold 2", "Yl Rosa",
]
NAMES = ["Adidas Metalbone 3.3 2026", "Bullpadel Flow Legend 12K", "Drop-Shot Conqueror Lite", "Nox AT10 18K Élite", "Vibor A Titan 2023", "Legend 3.4", "Other thing"]
BRANDS = ["Adidas", "Bullpadel", "Drop Shot", "Nox", "Vibor-A", "Legend", "Nobody"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def pick(values: list, n):
    """The value at place n of a list, as a Column."""
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def sql_pick(values: list, n: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][1 + {n} % {len(values)}]"


def sql_list(values: list) -> str:
    return "(" + ", ".join(map(sql_text, values)) + ")"


def sql_names(t: str, names: dict) -> str:
    return f"CASE {t} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in names.items()) + f" ELSE {t} END"


def sql_plain(x: str) -> str:
    return f"lower(translate({x}, '{X.MARKED}', '{X.PLAIN}'))"


def sql_title_tokens(x: str) -> str:
    low = sql_plain(x)
    for pattern, to in X.TITLE_REWRITES:
        low = f"regexp_replace({low}, {sql_text(pattern.replace('(?=\\s|$)', ''))}, {sql_text(to.replace('$', chr(92)))}, 'g')"
    words = f"regexp_split_to_array({low}, '[^a-z0-9_]+')"
    number = f"(NOT regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[0-9]{{1,2}}$') OR (regexp_matches(t, '^[0-9]{{3,4}}$') AND NOT regexp_matches(t, '^20(1[89]|2[0-9])$')))"
    return f"list_filter({words}, lambda t: (length(t) >= 2 OR regexp_matches(t, '^[0-9x]$')) AND (t IN {sql_list(V.TITLE_KEEP)} OR (t NOT IN {sql_list(V.TITLE_STOP)} AND {number})))"


def sql_model_tokens(x: str) -> str:
    words = f"regexp_split_to_array(regexp_replace({sql_plain(x)}, '\\b([0-9]+)\\.([0-9]+)\\b', '\\1\\2', 'g'), '[^a-z0-9]+')"
    return f"list_transform(list_filter({words}, lambda t: t <> '' AND t NOT IN {sql_list(V.MODEL_NOISE)}), lambda t: {sql_names('t', V.MODEL_NAMES)})"


@query(f"SELECT p_partkey AS item_id, {sql_title_tokens(sql_pick(TITLES, 'p_partkey') + chr(32) + '|| chr(32) || p_name')} AS words FROM part")
def title_tokens(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item_id"), X.title_tokens(F.concat_ws(" ", pick(TITLES, F.col("p_partkey")), "p_name")).alias("words"))


@query(f"SELECT p_partkey AS item_id, coalesce({sql_model_tokens(sql_pick(MODELS, 'p_partkey'))}, []) AS words FROM part")
def model_tokens(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.coalesce(X.model_tokens(pick(MODELS, F.col("p_partkey"))), F.array().cast("array<string>")).alias("words"))


YEAR = "CAST(CASE WHEN p_partkey % 3 <> 0 THEN 2025 + p_partkey % 2 END AS INTEGER)"


def _year():
    return F.when(F.col("p_partkey") % 3 != 0, 2025 + F.col("p_partkey") % 2).cast("int")


PAIR = f"SELECT p_partkey AS item_id, {sql_pick(MODELS, 'p_partkey')} AS a, {sql_pick(MODELS, f'CAST(floor(p_partkey / {len(MODELS)}) AS BIGINT)')} AS b, {YEAR} AS y FROM part"


def _pair(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("item_id"), pick(MODELS, k).alias("a"), pick(MODELS, F.floor(k / len(MODELS))).alias("b"), _year().alias("y"))


@query(f"""WITH p AS ({PAIR}), t AS (SELECT item_id, list_filter(list_concat(coalesce({sql_model_tokens('a')}, []), coalesce({sql_model_tokens('b')}, [])), lambda w: NOT coalesce(regexp_matches(w, '^[0-9]+$') AND (w = CAST(y AS VARCHAR) OR w = CAST(y % 100 AS VARCHAR)), false)) AS t FROM p)
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(t, lambda w: w <> 'junior' OR NOT (list_contains(t, 'boy') OR list_contains(t, 'girl'))))), '|') AS signature FROM t""")
def product_signature(spark, sf):
    return _pair(spark, sf).select("item_id", X.signature(F.col("a"), F.col("b"), F.col("y")).alias("signature"))


CLOSE = "(t = u OR (length(t) >= 4 AND length(u) >= 4 AND abs(length(t) - length(u)) = 1 AND (starts_with(t, u) OR starts_with(u, t))))"
LEFT = "list_filter({}, lambda t: len(list_filter({}, lambda u: " + CLOSE + ")) = 0)"
UNSAFE = f"lambda t: t IN {sql_list(V.MODEL_TELLING)} OR regexp_matches(t, '^v[0-9]+p[0-9]+$') OR (regexp_matches(t, '^[0-9]+$') AND y IS NULL)"
SAFE = f"lambda t: NOT (t IN {sql_list(V.COLOURS)} OR coalesce(regexp_matches(t, '^[0-9]+$') AND (t = CAST(y AS VARCHAR) OR t = CAST(y % 100 AS VARCHAR)), false))"


@query(f"""WITH p AS ({PAIR}), t AS (SELECT *, coalesce({sql_model_tokens('a')}, []) AS ta, coalesce({sql_model_tokens('b')}, []) AS tb FROM p), d AS (SELECT *, {LEFT.format('ta', 'tb')} AS more_a, {LEFT.format('tb', 'ta')} AS more_b FROM t)
SELECT item_id, CASE WHEN coalesce(b, '') = '' THEN len(ta) = 0 OR coalesce(regexp_matches(trim(a), '^[0-9.]+$'), false) WHEN len(more_b) = 0 THEN len(list_filter(more_a, {UNSAFE})) = 0
WHEN len(more_a) = 0 AND len(ta) = 0 THEN len(list_filter(more_b, {SAFE})) = 0 WHEN len(more_a) = 0 THEN len(list_filter(more_b, {UNSAFE})) = 0 ELSE false END AS fits FROM d""")
def model_compatible(spark, sf):
    """Of all pairs of MODELS, the first as the catalogue's and the second as the title's."""
    return _pair(spark, sf).select("item_id", M.model_compatible(F.col("a"), F.col("b"), F.col("y"), F.lit(None).cast("int")).alias("fits"))


def sql_named(x: str, b: str) -> str:
    return f"regexp_matches({x}, {sql_text('(?i)' + M.WRITTEN.get(b, rf'\b{b}\b'))})"


OTHER = " OR ".join(f"(brand <> {sql_text(b)} AND {sql_named('title', b)})" for b in M.NAMED_BRANDS)
OWN = " OR ".join(f"(brand = {sql_text(b)} AND {sql_named('title', b)})" for b in M.NAMED_BRANDS)
FALSE = f"""WITH p AS (SELECT p_partkey AS item_id, {sql_pick(TITLES + NAMES, 'p_partkey')} AS title, {sql_pick(NAMES, 'CAST(floor(p_partkey / 19) AS BIGINT)')} AS name, {sql_pick(BRANDS, 'CAST(floor(p_partkey / 19) AS BIGINT)')} AS brand, {YEAR} AS y FROM part),
m AS (SELECT *, nullif(regexp_extract(title, '\\b([0-9]+\\.[0-9]+)\\b', 1), '') AS vt, nullif(regexp_extract(name, '\\b([0-9]+\\.[0-9]+)\\b', 1), '') AS vn, nullif(lower(regexp_extract(title, '(?i)\\b([0-9]{{1,2}}k)\\b', 1)), '') AS kt, nullif(lower(regexp_extract(name, '(?i)\\b([0-9]{{1,2}}k)\\b', 1)), '') AS kn,
  CAST(nullif(regexp_extract(title, '\\b(20[1-3][0-9])\\b', 1), '') AS INTEGER) AS yt FROM p)
SELECT item_id, CASE WHEN vt <> vn THEN 'version' WHEN kt <> kn THEN 'weight' WHEN regexp_matches({sql_plain('title')}, '\\blite\\b') <> regexp_matches({sql_plain('name')}, '\\blite\\b') THEN 'lite' WHEN NOT ({OWN}) AND ({OTHER}) THEN 'brand' WHEN abs(yt - y) >= 2 THEN 'year' END AS rule FROM m"""


@query(FALSE)
def false_positives(spark, sf):
    k = F.col("p_partkey")
    name, brand = (pick(v, F.floor(k / 19)) for v in (NAMES, BRANDS))
    return table(spark, sf, "part").select(k.alias("item_id"), M.false_positive(pick(TITLES + NAMES, k), name, brand, name, _year()).alias("rule"))


AUDIT_BRAND = ["Star Vie", "Vibora", "Nox", "Drop Shot", "Black Crown"]
AUDIT_FORMS = ["Starvie Control 03 Elite", "VIBOR-A soft w 2024", "nox hard 5 Carbon Ctr 2026", "Grip drop shot", "blackcrown pro + 2.6 con Mochila", "Otra cosa", "Vertex 3 pro line 2025"]
AUDIT_MODEL = ["Control 03 Elite 2025", "Soft Woman", "Hard 5 carbon 2026 control", "Pro Air Hit", "Flow 4 proline 2.6", "Elite"]
AUDIT_SLUG = ["pala-control-elite-2025-x", "soft_woman-24-p", "hard-carbon-25-12345", "x", "flow-04-line", "grip/", "elite-26-a/"]


def sql_audit_tokens(x: str) -> str:
    low = sql_plain(x)
    for pattern, to in X.AUDIT_REWRITES:
        low = f"regexp_replace({low}, {sql_text(pattern.replace('(?=\\s|$)', ''))}, {sql_text(to.replace('$', chr(92)))}, 'g')"
    return f"list_filter(regexp_split_to_array({low}, '[^a-z0-9_]+'), lambda t: (length(t) >= 2 OR regexp_matches(t, '^[0-9x]$')) AND t NOT IN {sql_list(V.TITLE_STOP)} AND NOT (regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, '^(0?[1-9]|0)$')))"


def sql_contains(x: str, words: list) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {sql_text(w)})" for w in words) + ")"


OWN_WORDS = sql_audit_tokens("regexp_replace(CASE WHEN starts_with(lower(model), lower(brand) || ' ') THEN substr(model, length(brand) + 2) ELSE model END, '\\b20[0-9]{2}\\b', '')")
NAMED = " OR ".join(f"(lower(brand) = {sql_text(b)} AND {sql_contains('title', a)})" for b, a in V.AUDIT_BRANDS.items())
PAIRS = f"""k AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 5) AS BIGINT) AS k5, CAST(floor(p_partkey / 35) AS BIGINT) AS k35, p_retailprice AS price FROM part),
a AS (SELECT k, {sql_pick(AUDIT_BRAND, 'k')} AS brand, {sql_pick(AUDIT_FORMS, 'k5')} AS title, {sql_pick(AUDIT_BRAND, 'k')} || ' ' || {sql_pick(AUDIT_MODEL, 'k35')} AS model, CAST(CASE WHEN k % 4 <> 0 THEN 2024 + k % 4 END AS INTEGER) AS y, price,
  'https://s.example/' || {sql_pick(AUDIT_SLUG, 'k5')} AS url FROM k), w AS (SELECT *, {OWN_WORDS} AS own FROM a)"""


def _audited(spark, sf):
    k = F.col("p_partkey")
    k5, k35 = F.floor(k / 5), F.floor(k / 35)
    brand = pick(AUDIT_BRAND, k)
    return table(spark, sf, "part").select(
        k.alias("match_id"), F.when(k % 50 != 7, k).alias("item_id"), (k % 6).alias("store_id"), brand.alias("brand"), pick(AUDIT_FORMS, k5).alias("title"), F.concat_ws(" ", brand, pick(AUDIT_MODEL, k35)).alias("model"),
        F.when(k % 4 != 0, 2024 + k % 4).cast("int").alias("year"), (k % 100).alias("discount_pct"), F.concat(F.lit("https://s.example/"), pick(AUDIT_SLUG, k5)).alias("url"),
        (k % 300).cast("decimal(12,2)").alias("price"), F.when(k % 11 != 0, 300).cast("decimal(12,2)").alias("reference"), (k % 13 != 0).alias("available"), F.when(k % 7 == 0, 0.9).otherwise(0.92).alias("confidence"),
        (F.lit("2025-01-02T00:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=(k % 26).cast("int"))).alias("seen_at"),
    )


LISTING_AUDIT = f"""WITH {PAIRS}, c AS (SELECT k, k AS item_id, unnest([
  CASE WHEN CAST(nullif(regexp_extract(title, '\\b(20(?:1[89]|2[0-9]))\\b', 1), '') AS INTEGER) <> y THEN 'M1' END,
  CASE WHEN len(own) > 2 AND len(list_filter(own, lambda t: list_contains({sql_audit_tokens('title')}, t))) / len(own) < 0.4::DOUBLE THEN 'M2' END,
  CASE WHEN {sql_contains('title', V.AUDIT_EXCLUDED)} THEN 'M3' END, CASE WHEN k % 100 > 90 THEN 'M4' END,
  CASE WHEN NOT ({NAMED} OR contains(lower(title), split_part(lower(brand), ' ', 1))) AND NOT (lower(brand) NOT IN {sql_list(list(V.AUDIT_BRANDS))} AND contains(lower(title), lower(brand))) THEN 'M5' END]) AS code FROM w WHERE k % 50 <> 7)
SELECT k AS match_id, item_id, code, CASE WHEN code IN ('M1', 'M3') THEN 'error' ELSE 'warning' END AS severity, code IN ('M1', 'M3') AS corrected FROM c WHERE code IS NOT NULL"""
PRICE_AUDIT = f"""WITH {PAIRS}, u AS (SELECT *, CASE WHEN k % 11 <> 0 THEN 300 END AS reference, CAST(nullif(regexp_extract(url, '20[0-9]{{2}}', 0), '') AS INTEGER) AS whole,
  CASE WHEN regexp_matches(url, '[_-]2[0-9][_-][0-9]{{3}}') THEN NULL ELSE CAST(nullif(regexp_extract(url, '[_-](2[0-9])[_-]', 1), '') AS INTEGER) + 2000 END AS short,
  replace(replace(list_last(list_filter(string_split(url, '/'), lambda p: p <> '')), '-', ' '), '_', ' ') AS slug, list_filter(own, lambda t: length(t) >= 3 AND t NOT IN {sql_list(V.AUDIT_COMMON)}) AS key
  FROM w WHERE k % 50 <> 7 AND k % 13 <> 0 AND k % 7 <> 0 AND k % 6 <> 2 AND k % 26 <= 24),
c AS (SELECT k, unnest([CASE WHEN CASE WHEN whole BETWEEN 2018 AND 2030 THEN whole ELSE short END <> y THEN 'C1' END, CASE WHEN {sql_contains('title', V.AUDIT_EXCLUDED)} THEN 'C2' END,
  CASE WHEN floor((reference - k % 300) / 300.0::DOUBLE * 100 + 0.5) > 80 THEN 'C3' END,
  CASE WHEN len(key) >= 2 AND len(list_filter(key, lambda t: contains(slug, t))) / len(key) < 0.25::DOUBLE THEN 'C4' END]) AS code FROM u)
SELECT k AS match_id, k AS item_id, code, CASE WHEN code IN ('C1', 'C2') THEN 'error' ELSE 'warning' END AS severity, code IN ('C1', 'C2') AS corrected FROM c WHERE code IS NOT NULL"""


@query(LISTING_AUDIT)
def match_audit(spark, sf):
    """Brands, titles and models of the lists above meet in all combinations."""
    return M.audit_listings(_audited(spark, sf))


@query(PRICE_AUDIT)
def price_audit(spark, sf):
    return M.audit_prices(_audited(spark, sf), F.lit("2025-01-02T00:00:00").cast("timestamp_ntz"))


@query(f"SELECT code, severity, count(*) AS n, count(*) FILTER (corrected) AS corrected FROM (({LISTING_AUDIT}) UNION ALL ({PRICE_AUDIT})) GROUP BY code, severity")
def audit_counts(spark, sf):
    return M.audit_counts(match_audit(spark, sf), price_audit(spark, sf))


PAGES = [
    "<p>CODIGO: PADELMANIA10 -10%</p>", "-16%15% EXTRA COD: SUM15", '<div data-title="CUPON 20% EXTRA HOT20">x</div>', "5% extra con SUMMER5 y mas", "Suscribete a la newsletter y usa el codigo HOLA10 10%", "codigo PALAS 10%",
    "no acumulable con otras ofertas: 33%", "codigo hola10 10%", "cupon: ABC99 60%", "<script>codigo: HIDE10 10%</script> nada", "codigo 10% dto VERANO10", "oferta 15% de descuento con VERANO15. fin",
]
COUPONS = ["PADELMANIA10:10", "SUM15:15", "HOT20:20", "SUMMER5:5", None, None, None, None, None, None, "VERANO10:10", "VERANO15:15"]


@query(f"SELECT page_id, {sql_pick(COUPONS, 'page_id')} AS coupon FROM pages")
def coupon_detect(spark, sf):
    """A worked page for each of the pages; the SQL lists what each holds."""
    c = coupons.detect_coupon(pick(PAGES, F.col("page_id")))
    return table(spark, sf, "pages").select("page_id", F.when(c.isNotNull(), F.concat_ws(":", c["code"], c["pct"].cast("string"))).alias("coupon"))


@query("""WITH l AS (SELECT page_id, unnest(['https://shop.example/rebajas-verano', 'https://shop.example/sale', 'https://shop.example/outlet-' || page_id % 3, 'https://shop.example/blog/rebajas']) AS u FROM pages)
SELECT page_id, list_sort(list_filter(list(u), lambda x: NOT contains(x, '/blog') AND x <> 'https://shop.example/outlet-0')) AS links FROM l GROUP BY page_id""")
def sale_sections(spark, sf):
    k = F.col("page_id")
    html = F.concat(F.lit('<a class="x" href="/Rebajas-Verano/?a=1#top">r</a><a href="https://SHOP.example/sale/">s</a><a href="/outlet-'), k % 3, F.lit('">o</a><a href="/blog/rebajas">b</a><a href="https://other.example/outlet">z</a><a href="/palas">p</a>'))
    found = coupons.sale_links(html, F.lit("https://shop.example/palas"), F.array(F.lit("https://shop.example/outlet-0")))
    return table(spark, sf, "pages").select("page_id", F.array_sort(found).alias("links"))
