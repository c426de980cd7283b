"""Titles of what is no product: a dictionary of phrases, met by keys instead of one regular expression a class.

A phrase is looked for in one of four ways: `prefix`, at the start of the title, or after a leading "pala "; `word`, as whole
words anywhere; `inner`, as whole words but not first; `part`, anywhere, also inside words. Marks on letters and
capitals do not count. Titles meet whole words by runs of words, prefixes by three letters, parts by any three letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.operators.groups import looked_up

MAX_WORDS = 4

# What shops' titles begin with that are no single product, and brands that are not followed.
PREFIXES = ["pack ", "super pack ", "pala test ", "bolso ", "accesorio ", "pala de padel open"]
BRAND_PREFIXES = [
    "paddle coach", "just ten", "hbl ", "higer padel", "hybrid padel", "middle moon", "nexus ", "spin max", "totalspin", "rox ", "rs ", "rs by robin", "rs prime", "robin soderling", "erreesse", "pala erreesse", "lx ",
    "pala lx ", "sane ", "pala sane ", "pala rs ", "aca padel", "aca atrium", "aca magic", "aca roqueta", "aca wave", "aca palladium", "pala aca ", "set platinum", "kelme ", "belén berbel", "belen berbel", "wild bull",
]
# Brands without a product in the catalogue.
UNLISTED_BRANDS = [
    "hbl", "goliat", "cartri", "alacran", "kelme", "endless", "stiga", "osaka", "indian maharadja", "maharadja", "by vp", "tactical", "hirostar", "xcalion", "armani ea7", "ea7", "fila", "salming", "prokennex", "bb zeus",
    "eqsi", "futura", "power padel", "sanyo", "bonabola",
]
# Clothes, shoes and bags.
CLOTHING = [
    "camiseta", "camisetas", "sudadera", "sudaderas", "polo", "polos", "short", "shorts", "pantalon", "pantalones", "falda", "faldas", "malla", "mallas", "chaleco", "chalecos", "cortavientos", "calcetin", "calcetines",
    "zapatilla", "zapatillas", "paletero", "paleteros",
]
# Titles of used goods in shops.
USED = ["segunda mano", "second hand", "2ª mano", "2a mano", "reacondicionad", "refurbished", "defectos esteticos", "defectos estéticos"]
# Words of used listings that are no racket for a grown-up in one piece.
LISTING_WORDS = [
    "junior", "jr", "infantil", "niño", "niña", "youth", "kid", "kids", "reparar", "reparacion", "reparado", "reparada", "para piezas", "roto", "rota", "dañado", "dañada", "fisura", "crack", "golpe", "no funciona", "tenis", "test",
    "mochila", "paletero", "bolsa", "funda", "grip", "overgrip", "protector", "muñequera", "visera", "gorra", "pelota", "pelotas", "zapatilla", "zapatillas", "camiseta", "pantalon", "short",
]

#: Classes of shop titles in their order: (class, way, phrases).
SHOP_CLASSES = [
    ("prefix", "prefix", PREFIXES),
    ("brand", "prefix", BRAND_PREFIXES),
    ("unlisted", "word", UNLISTED_BRANDS),
    ("exclusive", "part", ["exclusiva padelproshop"]),
    ("bundle", "inner", ["kit", "pack"]),
    ("bundle", "word", ["test", "mas raquetera"]),
    ("bundle", "part", ["+ raquetera", "+raquetera"]),
    ("pickleball", "part", ["pickleball"]),
    ("clothing", "word", CLOTHING),
    ("beach", "part", ["beach tennis"]),
    ("beach", "word", ["bt"]),
    ("used", "part", USED),
]
#: The only class of used listings.
LISTING_CLASSES = [("listing", "word", LISTING_WORDS), ("listing", "part", ["j.r"])]


def plain(text: Column) -> Column:
    return F.lower(F.translate(text, X.MARKED, X.PLAIN))


def stop_list(spark: SparkSession, classes: list[tuple[str, str, list[str]]]) -> DataFrame:
    """class, way, phrase, place: a dictionary; earlier classes and phrases win."""
    rows = [(name, way, phrase, place, n) for place, (name, way, phrases) in enumerate(classes) for n, phrase in enumerate(phrases)]
    return spark.createDataFrame(rows, "class string, way string, phrase string, place int, nth int")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def stopped(titles: DataFrame, phrases: DataFrame, id_col: str = "title_id") -> DataFrame:
    """(id_col, class, phrase) of each title that a phrase of the dictionary stops: the first by place, then by number in its class.

    phrases as stop_list() gives them; a phrase with a value in a column `model`, if there is one, counts only for titles with
    that model (exclusions of one searched model). Titles that nothing stops, null ones among them, are left out. Phrases are of four words and
    three letters or more, or are looked for as words.
    """
    only = [c for c in ("model",) if c in phrases.columns and c in titles.columns]
    rows = titles.filter("title is not null").select(id_col, *only, plain(F.col("title")).alias("low"))
    rows = rows.withColumns({"words": _words(F.col("low")), "bare": F.regexp_replace("low", "^pala ", "")})
    run = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: i + n - 1 <= F.size("words")), lambda i: F.struct(F.when(i > 1, "inner").otherwise("word").alias("how"), F.array_join(F.slice("words", i, n), " ").alias("key")))
    three = lambda how, values: F.transform(F.array_distinct(values), lambda k: F.struct(F.lit(how).alias("how"), k.alias("key")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - 2, F.lit(1))), lambda i: F.substring("low", i, 3))
    keys = F.concat(*[run(n) for n in range(1, MAX_WORDS + 1)], three("prefix", F.array(F.substring("low", 1, 3), F.substring("bare", 1, 3))), three("part", grams))
    asked = rows.select(id_col, *only, "low", "bare", F.explode(F.array_distinct(keys)).alias("k")).select(id_col, *only, "low", "bare", "k.how", "k.key")
    folded = plain(F.col("phrase"))
    whole = F.col("way").isin("word", "inner")
    held = phrases.withColumns({"folded": folded, "key": F.when(whole, F.array_join(_words(folded), " ")).otherwise(F.substring(folded, 1, 3))})
    held = held.select(*[F.col(c).alias("only_" + c) for c in only], "class", "way", "phrase", "place", "nth", "folded", "key")
    right = F.when(F.col("way") == "word", F.col("how").isin("word", "inner")).when(F.col("way") == "inner", F.col("how") == "inner")
    right = right.when(F.col("way") == "prefix", (F.col("how") == "prefix") & (F.startswith("low", "folded") | F.startswith("bare", "folded"))).otherwise((F.col("how") == "part") & F.contains("low", "folded"))
    met = looked_up(asked, held, "key").filter(right)
    for c in only:
        met = met.filter(F.col("only_" + c).isNull() | F.coalesce(F.col("only_" + c) == F.col(c), F.lit(False)))
    return met.groupBy(id_col).agg(F.min(F.struct("place", "nth", "class", "phrase")).alias("s")).select(id_col, "s.class", "s.phrase")
