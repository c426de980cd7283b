"""Word lists and names whose members decide results. Each is plain data, in one place."""

from __future__ import annotations

# Words of a model name that say nothing about the product.
MODEL_NOISE = ["pala", "de", "padel", "raqueta", "edition", "edicion", "series", "nfa", "superficie", "completa", "mas", "tubo", "pelotas", "segunda", "mano"]

# Words of a model name, and the word each stands for.
MODEL_NAMES = {
    "mtw": "multiweight",
    "w": "woman", "mujer": "woman", "women": "woman",
    "negra": "black", "negro": "black",
    "blanca": "white", "blanco": "white",
    "roja": "red", "rojo": "red",
    "verde": "green",
    "amarilla": "yellow", "amarillo": "yellow",
    "azul": "blue",
    "gris": "grey",
    "naranja": "orange",
    "rosa": "pink",
    "plata": "silver", "plateado": "silver", "plateada": "silver",
    "oro": "gold", "dorado": "gold", "dorada": "gold",
    "morado": "purple", "morada": "purple", "lila": "purple", "violeta": "purple",
    "marron": "brown",
    "bk": "black",
    "bl": "blue",
    "rd": "red",
    "wh": "white",
    "yl": "yellow",
    "jr": "junior",
}

# Colours of a model name.
COLOURS = ["black", "white", "red", "green", "yellow", "blue", "grey", "orange", "pink", "silver", "gold", "purple", "brown"]

# Words of a model name that tell two products apart.
MODEL_TELLING = [
    "ctrl", "control", "team", "hybrid", "air", "carbon", "light", "plus", "elite", "power", "soft", "iron", "speed", "hard", "free",
    "betis", "miami", "se", "gen", "cloud", "geo", "premier", "energy", "luxury", "black", "ls", "prisma", "pansy", "world", "lite",
]

# Variants, and the variant each stands for.
VARIANT_NAMES = {
    "paises bajos": "netherlands", "estados unidos": "usa", "control": "ctrl", "ctr": "ctrl", "hyb": "hybrid", "pwr": "power",
    "xtreme": "xtrem", "cmf": "comfort", "confort": "comfort", "wpt": "world padel tour",
}

# Lines of a brand, and the line each stands for.
LINE_NAMES = {"jr": "Junior", "copa del mundo": "World Cup", "world cup": "World Cup", "crossit": "Cross It"}

# Words of a title that are left out, and words that always stay.
TITLE_STOP = ["de", "da", "del", "la", "el", "y", "e", "con", "para", "pala", "padel", "raqueta", "serie", "series", "edition", "version", "by", "a22", "a23", "a24", "rc"]
TITLE_COLOURS = [
    "black", "blue", "grey", "white", "red", "green", "orange", "pink", "yellow", "purple", "gold", "silver", "navy", "lime",
    "negro", "rojo", "azul", "blanco", "verde", "naranja", "rosa", "amarillo", "gris", "dorado", "plateado", "morado", "violeta", "turquesa",
]
TITLE_KEEP = [
    "hrd", "ctrl", "soft", "air", "light", "team", "carbon", "match", "drive", "arrow", "cross", "hit", "rx", "18k", "12k", "alum", "luxury", "ltd",
    "xtrem", "arena", "hard", "pro", "evo", "plus", "motion", "elite", "genius", "attack", "lite", "x", "proplus", "woman", "sft", "power", "speed",
    *TITLE_COLOURS,
]

# Words of a title that tell two products apart.
TITLE_TELLING = [
    "ctrl", "carbon", "team", "hrd", "light", "soft", "air", "pro", "elite", "attack", "motion", "drive", "match", "arrow", "hit", "rx", "power", "speed",
    "12k", "alum", "luxury", "ltd", "xtrem", "arena", "sft", "hybrid", "lite", "x", "proplus", "woman", "extreme", "vertex", "hack", "genius", "viper",
    "zephyr", "delta", "flash", "radical", "instinct", "comfort", "revolution", "advance", "jr", "st1", "st2", "st3", "st4", "apt", "hexagon", "veron",
    "black", "blue", "grey", "white", "red", "green", "orange", "pink", "yellow", "purple", "gold", "silver", "navy", "lime",
    "01", "02", "03", "04", "05", "06", "07", "08", "09",
]

# Words of a title, and the brand each names.
BRAND_NAMES = {
    "bullpadel": "Bullpadel", "nox": "Nox", "head": "Head", "adidas": "Adidas", "babolat": "Babolat", "wilson": "Wilson", "dunlop": "Dunlop",
    "starvie": "StarVie", "star vie": "StarVie", "vibora": "Vibora", "vibor-a": "Vibora", "siux": "Siux", "royal padel": "Royal Padel",
    "drop shot": "Drop Shot", "dropshot": "Drop Shot", "tecnifibre": "Tecnifibre", "black crown": "Black Crown", "varlion": "Varlion", "joma": "Joma",
    "kuikma": "Kuikma", "alkemia": "Alkemia", "munich": "Munich", "puma": "Puma", "enebe": "Enebe", "kombat": "Kombat", "lok": "Lok",
    "slazenger": "Slazenger", "hirostar": "Hirostar", "cartri": "Cartri", "cork": "Cork", "sane": "Sane", "endless": "Endless", "pallap": "Pallap",
    "tactical padel": "Tactical Padel", "racket project": "Racket Project", "rs padel": "RS Padel", "nzn": "NZN", "vision": "Vision",
    "jhayber": "Jhayber", "harlem": "Harlem", "oxdog": "Oxdog", "vertex": "Bullpadel", "hack": "Bullpadel", "at10": "Nox", "ml10": "Nox",
    "metalbone": "Adidas", "yarara": "Vibora", "electra": "Siux", "pegasus": "Siux",
}

# Players whose names stand in titles and models.
PLAYERS = r"\b(juan lebron|lebron|ale galan|ale gal[aá]n|martita ortega|alex ruiz|agust[ií]n tapia|arturo coello|paquito navarro|coki nieto|stupa|momo gonz[aá]lez|chingotto|franco chingotto|edu alonso|eduardo alonso)\b"

# Words beside a coupon that are no code.
NO_CODES = [
    "DESCUENTO", "EXTRA", "OFERTA", "OFERTAS", "PROMOCION", "PROMO", "PADEL", "GRATIS", "NUEVO", "NUEVA", "WEB", "TARJETA", "ENVIO", "ENVIOS",
    "COMPRA", "PRIMERA", "BIENVENIDA", "BOLSA", "BOLSAS", "CARRITO", "PALA", "PALAS", "SALE", "PALETERO", "PALETEROS", "MOCHILA", "MOCHILAS",
    "ZAPATILLA", "ZAPATILLAS", "ROPA", "CAMISETA", "CAMISETAS", "POLO", "POLOS", "PANTALON", "PANTALONES", "SUDADERA", "SUDADERAS", "CHALECO",
    "CHALECOS", "SHORT", "SHORTS", "PELOTA", "PELOTAS", "GRIP", "OVERGRIP", "OUTLET", "ACCESORIOS", "ACCESORIO", "COMPLEMENTO", "COMPLEMENTOS",
    "FUNDA", "FUNDAS", "TROLLEY", "TROLLEYS", "CALCETINES", "MUNEQUERA", "MUNEQUERAS", "GORRA", "GORRAS", "CAPUCHA", "CAPUCHAS",
]

# Words and phrases of a title that say it is no racket.
AUDIT_EXCLUDED = [
    "bolsa", "mochila", "funda", "paletero", "grip", "overgrip", "protector", "muñequera", "bolas", "pelota", "pelotas", "camiseta", "zapatilla", "zapatillas",
    "ropa", "lote", "antivibrador", "pickleball", "tenis head", "tenis wilson", "pure drive", "pure aero", "pure strike", "driver golf", "speedback",
]

# Brands that titles write in more ways than one.
AUDIT_BRANDS = {"star vie": ["starvie", "star vie"], "black crown": ["blackcrown", "black crown"], "drop shot": ["dropshot", "drop shot"], "royal padel": ["royal padel"], "vibora": ["vibor-a", "vibora"]}

# Short words that do not count as a model's own in an address.
AUDIT_COMMON = ["pro", "air", "hit", "evo"]

# Words that are left out of a model, and phrases of shops (plain lower case).
MODEL_RESIDUE = ["pala", "padel", "de", "la", "el", "by", "raqueta", "edition", "edicion", "series", "nfa"]
SHOP_PHRASES = ["pala de padel", "superficie completa", "mas raquetera mas tubo de pelotas", "raqueta de segunda mano"]
