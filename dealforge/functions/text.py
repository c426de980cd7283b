"""Text functions, Column to Column: normalising, tokens, signatures, years, prices, HTML, URLs.

All are built-in expressions and stay inside code generation. A null input gives null unless a
docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealforge.functions import vocabulary as V

# Letters with marks and their plain letters.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalize(text: Column) -> Column:
    """Plain lower-case letters and digits, all else one space, none at the ends."""
    low = F.lower(F.translate(text, MARKED, PLAIN))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Words of normalize(text); an empty text has none."""
    return F.filter(F.split(normalize(text), " ", -1), lambda t: t != "")


def table_of(names: dict[str, str]) -> Column:
    """A constant map, from one literal: building a literal for each entry takes the driver seconds."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in names.items())), F.lit(";"), F.lit("="))


def renamed(words: Column, names: dict[str, str]) -> Column:
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table_of(names), t), t))


#: What title_tokens() rewrites, in this order. Fixed values.
TITLE_REWRITES = [
    (r"hrd\+", "hrd"), (r"\bhard\b", "hrd"), (r"\bsoft\b", "sft"), (r"\bhyb\b", "hybrid"), (r"\bctr\b", "ctrl"), (r"\bcontrol\b", "ctrl"), (r"\bpwr\b", "power"),
    (r"pro\s*\+", "proplus"), (r"\bpro plus\b", "proplus"), (r"\b(st|electra st)\s+([0-9])\b", "$1$2"), (r"([0-9])w\b", "$1 woman"), (r"\bw\b(?=\s|$)", "woman"),
    (r"\bproline\b", "line"), (r"\bpro\s+line\b", "line"), (r"\b(hack|vertex|flow)\s+([0-9])\b", "$1 0$2"), (r"\b(hack|vertex|flow)(0[1-9])\b", "$1 $2"), (r"\b([0-9]+)\.([0-9]+)\b", "v$1p$2"),
]


def title_tokens(text: Column) -> Column:
    """Words for matching titles: synonyms rewritten, decimals as vApB, stop words and years left out."""
    low = reduce(lambda c, r: F.regexp_replace(c, *r), TITLE_REWRITES, F.lower(F.translate(text, MARKED, PLAIN)))
    words = F.split(F.regexp_replace(low, r"[^a-z0-9_]+", " "), " ", -1)
    long = lambda t: (F.length(t) >= 2) | t.rlike("^[0-9x]$")
    number = lambda t: ~t.rlike("^[0-9]+$") | t.rlike("^[0-9]{1,2}$") | (t.rlike("^[0-9]{3,4}$") & ~t.rlike("^20(1[89]|2[0-9])$"))
    return F.filter(words, lambda t: long(t) & (t.isin(V.TITLE_KEEP) | (~t.isin(V.TITLE_STOP) & number(t))))


#: What audit_tokens() rewrites, in this order. Fixed values.
AUDIT_REWRITES = [
    (r"hrd\+", "hrd"), (r"\bhard\b", "hrd"), (r"\bsoft\b", "sft"), (r"\bctr\b", "ctrl"), (r"\bcontrol\b", "ctrl"), (r"pro\s*\+", "proplus"), (r"\bpro plus\b", "proplus"),
    (r"\bw\b(?=\s|$)", "woman"), (r"\bproline\b", "line"), (r"\bpro\s+line\b", "line"), (r"\b(hack|vertex|flow)\s+([0-9])\b", "$1 0$2"), (r"\b([0-9]+)\.([0-9]+)\b", "v$1p$2"),
]


def audit_tokens(text: Column) -> Column:
    """Words that an audit counts: as title_tokens(), with fewer rewrites and only numbers 0 to 9 and 01 to 09."""
    low = reduce(lambda c, r: F.regexp_replace(c, *r), AUDIT_REWRITES, F.lower(F.translate(text, MARKED, PLAIN)))
    words = F.split(F.regexp_replace(low, r"[^a-z0-9_]+", " "), " ", -1)
    return F.filter(words, lambda t: ((F.length(t) >= 2) | t.rlike("^[0-9x]$")) & ~t.isin(V.TITLE_STOP) & (~t.rlike("^[0-9]+$") | t.rlike("^0?[1-9]$|^0$")))


#: What prepared_title() rewrites, in this order. Fixed values.
TITLE_PREPARED = [
    (r"(?i)^\s*pala\s+de\s+p[aá]del", ""), (r"(?i)padel\s+racket", ""), (r"(?i)^\s*pala", ""), (r"(?i)carb-on", "carbon"), (r"(?i)\bgravitity\b", "gravity"), (r"[–—]", " "),
    (r"(\w)\+", "$1 PLUS"), (r"(?<=\S) \+(?=\s|$)", " PLUS"), (r"(?<=\s)\+(?=\s|$)", "PLUS"), (r"\b2\.([4-9])\b", "202$1"), (r"(?i)\bspecial\s+edition\b", "SE"), (r"\b[0-9]{5,}\b", ""),
]


def prepared_title(text: Column) -> tuple[Column, Column]:
    """A title for taking attributes out of it, and the generation (3.1 to 3.4) that it names.

    Shop words in front go, a plus sign becomes PLUS, 2.6 becomes 2026, product codes of five digits and
    more go. Without a year, 3.1 to 3.4 become 2022 to 2025; the generation is null otherwise.
    """
    out = reduce(lambda c, r: F.regexp_replace(c, *r), TITLE_PREPARED, text)
    dated = out.rlike(r"\b20[2-9][0-9]\b")
    found = F.nullif(F.regexp_extract(out, r"(?s)^.*\b(3\.[1-4])\b", 1), F.lit(""))
    years = reduce(lambda c, n: F.regexp_replace(c, rf"\b3\.{n}\b", str(2021 + n)), range(1, 5), out)
    return F.when(dated, out).otherwise(years), F.when(~dated, found)


def title_words(text: Column) -> Column:
    """Plain lower-case words of letters and digits; a decimal such as 1.0 is one word."""
    return F.regexp_extract_all(F.lower(F.translate(text, MARKED, PLAIN)), F.lit(r"((?<![a-z0-9])[0-9]+\.[0-9]+(?![a-z0-9])|[a-z0-9]+)"), F.lit(1))


def model_tokens(text: Column) -> Column:
    """Words of a model name: 3.4 as 34, noise left out, colours and the like by one name each."""
    words = tokens(F.regexp_replace(text, r"\b([0-9]+)\.([0-9]+)\b", "$1$2"))
    return renamed(F.filter(words, lambda t: ~t.isin(V.MODEL_NOISE)), V.MODEL_NAMES)


def colour_of(model: Column) -> Column:
    return F.get(F.filter(model_tokens(model), lambda t: t.isin(V.COLOURS)), 0)


def without_colour(model: Column) -> Column:
    return F.array_join(F.filter(model_tokens(model), lambda t: ~t.isin(V.COLOURS)), " ")


def variant_name(variant: Column) -> Column:
    """Plain lower case, by one name each; null for an empty one."""
    low = F.trim(F.lower(F.translate(variant, MARKED, PLAIN)))
    return F.when(variant != "", F.coalesce(F.try_element_at(table_of(V.VARIANT_NAMES), low), low))


def line_name(line: Column) -> Column:
    return F.coalesce(F.try_element_at(table_of(V.LINE_NAMES), F.trim(F.lower(line))), line)


def is_year(word: Column, year: Column) -> Column:
    """Whether a number is the year, whole or in two digits; false without a year."""
    return F.coalesce(word.rlike("^[0-9]+$") & ((word == year.cast("string")) | (word == (year % 100).cast("string"))), F.lit(False))


def close(a: Column, b: Column) -> Column:
    """Equal tokens, or of four letters and more where one is the other and a letter more."""
    longer = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) == 1)
    return (a == b) | (longer & (a.startswith(b) | b.startswith(a)))


def all_in(some: Column, other: Column) -> Column:
    """Whether each token of `some` is close to one of `other`."""
    return F.forall(some, lambda t: F.exists(other, lambda u: close(t, u)))


def signature(model: Column, variant: Column, year: Column | None = None) -> Column:
    """Sorted distinct tokens of model and variant without the year, joined by |; junior goes where boy or girl is."""
    none = F.array().cast("array<string>")
    year = F.lit(None).cast("int") if year is None else year
    words = F.concat(F.coalesce(model_tokens(model), none), F.coalesce(model_tokens(variant), none))
    words = F.filter(words, lambda t: ~is_year(t, year))
    young = F.exists(words, lambda t: t.isin("boy", "girl"))
    words = F.filter(words, lambda t: ~(young & (t == "junior")))
    return F.array_join(F.array_sort(F.array_distinct(words)), "|")


def slugify(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit("-"))


def extract_year(text: Column) -> Column:
    """A year from 2018 to 2029, else the years 2020 to 2029 from a two-digit word after a space."""
    full = F.regexp_extract(text, r"(?<![A-Za-z0-9_])(20(?:1[89]|2[0-9]))(?![A-Za-z0-9_])", 1)
    short = F.regexp_extract(text, r"\s(2[0-9])(?:\s|$)", 1)
    return F.when(full != "", full.try_cast("int")).when(short != "", short.try_cast("int") + 2000)


def token_similarity(a: Column, b: Column) -> Column:
    """Percent of the longer token list that is found, whole or as a prefix either way; 0 without tokens."""
    ta = F.filter(tokens(a), lambda t: F.length(t) > 1)
    tb = F.array_distinct(F.filter(tokens(b), lambda t: F.length(t) > 1))
    hits = F.size(F.filter(ta, lambda t: F.exists(tb, lambda u: u.startswith(t) | t.startswith(u))))
    most = F.greatest(F.size(ta), F.size(tb))
    return F.when(most <= 0, F.lit(0.0)).otherwise(hits / most * 100)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def parse_price(text: Column) -> Column:
    """1.299,95 or 79,95 with signs around it, as decimal(10,2); null if there is no number."""
    digits = F.regexp_replace(text, r"[^0-9,.]", "")
    plain = F.when(digits.contains(","), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(digits)
    return plain.try_cast("decimal(10,2)")


def minor_units(amount: Column, minor: int = 2) -> Column:
    return (amount / F.lit(10**minor)).cast("decimal(12,2)")


def round_half_up(value: Column, places: int = 0) -> Column:
    """floor(x + 0.5), also for negative values."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale if places else F.floor(value + 0.5).cast("bigint")


def vat_heuristic(net: Column, rate: str = "1.21") -> Column:
    """net with tax if that looks like a retail price: cents of 90 and more, 5 and less, or 50."""
    gross = F.round(net * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    cents = F.pmod((gross * 100).cast("bigint"), F.lit(100))
    return F.when((cents >= 90) | (cents <= 5) | (cents == 50), gross).otherwise(net.cast("decimal(12,2)"))


# The named entities that titles use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&euro;": "€"}


def html_decode(text: Column) -> Column:
    """Named entities, decimal and hexadecimal numbers below 65536; &amp; last, so nothing is decoded twice."""
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    # Split at numeric references: each part but the first begins with one.
    parts = F.split(F.regexp_replace(out, r"(&#[xX]?[0-9a-fA-F]{1,5};)", "\u0001$1\u0002"), "\u0001", -1)

    def one(part: Column) -> Column:
        code = F.regexp_extract(part, r"^&#([xX]?[0-9a-fA-F]+);\x02", 1)
        number = F.when(code.rlike("^[xX][0-9a-fA-F]+$"), F.conv(F.substring(code, 2, 8), 16, 10)).when(code.rlike("^[0-9]+$"), code).try_cast("int")
        rest = F.regexp_replace(part, r"^&#[xX]?[0-9a-fA-F]+;\x02", "")
        big = F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 4, "0")), "UTF-16BE")
        return F.when((number > 0) & (number < 65536), F.concat(big, rest)).otherwise(F.replace(part, F.lit("\u0002"), F.lit("")))

    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("&amp;"), F.lit("&"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, white space becomes one space. After it
    come the values of data-*, alt, title and placeholder, since sliders keep their texts there."""
    values = F.regexp_extract_all(html, F.lit(r"(?i)\s(?:data-[a-z][a-z0-9_-]*|alt|title|placeholder)\s*=\s*[\"']([^\"'<>]{1,300})[\"']"), F.lit(1))
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), "(?i)&nbsp;", " ")
    return F.trim(F.regexp_replace(F.concat_ws(" ", out, F.array_join(values, " ")), r"[ \t\n\r\f]+", " "))


def url_normalize(url: Column) -> Column:
    """Lower case, no fragment, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "#.*$", ""), "/+$", "")


def url_year(url: Column) -> Column:
    """A two-digit year between marks or at the end of a segment, else a whole year from 2018 to 2029."""
    middle = F.regexp_extract(url, "[_-](2[0-9])[_-]", 1)
    end = F.regexp_extract(url, "[_-](2[0-9])(?:[/?#]|$)", 1)
    full = F.regexp_extract(url, "(?<![A-Za-z0-9_])(20(?:1[89]|2[0-9]))(?![A-Za-z0-9_])", 1)
    return F.when(middle != "", middle.try_cast("int") + 2000).when(end != "", end.try_cast("int") + 2000).when(full != "", full.try_cast("int"))


def url_slug(url: Column) -> Column:
    """The last path segment that is not empty."""
    return F.coalesce(F.try_element_at(F.filter(F.split(url, "/", -1), lambda p: p != ""), F.lit(-1)), F.lit(""))


def url_generations(url: Column) -> Column:
    """Parts 01 to 09 of the slug."""
    return F.filter(F.split(F.replace(url_slug(url), F.lit("_"), F.lit("-")), "-", -1), lambda t: t.rlike("^0[1-9]$"))


def url_version(url: Column, title_year: Column) -> Column:
    """N.M from -N-M- in the slug, unless the title has a year from 2025 on."""
    found = F.regexp_extract(url_slug(url), "[_-]([0-9])[_-]([0-9])[_-]", 0)
    version = F.concat_ws(".", F.substring(found, 2, 1), F.substring(found, 4, 1))
    return F.when((found != "") & ~F.coalesce(title_year >= 2025, F.lit(False)), version)


def weight_range(text: Column, least: int = 280, most: int = 450) -> tuple[Column, Column]:
    """Lowest and highest three-digit weight within bounds; a single one gets 10 either way."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.when(F.length(x) == 3, x.try_cast("int")))
    kept = F.filter(found, lambda x: x.between(least, most))
    low, high = F.array_min(kept), F.array_max(kept)
    return F.when(low == high, low - 10).otherwise(low), F.when(low == high, high + 10).otherwise(high)
