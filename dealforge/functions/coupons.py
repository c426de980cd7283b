"""Discount codes in the text of a page, and links to sale sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealforge.functions import text as X
from dealforge.functions import vocabulary as V

NEAR, AROUND, MOST = 80, 150, 50  # letters in which a percentage and a newsletter count, and the greatest percentage
_NEWS = "(?i)newsletter|suscr[ií]bete|suscripci[oó]n|bolet[ií]n"
_WORD = "(?i:c[oó]digo|cup[oó]n|cod)"
#: A code behind its word; a percentage between word and code; a percentage, then `con` and a code.
BEHIND = r"(?<![A-Za-z0-9_])" + _WORD + r"(?![A-Za-z0-9_])\s*:?\s*[\"']?([A-Za-z][A-Za-z0-9]{2,14})(?![A-Za-z0-9_])"
BETWEEN = r"(?<![A-Za-z0-9_])" + _WORD + r"(?![A-Za-z0-9_]).{0,15}?([0-9]{1,2})\s*%([^.!?\n]{0,60})"
WITH = r"(?<![A-Za-z0-9_])([0-9]{1,2})\s*%[^.!?\n]{0,30}(?<![A-Za-z0-9_])(?i:con)\s+([A-Za-z][A-Za-z0-9]{2,14})(?![A-Za-z0-9_])"


def _is_code(code: Column) -> Column:
    return (code == F.upper(code)) & code.rlike("[A-Z]") & ~code.isin(V.NO_CODES)


def _found(text: Column, pattern: str) -> Column:
    """(before, whole, after) of each place of the pattern, 150 letters either way."""
    marked = F.regexp_replace(text, f"({pattern})", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001", -1)
    plain = lambda t: F.replace(t, F.lit("\u0002"), F.lit(""))

    def one(part: Column, i: Column) -> Column:
        before = plain(F.array_join(F.slice(parts, 1, i + 1), ""))
        after = F.concat(F.substring_index(part, "\u0002", -1), plain(F.array_join(F.slice(parts, i + 3, F.size(parts)), "")))
        return F.struct(F.substring(before, -AROUND, AROUND).alias("before"), F.substring_index(part, "\u0002", 1).alias("whole"), F.substring(after, 1, AROUND).alias("after"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)


def detect_coupon(html: Column) -> Column:
    """(code, pct) of the first code on a page by three ways, each over the whole text before the next; null without.

    Codes are capitals and digits, not common shop words; percentages are from 1 to 50. A code
    close to words of a newsletter is none. Of percentages on both sides the nearer counts.
    """
    text = X.html_text(html)
    quiet = lambda f: ~F.concat(f["before"], f["whole"], f["after"]).rlike(_NEWS)
    fits = lambda c: (c["pct"] > 0) & (c["pct"] <= MOST) & c["code"].isNotNull()

    def behind(f: Column) -> Column:
        left, right = F.substring(f["before"], -NEAR, NEAR), F.substring(f["after"], 1, NEAR)
        last = F.regexp_extract(left, r"(?s)^.*(?<![0-9])([0-9]{1,2})\s*%(.*)$", 1)
        gap = F.regexp_extract(left, r"(?s)^.*(?<![0-9])([0-9]{1,2})\s*%(.*)$", 2)
        lead, next_ = F.regexp_extract(right, r"(?s)^(.*?)([0-9]{1,2})\s*%", 1), F.regexp_extract(right, r"(?s)^(.*?)([0-9]{1,2})\s*%", 2)
        pct = F.when((last != "") & ((next_ == "") | (F.length(gap) <= F.length(lead))), last).otherwise(next_).try_cast("int")
        code = F.regexp_extract(f["whole"], BEHIND, 1)
        return F.struct(F.when(_is_code(code) & quiet(f), code).alias("code"), pct.alias("pct"))

    def between(f: Column) -> Column:
        words = F.regexp_extract_all(F.regexp_extract(f["whole"], BETWEEN, 2), F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]{2,14})(?![A-Za-z0-9_])"), F.lit(1))
        code = F.get(F.filter(words, lambda w: ~w.isin(V.NO_CODES)), 0)
        return F.struct(F.when(quiet(f), code).alias("code"), F.regexp_extract(f["whole"], BETWEEN, 1).try_cast("int").alias("pct"))

    def with_(f: Column) -> Column:
        code = F.regexp_extract(f["whole"], WITH, 2)
        return F.struct(F.when(_is_code(code) & quiet(f), code).alias("code"), F.regexp_extract(f["whole"], WITH, 1).try_cast("int").alias("pct"))

    ways = [F.get(F.filter(F.transform(_found(text, p), f), fits), 0) for p, f in ((BEHIND, behind), (BETWEEN, between), (WITH, with_))]
    return F.coalesce(*ways)


# Words of links to sales, and paths that are none.
SALE = r"(?i)rebajas|black-?friday|liquidacion|outlet|oferta|verano|summer|/sale(?:[-_/]|$)"
NO_SALE = "/(blog|content|aviso-legal|politica|condiciones|contactenos|mapa-del-sitio|opiniones|module|login|carrito|cart|checkout)"


def sale_links(html: Column, base: Column, known: Column) -> Column:
    """Distinct absolute links of a page's own site to sale sections, lower-case without query and fragment, but for
    the base and the known ones."""
    origin = F.lower(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1))
    plain = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), r"[?#].*$", ""), "(?<=[^/])/$", "")
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"']"), F.lit(1))
    whole = F.transform(hrefs, lambda h: plain(F.when(h.startswith("/") & ~h.startswith("//"), F.concat(origin, h)).otherwise(h)))
    taken = F.concat(F.array(plain(base)), F.transform(known, plain))
    path = lambda u: F.replace(u, origin, F.lit(""))
    kept = F.filter(whole, lambda u: u.startswith(origin) & path(u).rlike(SALE) & ~path(u).rlike(NO_SALE) & ~F.array_contains(taken, u))
    return F.array_distinct(kept)
