"""Guards against product pages that show another product than the one matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealforge.functions import text as X

# Pieces of a url and of a model that clash.
URL_CLASHES = (
    ("counter-origin", "counter veron"), ("counter-viper", "counter veron"), ("extreme-motion", "extreme tour"), ("counter-viper-apt", "counter viper"),
    ("arrow-hit-hexagon", "arrow hit"), ("match-light-3-2", "match light 2026"), ("cross-it-light", "cross it light 2026"), ("x-one-c6", "x-one 2025"),
    ("lapi-edition", "tournament pro iconic"),
)
CODE_HOST = "padelproshop.com"


def url_guard(url: Column, year: Column, model: Column, shared_by: Column, clashes: tuple = URL_CLASHES, code_host: str = CODE_HOST) -> Column:
    """The letter of the first guard that a product page fails, else null: A year in the url, B
    two-digit year in its last part, C url of several items, D url and model clash, E store code."""
    low = F.lower(url)
    slug = X.url_slug(low)
    full, short = F.regexp_extract(low, "20([0-9]{2})", 0), F.regexp_extract(slug, "-(19|2[0-9])-(?![0-9]{3,})", 1)
    code = F.regexp_extract(low, "-2([0-9]{2})(?:[^0-9]|$)", 1)
    code_year = code.try_cast("int") + 2000
    d = reduce(lambda a, b: a | b, [low.contains(u) & F.lower(F.coalesce(model, F.lit(""))).contains(m) for u, m in clashes], F.lit(False))
    return (
        F.when((full != "") & (full.try_cast("int") != year), "A")
        .when((full == "") & (short != "") & (short.try_cast("int") + 2000 != year), "B")
        .when(shared_by > 1, "C")
        .when(d, "D")
        .when(low.contains(code_host) & code_year.between(2018, 2030) & (code_year != year), "E")
    )
