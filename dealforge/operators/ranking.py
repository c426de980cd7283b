"""Listings: search, exclusions, opportunity ranking, price drops and patterns, alerts."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.functions.text import tokens
from dealforge.operators.pricing import first_by

#: Classes of condition that a search may name.
CONDITIONS = {"like_new": ["new", "as_good_as_new"], "used": ["good", "fair"]}
# Conditions that may be an opportunity.
OPPORTUNITY_CONDITIONS = ("new", "un_opened", "as_good_as_new", "Nuevo con etiqueta", "Nuevo sin etiqueta")
# Shown names, points by model year, by age in days and by kind.
LABELS = {"new": "Nuevo", "as_good_as_new": "Como nuevo", "good": "Bueno"}
YEAR_POINTS = {2026: 10, 2025: 5, 2024: 2, 2023: -5, 2022: -15, 2021: -20}
NO_YEAR, OLD_YEAR = -10, -25
AGE_POINTS = [(45, -60), (30, -40), (21, -25), (14, -15), (7, -5)]
NEW_POINTS, LIKE_POINTS, SAVING_POINTS = 8, 8, 0.1


def keyword_search(rows: DataFrame, words: list[str], conditions: list[str] | None = None, low=None, high=None, limit: int | None = None) -> DataFrame:
    """Titles with every word, cheapest first; condition classes are expanded."""
    out = rows.filter(reduce(lambda a, b: a & b, [F.lower("title").contains(w.lower()) for w in words], F.lit(True)))
    if conditions:
        out = out.filter(F.col("condition").isin([c for k in conditions for c in CONDITIONS.get(k, [k])]))
    out = out.filter(F.col("price") >= low) if low is not None else out
    out = out.filter(F.col("price") <= high) if high is not None else out
    out = out.orderBy("price", "listing_id")
    return out.limit(limit) if limit else out


def exclusion_reason(title: Column, classes: list[tuple[str, str]]) -> Column:
    """The name of the first class whose pattern the lower-cased title has, else null."""
    low = F.lower(title)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in classes])


def without_used(rows: DataFrame, words: list[str], least_year: int) -> DataFrame:
    year = F.regexp_extract("title", "20[0-9][0-9]", 0).try_cast("int")
    return rows.filter(~F.lower("title").rlike("|".join(words)) & ~F.coalesce(year < least_year, F.lit(False)))


def condition_label(code: Column, default: str = "Usado") -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.when(code.isNotNull(), F.try_element_at(table, code)), F.lit(default))


def phrase_join(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Listings with each phrase, of three characters at least, that their title contains. Titles
    meet phrases by these first three, so the join has an equi key and needs no broadcast."""
    keyed = phrases.withColumn("key", F.substring("phrase", 1, 3))
    starts = F.sequence(F.lit(1), F.greatest(F.length("title") - 2, F.lit(1)))
    keys = rows.withColumn("key", F.explode(F.array_distinct(F.transform(starts, lambda i: F.lower("title").substr(i, F.lit(3))))))
    return keys.join(keyed, "key").filter(F.lower("title").contains(F.col("phrase"))).drop("key")


def opportunities(rows: DataFrame, phrases: DataFrame, now: datetime, days: int = 7, threshold: float = 0.75, least: int = 5, least_price: float = 30) -> DataFrame:
    """listing_id, its best phrase and score: like-new listings of the last days well under their phrase's median.

    The discount is rounded before it is summed. The year is the linked product's (column product),
    or else the phrase's, since sellers' titles have wrong ones.
    """
    recent = F.col("ts") >= F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
    met = phrase_join(rows.filter(recent & F.col("condition").isin(CONDITIONS["like_new"]) & (F.col("price") >= least_price)), phrases)
    price = F.col("price").cast("double")
    medians = met.groupBy("phrase").agg(F.median(price).alias("med"), F.count("*").alias("n")).filter(F.col("n") >= least)
    low = met.join(medians, "phrase").filter(price < F.col("med") * threshold)
    year = F.regexp_extract(F.coalesce("product", "phrase"), "20[0-9][0-9]", 0).try_cast("int")
    by_year = F.try_element_at(F.create_map(*[F.lit(x) for pair in YEAR_POINTS.items() for x in pair]), year)
    seconds = F.unix_timestamp(F.lit(now)) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    age = F.floor(seconds / 86400)
    by_age = reduce(lambda w, p: w.when(age > p[0], p[1]), AGE_POINTS[1:], F.when(age > AGE_POINTS[0][0], AGE_POINTS[0][1])).otherwise(0)
    score = F.floor((F.col("med") - price) / F.col("med") * 100 + 0.5) + SAVING_POINTS * (F.col("med") - price) + F.when(year.isNull(), NO_YEAR).otherwise(F.coalesce(by_year, F.lit(OLD_YEAR))) + F.when(F.col("condition") == "new", NEW_POINTS).otherwise(0) + by_age + LIKE_POINTS * F.log1p(F.coalesce("likes", F.lit(0)).cast("double"))
    scored = low.select("listing_id", "phrase", F.floor(score + 0.5).cast("bigint").alias("score"))
    return first_by(scored, ["listing_id"], [F.desc("score"), F.asc("phrase")])


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their place; only these are numbered."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def trend(now: DataFrame, before: DataFrame, key: str = "listing_id") -> DataFrame:
    out = now.join(before, key, "left")
    label = F.when(F.col("previous").isNull(), "new").when(F.col("place") < F.col("previous"), "up").when(F.col("place") > F.col("previous"), "down").otherwise("same")
    return out.withColumn("moved", F.col("previous") - F.col("place")).withColumn("trend", label)


def price_drops(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.withColumn("previous", F.lag("value").over(w)).filter("value < previous")


def price_patterns(events: DataFrame, zone: str = "Europe/Madrid", least_days: int = 14) -> DataFrame:
    """For each store: rows, items, days, drops, and the local hour and weekday (Sunday 0) with most drops."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts").cast("timestamp_ntz"))
    rows = events.select("event_type", "user_id", local.alias("local"), F.coalesce(F.col("value") < F.lag("value").over(w), F.lit(False)).alias("fell"))
    per = rows.groupBy(F.col("event_type").alias("store")).agg(F.count("*").alias("observations"), F.countDistinct("user_id").alias("items"), F.countDistinct(F.to_date("local")).alias("days"), F.count_if("fell").alias("drops"))
    drops = rows.filter("fell").select(F.col("event_type").alias("store"), F.hour("local").cast("bigint").alias("top_hour"), (F.dayofweek("local") - 1).cast("bigint").alias("top_weekday"))
    for c in ("top_hour", "top_weekday"):
        most = drops.groupBy("store", c).agg(F.count("*").alias("n")).groupBy("store").agg(F.max_by(c, F.col("n") * 100 - F.col(c)).alias(c))
        per = per.join(most, "store", "left")
    return per.withColumn("reliable", F.col("days") >= least_days)


def under_reference(rows: DataFrame, share: float, sure: float | None = None) -> DataFrame:
    """Rows at `share` of their reference or less; with `sure`, only those whose match has that confidence or more."""
    rows = rows if sure is None else rows.filter(F.col("confidence") >= sure)
    return rows.filter(F.col("price").cast("double") <= F.col("reference") * share)


CLASS = ["words", "condition"]


def alert_classes(alerts: DataFrame) -> DataFrame:
    """alert_id, words (sorted, distinct), condition, max_price: which class each alert is of.

    Alerts that ask for the same words and condition are one class, whatever their price. An alert without words asks for nothing
    and has no class.
    """
    words = F.array_sort(F.array_distinct(tokens(F.col("query"))))
    return alerts.select("alert_id", words.alias("words"), "condition", "max_price").filter(F.size("words") > 0)


def alert_matches(alerts: DataFrame, rows: DataFrame, told: DataFrame) -> DataFrame:
    """words, condition, listing_id, price, n_alerts: what each class of alerts has found, and for how many of them.

    A title has all words of the query, whole; the condition is equal, where one is asked for; the price is max_price or
    less, where there is one. Pairs (alert_id, listing_id) in `told` count no more, and a listing that is news for no
    alert is left out. alerts: alert_id, query, condition, max_price; rows: listing_id, title, price, condition.

    A class meets listings on its rarest word only. Prices of listings and limits of alerts are merged in one run along
    each class's distinct prices, so no list of alerts is made, and the result holds no alert ids: alert_classes() tells
    whose class it is.
    """
    titled = rows.select("listing_id", "price", F.col("condition").alias("had"), F.array_distinct(tokens(F.col("title"))).alias("tw"))
    worded = titled.select("listing_id", "price", "had", "tw", F.explode("tw").alias("word"))
    often = worded.groupBy("word").agg(F.count("*").alias("n"))
    members = alert_classes(alerts)
    limits = members.groupBy(*CLASS, "max_price").agg(F.count("*").alias("n"))
    classes = members.select(*CLASS).distinct().select(*CLASS, F.explode("words").alias("word")).join(often, "word", "left")
    classes = classes.groupBy(*CLASS).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).filter("r.n > 0").select(*CLASS, F.col("r.word").alias("word"))
    fits = (F.size(F.array_except("words", "tw")) == 0) & (F.col("condition").isNull() | F.coalesce(F.col("condition") == F.col("had"), F.lit(False)))
    met = worded.join(classes, "word").filter(fits & F.col("price").isNotNull()).select(*CLASS, "listing_id", "price")
    # Both kinds of row in one order: a limit stands before prices equal to it, from the highest down.
    marks = limits.select(*CLASS, F.col("max_price").alias("at"), "n", F.lit(0).alias("side")).unionByName(met.select(*CLASS, F.col("price").alias("at")).distinct().withColumns({"n": F.lit(0).cast("bigint"), "side": F.lit(1)}))
    down = Window.partitionBy(*CLASS).orderBy(F.desc_nulls_first("at"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = marks.withColumn("n_alerts", F.sum("n").over(down)).filter("side = 1").select(*CLASS, F.col("at").alias("price"), "n_alerts")
    found = met.join(reach.select(*[F.col(c).alias("r_" + c) for c in (*CLASS, "price")], "n_alerts"), (F.col("words") == F.col("r_words")) & F.col("condition").eqNullSafe(F.col("r_condition")) & (F.col("price") == F.col("r_price"))).select(*CLASS, "listing_id", "price", "n_alerts")
    heard = told.select("alert_id", "listing_id").distinct().join(members, "alert_id").join(titled.select("listing_id", "price"), "listing_id").filter(F.col("max_price").isNull() | (F.col("price") <= F.col("max_price")))
    heard = heard.groupBy(F.col("words").alias("h_words"), F.col("condition").alias("h_condition"), F.col("listing_id").alias("h_id")).agg(F.count("*").alias("heard"))
    out = found.join(heard, (F.col("words") == F.col("h_words")) & F.col("condition").eqNullSafe(F.col("h_condition")) & (F.col("listing_id") == F.col("h_id")), "left")
    return out.withColumn("n_alerts", F.col("n_alerts") - F.coalesce("heard", F.lit(0))).filter("n_alerts > 0").select(*CLASS, "listing_id", "price", "n_alerts")


def favourite_drops(favourites: DataFrame, prices: DataFrame, told: DataFrame) -> DataFrame:
    """(user_id, item_id, price): favourites at their wanted price or less, not told before at that price or a lower one."""
    low = prices.groupBy("item_id").agg(F.min("price").alias("price"))
    past = told.groupBy("user_id", "item_id").agg(F.min("price").alias("told"))
    rows = favourites.join(low, "item_id").filter(F.col("price") <= F.col("wanted")).join(past, ["user_id", "item_id"], "left")
    return rows.filter(F.col("told").isNull() | (F.col("price") < F.col("told"))).select("user_id", "item_id", "price")


def drop_histogram(events: DataFrame, zone: str = "Europe/Madrid") -> DataFrame:
    """(store, kind, slot, drops): price drops by local hour and by local weekday (Sunday 0)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts").cast("timestamp_ntz"))
    rows = price_drops(events).select(F.col("event_type").alias("store"), local.alias("local"))
    slots = F.array(F.struct(F.lit("hour").alias("kind"), F.hour("local").alias("slot")), F.struct(F.lit("weekday").alias("kind"), (F.dayofweek("local") - 1).alias("slot")))
    return rows.select("store", F.explode(slots).alias("s")).groupBy("store", "s.kind", F.col("s.slot").cast("bigint").alias("slot")).agg(F.count("*").alias("drops"))


def search_flags(rows: DataFrame, share: float = 0.75, least: int = 5, floor: float = 10, conditions: tuple[str, ...] = OPPORTUNITY_CONDITIONS) -> DataFrame:
    """rows with `opportunity`: whether a like-new row of `floor` or more costs less than `share` of the median
    of all such rows of the result, if there are `least` of them. A null price or condition is none. One pass for the median, one row broadcast."""
    valid = F.coalesce(F.col("condition").isin(*conditions) & (F.col("price") >= floor), F.lit(False))
    med = rows.filter(valid).agg(F.median(F.col("price").cast("double")).alias("_med"), F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(med)).withColumn("opportunity", valid & F.coalesce((F.col("_n") >= least) & (F.col("price").cast("double") < F.col("_med") * share), F.lit(False))).drop("_med", "_n")
