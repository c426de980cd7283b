"""Reference prices, deals and price histories over observations.

Observations: item_id, store_id, price, pct, day, order_key, line_number, confidence, available,
url. Money is summed as decimal and divided once. `as_of` is a parameter of every time window.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealforge.functions.text import round_half_up
from dealforge.functions.urls import url_guard

#: Newest first; the order is total but for equal rows.
NEWEST = ("day", "order_key", "line_number", "price")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark cuts each task's rows to the first before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def latest_per_store(obs: DataFrame) -> DataFrame:
    return first_by(obs, ["item_id", "store_id"], [F.desc(c) for c in NEWEST])


def mean_of(col: str = "price") -> Column:
    return F.sum(col).cast("double") / F.count("*")


def within(obs: DataFrame, as_of: date, days: int) -> DataFrame:
    return obs.filter((F.col("day") <= F.lit(as_of)) & (F.col("day") >= F.date_sub(F.lit(as_of), days)))


def price_summary(rows: DataFrame, estimator: str = "mean") -> DataFrame:
    middle = {"mean": mean_of(), "median": F.median(F.col("price").cast("double"))}[estimator]
    return rows.groupBy("item_id").agg(middle.alias("m"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count("*").alias("n_stores")).select("item_id", round_half_up(F.col("m"), 2).alias("reference_price"), "min_price", "max_price", "n_stores")


def reference_price(obs: DataFrame, as_of: date, days: int = 7, excluded: tuple = (2,), estimator: str = "mean") -> DataFrame:
    """Over the latest available price of each store in the window, without the excluded stores."""
    rows = within(obs, as_of, days).filter(F.col("available") & ~F.col("store_id").isin(*excluded))
    return price_summary(latest_per_store(rows), estimator)


def reference_price_v9(obs: DataFrame, items: DataFrame, as_of: date, days: int = 30, least: float = 0.95, weak: tuple = (2, 9), most_ratio: float = 1.4) -> DataFrame:
    """Certain rows only where they span two stores; weak stores only where no other is left; the
    cheapest of each url; the list price with fewer than two stores or a mean far above it."""
    item = Window.partitionBy("item_id")
    rows = within(obs, as_of, days).filter(F.col("confidence") >= F.lit(least).cast("decimal(3,2)"))
    sure = F.size(F.collect_set(F.when(F.col("confidence") == 1, F.col("store_id"))).over(item))
    rows = rows.withColumn("sure", sure).filter((F.col("sure") < 2) | (F.col("confidence") == 1))
    rows = rows.withColumn("strong", F.max((~F.col("store_id").isin(*weak)).cast("int")).over(item)).filter((F.col("strong") == 0) | ~F.col("store_id").isin(*weak))
    cheapest = rows.groupBy("item_id", "url").agg(F.min(F.struct("price", "store_id")).alias("c")).select("item_id", "c.price", "c.store_id")
    per = cheapest.groupBy("item_id").agg(mean_of().alias("m"), F.countDistinct("store_id").alias("n_stores"))
    listed = F.col("list_price").cast("double")
    weak_mean = (F.col("n_stores") < 2) | (F.col("m") / listed > most_ratio)
    out = per.join(items.select("item_id", "list_price"), "item_id")
    return out.select("item_id", "n_stores", round_half_up(F.when(weak_mean, listed).otherwise(F.col("m")), 2).alias("reference_price"), weak_mean.alias("from_list"))


def reference_price_bulk(obs: DataFrame, as_of: date, days: int = 30, aggregator: int = 2) -> DataFrame:
    """Without the aggregator where another store remains; the cheapest of each url; their mean."""
    rows = within(obs, as_of, days).withColumn("others", F.max((F.col("store_id") != aggregator).cast("int")).over(Window.partitionBy("item_id")))
    rows = rows.filter((F.col("others") == 0) | (F.col("store_id") != aggregator))
    cheapest = rows.groupBy("item_id", "url").agg(F.min("price").alias("price"))
    return cheapest.groupBy("item_id").agg(mean_of().alias("m"), F.count("*").alias("n_urls")).select("item_id", round_half_up(F.col("m"), 2).alias("reference_price"), "n_urls")


def reference_price_anchor(obs: DataFrame, days: int = 7, excluded: tuple = (2,)) -> DataFrame:
    """The window ends at each item's own last day."""
    rows = obs.filter(~F.col("store_id").isin(*excluded)).withColumn("last", F.max("day").over(Window.partitionBy("item_id")))
    return price_summary(latest_per_store(rows.filter(F.col("day") >= F.date_sub("last", days))))


def effective(obs: DataFrame) -> DataFrame:
    return obs.withColumn("effective", (F.col("price") * (1 - F.col("pct"))).cast("decimal(26,8)"))


def live_effective(obs: DataFrame, codes: DataFrame, items: DataFrame) -> DataFrame:
    """The store's live code, where it fits the item's brand, before the row's own code."""
    rows = obs.join(items.select("item_id", "brand"), "item_id").join(codes.select("store_id", "live_pct", "only_brand"), "store_id", "left")
    fits = F.col("live_pct").isNotNull() & (F.col("live_pct") > 0)
    blocked = fits & F.col("only_brand").isNotNull() & (F.lower("only_brand") != F.lower("brand"))
    used = F.when(blocked, F.lit(0).cast("decimal(6,4)")).when(fits, F.col("live_pct")).otherwise(F.coalesce("pct", F.lit(0).cast("decimal(6,4)")))
    return rows.withColumn("used_pct", used.cast("decimal(6,4)")).withColumn("effective", (F.col("price") * (1 - F.col("used_pct"))).cast("decimal(26,8)"))


def cheapest_per_item(obs: DataFrame) -> DataFrame:
    return first_by(effective(obs), ["item_id"], [F.asc("effective"), F.asc("store_id"), F.desc("order_key"), F.desc("line_number")])


def fresh_rows(obs: DataFrame, items: DataFrame, grace_hours: int = 3) -> DataFrame:
    """Observations no newer than their item's reference (items.updated) and the grace, so that an older
    row of a store may stand in for one that the reference has not seen. If none is left, all rows."""
    rows = obs.join(items.select("item_id", "updated"), "item_id", "left")
    rows = rows.withColumn("fresh", F.coalesce(F.col("seen_at") <= F.col("updated") + F.make_dt_interval(hours=F.lit(grace_hours)), F.lit(False)))
    any_fresh = rows.agg(F.coalesce(F.bool_or("fresh"), F.lit(False)).alias("any_fresh"))
    return rows.crossJoin(F.broadcast(any_fresh)).filter(F.col("fresh") | ~F.col("any_fresh")).drop("fresh", "any_fresh", "updated")  # one row


def judged(obs: DataFrame, items: DataFrame, references: DataFrame, codes: DataFrame, now: datetime, hours: int = 48, excluded: tuple = (2,), least_confidence: float = 0.95, least_year: int = 2024, least_stores: int = 3, spread: float = 2.5, wide_spread: float = 4.0, many: int = 5, least_reference: float = 50, floor: float = 0.75, low_floor: float = 0.65, offer: float = 0.75, bargain: float = 0.65) -> DataFrame:
    """Each item's cheapest offer of the window with its reference and, in `reason`, the first guard it fails.

    obs has `seen_at`, a timestamp; items: item_id, brand, model, year, updated; references: item_id,
    reference_price, n_stores, min_price, max_price; codes: as in live_effective().
    """
    since = F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz")
    rows = obs.filter((F.col("seen_at") >= since) & (F.col("seen_at") <= F.lit(now).cast("timestamp_ntz")))
    rows = rows.filter(F.col("available") & (F.col("confidence") >= F.lit(least_confidence).cast("decimal(3,2)")) & ~F.col("store_id").isin(*excluded))
    own = first_by(fresh_rows(rows, items), ["item_id", "store_id"], [F.desc(c) for c in ("seen_at", *NEWEST[1:])])
    priced = live_effective(own, codes, items)
    cheapest = first_by(priced, ["item_id"], [F.asc("effective"), F.asc("store_id")])
    shared = cheapest.groupBy("url").agg(F.count("*").alias("sharing"))
    out = cheapest.join(shared, "url", "left").join(items.select("item_id", "model", "year"), "item_id").join(references, "item_id", "left")
    low, high = F.col("min_price").cast("double"), F.col("max_price").cast("double")
    ref = F.col("reference_price")
    ratio = F.col("effective").cast("double") / ref
    guard = url_guard(F.col("url"), F.col("year"), F.col("model"), F.col("sharing"))
    reason = (
        F.when(F.col("year").isNull() | (F.col("year") < least_year), "year")
        .when(F.col("n_stores").isNull(), "no_reference")
        .when(F.col("n_stores") < least_stores, "few_stores")
        .when((low > 0) & (high / low > F.when(F.col("n_stores") >= many, wide_spread).otherwise(spread)), "spread")
        .when(ref.isNull() | (ref < least_reference), "low_reference")
        .when((low > 0) & (F.col("price").cast("double") / low < F.when(F.col("n_stores") >= 3, floor).otherwise(low_floor)), "under_minimum")
        .when(guard.isNotNull(), F.concat(F.lit("guard_"), guard))
        .when(ratio > offer, "no_discount")
    )
    tag = F.when(reason.isNull(), F.when(ratio <= bargain, "CHOLLO").otherwise("OFERTA"))
    return out.select(
        "item_id", "store_id", "n_stores", round_half_up(F.col("price").cast("double"), 2).alias("price"), round_half_up(F.col("effective").cast("double"), 2).alias("effective_price"), ref.alias("reference_price"), round_half_up((1 - ratio) * 100).alias("discount_pct"), "used_pct", "seen_at", tag.alias("tag"), reason.alias("reason")
    )


def deals(*tables: DataFrame, **limits) -> DataFrame:
    """Bargains before offers, greatest discount first."""
    return judged(*tables, **limits).filter("reason is null").drop("reason").orderBy("tag", F.desc("discount_pct"), "item_id")


def deal_rejections(*tables: DataFrame, **limits) -> DataFrame:
    return judged(*tables, **limits).filter("reason is not null").select("item_id", "store_id", "n_stores", "reason")


def daily_series(obs: DataFrame) -> DataFrame:
    """For each item and day the mean and median price and the least effective one."""
    per = effective(obs).groupBy("item_id", "day").agg(mean_of().alias("m"), F.median(F.col("price").cast("double")).alias("d"), F.min("effective").alias("min_effective"), F.count("*").alias("n"))
    return per.select("item_id", "day", round_half_up(F.col("m"), 2).alias("mean_price"), round_half_up(F.col("d"), 2).alias("median_price"), "min_effective", "n")


def historic_min(obs: DataFrame) -> DataFrame:
    """The least price of each item and the last day that had it."""
    low = obs.groupBy("item_id", "price").agg(F.max("day").alias("last_day"))
    return first_by(low, ["item_id"], [F.asc("price")]).select("item_id", F.col("price").alias("min_price"), "last_day")


def top_stores(obs: DataFrame, n: int = 3) -> DataFrame:
    """The cheapest row of each store, available first; then each item's first n stores."""
    order = [F.desc("available"), F.asc("effective"), F.asc("store_id"), F.desc("order_key"), F.desc("line_number")]
    own = first_by(effective(obs), ["item_id", "store_id"], order)
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("place") <= n).select("item_id", "place", "store_id", "effective", "available")


def collisions(obs: DataFrame, policy: str = "first") -> DataFrame:
    """Rows that lose when several hit one item and store, with their winner; policy first or cheapest."""
    order = {"first": [F.asc("day"), F.asc("order_key"), F.asc("line_number")], "cheapest": [F.asc("price"), F.asc("order_key"), F.asc("line_number")]}[policy]
    w = Window.partitionBy("item_id", "store_id").orderBy(*order)
    rows = obs.withColumn("rn", F.row_number().over(w)).withColumn("winner_order", F.first("order_key").over(w)).withColumn("winner_line", F.first("line_number").over(w))
    return rows.filter("rn > 1").select("item_id", "store_id", "winner_order", "winner_line", F.col("order_key").alias("lost_order"), F.col("line_number").alias("lost_line"))


def coverage(obs: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts over the catalogue: stores an item has and how low its least price is."""
    latest = latest_per_store(obs)
    per = latest.groupBy("item_id").agg(F.count("*").alias("n"), mean_of().alias("ref"), F.min("price").cast("double").alias("low"))
    rows = items.select("item_id").join(per, "item_id", "left")
    ratio = F.col("low") / F.col("ref")
    return rows.agg(F.count("*").alias("items"), F.count_if(F.col("n") >= 2).alias("two_stores"), F.count_if(F.col("n") >= 3).alias("three_stores"), F.count_if(F.col("ref").isNull()).alias("without"), F.count_if(ratio <= 0.70).alias("at_70"), F.count_if(ratio <= 0.82).alias("at_82"))
