"""Keyed writes as DataFrames: each returns what is to be written, so a dry run is the default.

Parquet has no merge in place: the caller writes the result to a new path and swaps.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealforge.operators.pricing import first_by


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column], on_conflict: str = "update", ranked: bool = True) -> DataFrame:
    """One row for each key. With `ranked`, new rows replace old ones (update) or yield (ignore);
    else the order alone decides, which makes a replay harmless."""
    side = {"update": 1, "ignore": -1}[on_conflict]
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(side)))
    return first_by(both, keys, ([F.desc("_new")] if ranked else []) + order).drop("_new")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(new.join(current, keys, "left_anti"), keys, order)


def merge_candidates(rows: DataFrame) -> DataFrame:
    """title, low, high, seen, and the union of sources."""
    return rows.groupBy("title").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("seen"), F.array_sort(F.collect_set("source")).alias("sources"))


def guarded(new: DataFrame, current: DataFrame, key: str, states: tuple = ("matched", "ignorada")) -> DataFrame:
    """New rows whose key isn't in a protected state."""
    return new.join(current.filter(F.col("state").isin(*states)), key, "left_anti")


def fill_null(current: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    found = new.groupBy(key).agg(F.min(col).alias("_found"))
    return current.join(found, key, "left").withColumn(col, F.coalesce(col, "_found")).drop("_found")


def deactivate_unseen(active: DataFrame, seen: DataFrame, group: str, keys: list[str], least: float = 0.5) -> DataFrame:
    """Active keys to switch off, in groups that saw at least this share of theirs, and any at all."""
    marked = active.join(seen.select(*keys).withColumn("_seen", F.lit(True)), keys, "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    sure = marked.groupBy(group).agg(F.count_if("_seen").alias("s"), F.count("*").alias("n")).filter((F.col("s") > 0) & (F.col("s") >= F.col("n") * least))
    return marked.filter(~F.col("_seen")).join(sure.select(group), group, "left_semi").select(*keys)


def keep_since(rows: DataFrame, col: str, now: datetime, hours: int) -> DataFrame:
    return rows.filter(F.col(col) >= F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz"))


def rekey(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Duplicates' ids become their survivors'; mapping: item_id, keep_id."""
    m = mapping.select(F.col("item_id").alias(key), "keep_id")
    return rows.join(m, key, "left").withColumn(key, F.coalesce("keep_id", key)).drop("keep_id")


def state_sync(old: DataFrame, new: DataFrame, keys: list[str], step: float = 0.99) -> DataFrame:
    """What happens to each deal: insert, reactivate, expire or keep; notify what is new, back, or much cheaper."""
    o = old.select(*keys, F.col("price").alias("old_price"), "active")
    rows = o.join(new.select(*keys, F.col("price").alias("new_price")), keys, "full")
    on = F.coalesce("active", F.lit(False))
    action = F.when(F.col("old_price").isNull(), "insert").when(F.col("new_price").isNull(), F.when(on, "expire").otherwise("keep")).when(~on, "reactivate").otherwise("keep")
    cheaper = F.col("new_price") < F.col("old_price") * F.lit(step).cast("decimal(4,2)")
    notify = F.col("new_price").isNotNull() & (F.col("old_price").isNull() | ~on | F.coalesce(cheaper, F.lit(False)))
    return rows.withColumn("action", action).withColumn("notify", notify)


def without_backoff(stores: DataFrame, failed: DataFrame, key: str, now: datetime) -> DataFrame:
    return stores.join(failed.filter(F.col("until") > F.lit(now)), key, "left_anti")


def coupon_sync(known: DataFrame, found: DataFrame, key: str = "store_id") -> DataFrame:
    """Codes seen are inserted or updated; codes gone are switched off only if found by machine."""
    rows = known.withColumnRenamed("code", "old").join(found.withColumnRenamed("code", "new"), key, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), F.when(F.col("auto"), "deactivate").otherwise("keep")).when(F.col("new") != F.col("old"), "update").otherwise("keep")
    return rows.select(key, F.coalesce("new", "old").alias("code"), action.alias("action"))


def replace_table(current: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows in place of all old ones; the old ones stay if there is no new row at all."""
    any_new = new.limit(1).agg((F.count("*") > 0).alias("_any"))  # one row
    kept = current.crossJoin(F.broadcast(any_new)).filter(~F.col("_any")).drop("_any")
    return new.unionByName(kept)


def repair_plan(pairs: DataFrame, dependents: tuple = ("snapshots", "aliases", "listings"), target: str = "items") -> DataFrame:
    """(keep_id, item_id, step, statement): for each duplicate the updates of its dependents, then its deletion."""
    q = lambda c: F.col(c).cast("string")
    steps = [F.concat(F.lit(f"UPDATE {t} SET item_id = '"), q("keep_id"), F.lit("' WHERE item_id = '"), q("item_id"), F.lit("';")) for t in dependents]
    steps.append(F.concat(F.lit(f"DELETE FROM {target} WHERE id = '"), q("item_id"), F.lit("';")))
    return pairs.select("keep_id", "item_id", F.posexplode(F.array(*steps)).alias("step", "statement"))


def clamp_reference(references: DataFrame, items: DataFrame, low: float = 0.5, high: float = 1.4) -> DataFrame:
    """references with the list price where theirs is outside low..high times a positive list price; `clamped` says so."""
    rows = references.join(items.select("item_id", F.col("list_price").cast("double").alias("_list")), "item_id", "left")
    out = F.coalesce((F.col("_list") > 0) & ((F.col("reference_price") > F.col("_list") * high) | (F.col("reference_price") < F.col("_list") * low)), F.lit(False))
    return rows.withColumn("clamped", out).withColumn("reference_price", F.when(out, F.col("_list")).otherwise(F.col("reference_price"))).drop("_list")


def sync_prices(top: DataFrame, current: DataFrame, key: str = "listing_id") -> DataFrame:
    """top with the current prices, places as they were; `synced` says which price changed."""
    now = current.groupBy(key).agg(F.max("price").alias("_now"))
    rows = top.join(now, key, "left")
    return rows.withColumn("synced", F.coalesce(F.col("_now") != F.col("price"), F.lit(False))).withColumn("price", F.coalesce("_now", "price")).drop("_now")


def run_metrics(rows: DataFrame, run: list[str], matched: Column, inserted: Column, failed: Column) -> DataFrame:
    """For each run its counts and status: error if rows failed and none was inserted, partial if some failed."""
    per = rows.groupBy(*run).agg(F.count("*").alias("scraped"), F.count_if(matched).alias("matched"), F.count_if(inserted).alias("inserted"), F.count_if(failed).alias("errors"))
    status = F.when((F.col("errors") > 0) & (F.col("inserted") == 0), "error").when(F.col("errors") > 0, "partial").otherwise("success")
    return per.withColumn("status", status)


def rekey_all(snapshots: DataFrame, aliases: DataFrame, candidates: DataFrame, items: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """The four tables after duplicates (mapping: item_id, keep_id) became their survivors.

    Of aliases that meet on (item, store, text) the survivor's own stays, else the first; the survivors'
    list price becomes the mean of their available snapshots, in cents.
    """
    moved = rekey(snapshots, mapping, "item_id")
    own = aliases.withColumn("_moved", F.col("item_id")).transform(lambda d: rekey(d, mapping, "item_id")).withColumn("_moved", F.col("_moved") != F.col("item_id"))
    own = first_by(own, ["item_id", "store_id", "alias"], [F.asc("_moved"), F.asc("alias_id")]).drop("_moved")
    mean = moved.filter("available").join(mapping.select(F.col("keep_id").alias("item_id")).distinct(), "item_id", "left_semi").groupBy("item_id").agg((F.sum("price").cast("double") / F.count("*")).alias("_m"))
    left = items.join(mapping.select("item_id"), "item_id", "left_anti").join(mean, "item_id", "left")
    price = F.when(F.col("_m").isNotNull(), (F.floor(F.col("_m") * 100 + 0.5) / 100).cast("decimal(10,2)")).otherwise(F.col("list_price"))
    return {"snapshots": moved, "aliases": own, "candidates": rekey(candidates, mapping, "item_id"), "items": left.withColumn("list_price", price).drop("_m")}


def merge_into_candidates(current: DataFrame, new: DataFrame) -> DataFrame:
    """Stored candidates with new sightings merged in: the union of sources, least and greatest price, counter
    plus one for each sighting. current: title, low, high, seen, sources; new: title, price, source."""
    found = merge_candidates(new)
    both = current.select("title", "low", "high", "seen", "sources").unionByName(found.select("title", "low", "high", "seen", "sources"))
    return both.groupBy("title").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("seen").alias("seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def count_up(current: DataFrame, events: DataFrame) -> DataFrame:
    """Counters (key, n) with one more for each event of a key; keys not seen before are inserted."""
    return current.select("key", "n").unionByName(events.groupBy("key").agg(F.count("*").alias("n"))).groupBy("key").agg(F.sum("n").alias("n"))
