"""Structured Streaming jobs. Each has a batch twin among the operators, checked against SQL.

All take a streaming frame and return a query or frame; the caller starts it with a checkpoint
folder on storage that the cluster shares. AvailableNow catches up and stops.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from dealforge.streaming.store import Lease, store, stored


def new_listings(stream: DataFrame, id_col: str = "listing_id", ts_col: str = "ts", late: str = "48 hours") -> DataFrame:
    """Each id once; ids are forgotten when the watermark has passed them."""
    return stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late).dropDuplicatesWithinWatermark([id_col])


def daily_mean(stream: DataFrame, ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Mean price by item and day, in windows of a day."""
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)
    return timed.groupBy("item_id", F.window(ts_col, "1 day")).agg((F.sum("price").cast("double") / F.count("*")).alias("mean_price"), F.count("*").alias("n"))


def daily_upsert(stream: DataFrame, path: str, checkpoint: str, keys: tuple = ("item_id", "store_id", "day"), order: str = "seq") -> StreamingQuery:
    """Keeps the row of greatest `order` of each key in a table in days (store.py), of which a batch rewrites only
    those that it touches."""

    def write(batch: DataFrame, number: int) -> None:
        store(batch, path, number, list(keys), [F.desc(order)], "day", ranked=False)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that daily_upsert() keeps; None before its first batch."""
    return stored(spark, path, "day")


HEADS = 50  # ids that a cursor holds
CURSOR = "run bigint, stop bigint, heads array<struct<place:bigint,id:bigint>>, known array<bigint>"


def until_cursor(stream: DataFrame) -> DataFrame:
    """(keyword, run, place, listing_id, day): of each keyword and run, newest first, what stands before the first id that the run before
    had among its first HEADS: the cursor.

    stream: keyword, run, place (from 0, the newest), listing_id, day. Pages of a run may come in any order and in later
    batches: what stands behind the stop is dropped then too, and what a later page shows to stand behind a stop found since was
    given out already, as it was new when it came. Pages of a run that come after one of a later run are dropped. The state of a keyword is its
    run, the stop, the first ids of the run and those of the run before. The first run of a keyword has no stop.
    """

    def update(key: tuple, frames, state: GroupState):
        run, stop, heads, known = state.get if state.exists else (-1, -1, [], [])
        heads = [(h[0], h[1]) for h in heads]
        rows, out = pd.concat(list(frames)).sort_values(["run", "place"]), []
        for current, page in rows.groupby("run", sort=True):
            if current < run:
                continue
            if current > run:
                known, run, stop, heads = [i for _, i in heads] or known, int(current), -1, []
            hits = page.loc[page["listing_id"].isin(known), "place"]
            if len(hits):
                stop = int(hits.min()) if stop < 0 else min(stop, int(hits.min()))
            heads = sorted({*heads, *zip(page["place"].tolist(), page["listing_id"].tolist())})[:HEADS]
            out.append(page if stop < 0 else page[page["place"] < stop])
        state.update((run, stop, heads, list(known)))
        if out:
            yield pd.concat(out)[["keyword", "run", "place", "listing_id", "day"]]

    rows = stream.select("keyword", F.col("run").cast("bigint"), F.col("place").cast("bigint"), F.col("listing_id").cast("bigint"), F.col("day").cast("date"))
    return rows.groupBy("keyword").applyInPandasWithState(update, "keyword string, run bigint, place bigint, listing_id bigint, day date", CURSOR, "append", GroupStateTimeout.NoTimeout)


def new_by_cursor(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores each listing once, whichever keyword found it first, in a table in days of the listings (store.py)."""

    def write(batch: DataFrame, number: int) -> None:
        store(batch, path, number, ["listing_id"], [F.asc("run"), F.asc("keyword"), F.asc("place")], "day", on_conflict="ignore")

    return until_cursor(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DEAL_STATE = "item_id bigint, store_id bigint, action string, price double"


def deal_states(stream: DataFrame, step: float = 0.99) -> DataFrame:
    """Actions of deals as sightings arrive: (item_id, store_id, action, price); action is insert, reactivate,
    cheaper or expire.

    stream: item_id, store_id, run, price, where a null price says that run found the deal gone. Of one
    run's sightings of a deal the least price counts; a run at or before the last one seen is ignored, so that a
    replay changes nothing. The state of a deal is its last run, whether it is active, and its last price.
    """

    def update(key: tuple, frames, state: GroupState):
        run, active, last = state.get if state.exists else (-1, False, float("nan"))
        seen = state.exists
        out = []
        rows = pd.concat(list(frames)).sort_values(["run", "price"])
        for r, price in zip(rows["run"], rows["price"]):
            if r <= run:
                continue
            run = int(r)
            if pd.isna(price):
                if active:
                    out.append(("expire", last))
                active = False
                continue
            action = "insert" if not seen else "reactivate" if not active else "cheaper" if price < last * step else None
            if action:
                out.append((action, float(price)))
            seen, active, last = True, True, float(price)
        if seen:
            state.update((run, active, last))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["item_id", "store_id", "action", "price"])

    rows = stream.select(F.col("item_id").cast("bigint"), F.col("store_id").cast("bigint"), F.col("run").cast("bigint"), F.col("price").cast("double"))
    return rows.groupBy("item_id", "store_id").applyInPandasWithState(update, DEAL_STATE, "run bigint, active boolean, last double", "append", GroupStateTimeout.NoTimeout)


def every(stream: DataFrame, name: str, sink, checkpoint: str, hours: float, leases: str | None = None) -> StreamingQuery | None:
    """Starts `sink` on each batch every so many hours, under a name; nothing if a query of that name is running
    in this application or, with a folder of `leases` on shared storage, in any.

    The lease lasts for three triggers and is renewed by each batch; a batch that finds it lost fails, which ends the query.
    """
    spark = stream.sparkSession
    if any(q.name == name and q.isActive for q in spark.streams.active):
        return None
    lease = Lease(spark, leases, name, 3 * hours * 3600) if leases else None
    if lease and not lease.take():
        return None

    def held(batch: DataFrame, number: int) -> None:
        if lease and not lease.renew():
            raise RuntimeError(f"another application runs {name}")
        sink(batch, number)

    return stream.writeStream.queryName(name).foreachBatch(held).option("checkpointLocation", checkpoint).trigger(processingTime=f"{round(hours * 3600)} seconds").start()
