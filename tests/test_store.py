"""The stored table over batches, replays and lost writers; leases of two holders; cursors over restarts and late pages."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from dealforge.streaming import jobs
from dealforge.streaming import store as S

ROW = "item_id int, store_id int, day date, seq int"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_batches_keep_the_last_row_and_replays_change_nothing(spark, tmp_path):
    rng, path, best = random.Random(1), str(tmp_path / "t"), {}
    batches = [[(rng.randint(0, 5), rng.randint(0, 2), date(2024, 1, rng.randint(1, 4)), rng.randint(0, 99)) for _ in range(12)] for _ in range(6)]
    for n, batch in enumerate(batches):
        for _ in range(2):  # each one twice, as after a failure
            S.store(frame(spark, batch), path, n, ["item_id", "store_id", "day"], [F.desc("seq")], ranked=False)
        for r in batch:
            best[r[:3]] = max(best.get(r[:3], -1), r[3])
        got = S.stored(spark, path).select("item_id", "store_id", "day", "seq").collect()
        assert len(got) == len(best) and {tuple(r)[:3]: r.seq for r in got} == best
    assert all(len(v) <= 2 for v in S.versions(spark, path, "day").values())


def test_only_touched_days_are_written_and_lost_writers_leave_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    S.store(frame(spark, [(1, 1, date(2024, 1, 1), 1), (2, 1, date(2024, 1, 2), 1)]), path, 0, ["item_id"], [F.desc("seq")])
    S.store(frame(spark, [(1, 1, date(2024, 1, 1), 2)]), path, 1, ["item_id"], [F.desc("seq")])
    assert S.versions(spark, path, "day") == {"day=2024-01-01": [1, 0], "day=2024-01-02": [0]}
    frame(spark, [(9, 9, date(2024, 1, 2), 9)]).write.partitionBy("day").parquet(f"{path}/version=2")
    (tmp_path / "t/version=2/_SUCCESS").unlink()
    assert sorted(r.item_id for r in S.stored(spark, path).collect()) == [1, 2]
    S.store(frame(spark, []), path, 3, ["item_id"], [F.desc("seq")])
    assert S.stored(spark, str(tmp_path / "none")) is None and S.versions(spark, path, "day")["day=2024-01-02"] == [0]


def test_ignore_keeps_what_was_first(spark, tmp_path):
    path = str(tmp_path / "t")
    for n, seq in enumerate((5, 9)):
        S.store(frame(spark, [(1, 1, date(2024, 1, 1), seq)]), path, n, ["item_id"], [F.asc("seq")], on_conflict="ignore")
    assert [r.seq for r in S.stored(spark, path).collect()] == [5]


def test_lease_of_two_applications(spark, tmp_path):
    now, folder = [1_000_000.0], f"file://{tmp_path}/leases"
    a, b = (S.Lease(spark.newSession(), folder, "job.one", 60, clock=lambda: now[0]) for _ in range(2))
    assert a.take() and not b.take() and a.take()
    now[0] += 50
    assert a.renew() and not b.take()
    now[0] += 50
    assert not b.take()
    now[0] += 20
    assert b.take() and not a.renew() and not a.take() and b.renew()
    b.release()
    assert S.Lease(spark, folder, "job.one", 60, clock=lambda: now[0]).take()
    assert S.Lease(spark, folder, "job", 60, clock=lambda: now[0]).take()  # another name


def test_only_one_of_two_makes_a_generation(spark, tmp_path):
    lease = S.Lease(spark, f"file://{tmp_path}/l", "x", 60)
    assert lease._create(lease._path(0)) and not lease._create(lease._path(0))


def test_query_starts_only_with_the_lease(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    other = S.Lease(spark, f"file://{tmp_path}/leases", "leased", 3600)
    assert other.take() and jobs.every(stream, "leased", lambda batch, n: None, str(tmp_path / "c"), 1, f"file://{tmp_path}/leases") is None
    other.release()
    query = jobs.every(stream, "leased", lambda batch, n: None, str(tmp_path / "c"), 1, f"file://{tmp_path}/leases")
    try:
        assert query is not None and not other.take()
    finally:
        query.stop()


PAGE = "keyword string, run int, place int, listing_id int, day date"


@pytest.fixture
def pages(spark, tmp_path):
    def add(n, *rows):
        spark.createDataFrame([(k, r, p, i, date(2024, 1, 1 + i % 3)) for k, r, p, i in rows], PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(turn="c"):
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.new_by_cursor(stream, str(tmp_path / "out"), str(tmp_path / turn)).awaitTermination()
        return sorted((r.listing_id, r.keyword, r.run) for r in S.stored(spark, str(tmp_path / "out")).collect())

    return add, run


def test_cursor_stops_over_restarts_and_late_pages(pages):
    add, run = pages
    add(0, ("nox", 1, 0, 12), ("nox", 1, 1, 11), ("siux", 1, 0, 11), ("siux", 1, 1, 10))
    assert run() == [(10, "siux", 1), (11, "nox", 1), (12, "nox", 1)]  # 11 is stored once
    add(1, ("nox", 2, 0, 15), ("nox", 2, 1, 14))  # no known one on the first page; the stream starts again
    assert run()[3:] == [(14, "nox", 2), (15, "nox", 2)]
    add(2, ("nox", 2, 2, 13), ("nox", 2, 3, 12), ("nox", 2, 4, 8))  # the late page has the cursor
    assert run()[2:] == [(12, "nox", 1), (13, "nox", 2), (14, "nox", 2), (15, "nox", 2)]
    add(3, ("nox", 2, 5, 7))  # behind the stop
    add(4, ("nox", 3, 0, 16), ("nox", 3, 1, 14), ("nox", 3, 2, 6))  # 15 was deleted meanwhile
    add(5, ("nox", 2, 6, 5))  # of an older run
    assert [i for i, *_ in run()] == [10, 11, 12, 13, 14, 15, 16]
