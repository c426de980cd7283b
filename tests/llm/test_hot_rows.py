"""Bounds and groups under hot keys: repeated ids of labelled rows, groups of copies that hold most rows, likeness by an independent digest."""

import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from dealforge.llm import fingerprint, quality, queries


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_SAMPLE", 100)
    docs = spark.range(6000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same").alias("text")))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (2, 1)], "doc_id bigint, quality int")
    got = quality.labelled_sample(docs, labels, F.lit(True)).collect()
    assert 40 <= len(got) <= 200 and len({r.id for r in got}) > 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, quality.labelled_sample(docs.repartition(3), labels, F.lit(True)).collect()))


def test_all_rows_where_few(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality.labelled_sample(docs, labels, F.lit(True)).collect()), key=str) == [(1, "a", 1), (1, "a", 1), (2, None, 0)]


def test_groups_where_one_holds_half_of_the_rows(spark):
    rows = [(n, "Copy  text" if n % 2 else f"own {n // 6}", "x", "y") for n in range(1, 400)] + [(None, "copy text", "x", "y"), (None, "lone", "x", "y"), (7, "lone two", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own string, key string")
    for share in (1000, 2):  # with and without groups small enough for a join
        fingerprint.HOT_SHARE = share
        got = fingerprint.exact_groups(docs).collect()
        fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
        size = Counter(fold(r[1]) for r in rows)
        least = {t: min((r[0] for r in rows if fold(r[1]) == t and r[0] is not None), default=None) for t in size}
        assert Counter((r.doc_id, r.group_id, r.group_size) for r in got) == Counter((r[0], least[fold(r[1])], size[fold(r[1])]) for r in rows)
    fingerprint.HOT_SHARE = 1000


def test_likeness_by_an_independent_digest(spark, tmp_path):
    """near_edited and near_next are 1 just where the canonical texts are equal, by plain Python."""
    texts = ["Aa", "aa", "x", "x x", "  x  X ", "", None, "abcd", "ab", "ab", "é", "É"]
    rows = [(n, t) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split())
    got = {r.doc_id: (r.near_edited, r.near_next) for r in queries.op8_fingerprints(spark, str(tmp_path)).collect()}
    for n, text in rows:
        own, other = text or "", (texts[n - 1] if n else texts[-1]) or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert got[n] == (float(fold(own) == fold(edited)), float(fold(own) == fold(other)))
