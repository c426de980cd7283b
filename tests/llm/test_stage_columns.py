"""Stages leave every column alone, whatever its name, and judge rows that share an id by their own text."""

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["lang_rejected", "lang_pred", "_th", "_at", "_lines", "_n_lines", "_gone", "_kept", "_key", "_id", "own_th", "gone_id", "gone_th", "n", "component_id", "a b.c"]


def test_clashing_columns_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("text").rlike("[a-z]"))
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in NAMES})
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, wide, SF)
        assert kept.columns == wide.columns, name
        rows = kept.collect()
        assert rows, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in NAMES), name
        plain = stage(spark, docs, SF)
        assert sorted(r.doc_id for r in plain.collect()) == sorted(r.doc_id for r in rows), name


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(3, text), (5, text + " more"), (5, other), (None, text), (None, other + " x"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in P.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(False, 3, text), (False, 5, other), (False, 9, None), (False, 9, ""), (True, 0, text), (True, 0, other + " x")], key=str)
    assert P.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0
