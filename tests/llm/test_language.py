"""The rejection of op4: texts in no learned language go, labelled documents stay."""

import base64
import random

import pyarrow as pa
from pyspark.sql import functions as F

from dealforge.llm import language
from dealforge.llm.common import read
from dealforge.llm.textkernel import chunks

ITALIAN = "La mattina dopo il vento era calato e gli uomini del paese scesero alla spiaggia per vedere che cosa il mare avesse lasciato sulla riva durante la notte. "
POLISH = "Następnego ranka wiatr ucichł i mieszkańcy wsi zeszli na plażę, żeby zobaczyć, co morze zostawiło w nocy na brzegu, ale nie znaleźli niczego ważnego. "


def test_foreign_and_random_texts_are_rejected(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = language.train_on(docs, F.lit(True))
    rng = random.Random(1)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80))
    odd = spark.createDataFrame([("it", ITALIAN * 3), ("pl", POLISH * 3), ("random", letters), ("base64", base64.b64encode(rng.randbytes(600)).decode())], "k string, text string")
    got = {r.k: (r.lang_rejected, round(r.lang_score, 3)) for r in language.identify(odd, model).collect()}
    kept = language.identify(docs.filter("lang is not null and text rlike '[A-Za-z]'"), model).agg(F.avg((~F.col("lang_rejected")).cast("double"))).first()[0]
    seen = (got, kept, sorted(set(zip(model.languages, model.reject_below))))
    assert all(r for r, _ in got.values()), seen
    assert kept >= 0.98, seen


def test_short_clean_texts_stay(spark):
    """Sentences of a few words in a learned language are not told from it by a long text's bound."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = language.train_on(docs, F.lit(True))
    words = docs.filter("lang is not null").select(F.explode(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,} [a-z]{2,} [a-z]{2,} [a-z]{2,})"), F.lit(1)), 1, 5)).alias("text"))
    found = language.identify(words, model)
    kept, n = found.agg(F.avg((~F.col("lang_rejected")).cast("double")), F.count("*")).first()
    assert n > 500 and kept >= 0.97, (n, kept, model.short_below.tolist())
    odd = spark.createDataFrame([("Следующим утром ветер стих",), ("翌朝、風は静まり",)], "text string")
    assert language.identify(odd, model).filter("lang_rejected").count() == 2


def test_rows_of_a_slice_are_bounded():
    """Ten thousand texts of a few bytes are counted in slices, not in one matrix; nulls and empty texts count as rows."""
    texts = pa.RecordBatch.from_arrays([pa.array(["ein Satz", None, "", "two words"] * 2500)], names=["text"])
    sizes = [b.num_rows for b in chunks(texts, rows=language.ROWS)]
    assert max(sizes) == language.ROWS and sum(sizes) == 10_000
    assert sum((b.column(0).to_pylist() for b in chunks(texts, rows=language.ROWS)), []) == texts.column(0).to_pylist()
