"""Each pipeline stage on null and repeated ids, null, empty and blank texts, an extra column, and an empty table."""

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone int"
TEXT = "the cat sat on the mat and the dog lay down near the door of the house"
ROWS = [(1, TEXT, "en", "a", 70, 1), (1, TEXT, "en", "a", 70, 1), (2, TEXT, None, None, None, 2), (3, None, "de", "b", None, 3), (4, "", "fr", "b", 0, 4), (None, " \n\t ", None, None, None, 5), (None, TEXT, "en", None, None, None)]


@pytest.mark.parametrize("name, stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stage(spark, name, stage):
    odd, none = spark.createDataFrame(ROWS, KIND), spark.createDataFrame([], KIND)
    got = stage(spark, odd, SF)
    assert stage(spark, none, SF).count() == 0
    if name == "packing":
        assert got.count() == len(ROWS)  # one piece each
        return
    assert got.columns == odd.columns
    # Languages: texts without letters go. Lines: none goes as a row. Near duplicates: of equal
    # sets the least id stays with all its rows, as do rows without an id. No benchmark passage.
    assert got.count() == {"language": 4, "line_dedup": 7, "near_duplicates": 6, "decontamination": 7}[name]
    if name == "line_dedup":
        assert got.filter("doc_id = 2").first().text == "" and got.filter("doc_id = 1 and text <> ''").count() == 2
