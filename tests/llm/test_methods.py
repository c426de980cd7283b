"""The methods themselves against plain Python: cosines, FTRL updates, equal buckets, neighbours, components."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealforge.llm import components, fingerprint, language, lines, packing, quality, queries, tokens


def trigrams(text):
    """Counts of hashed byte trigrams around letters, as the model defines them."""
    data = (text or "").encode()
    b = []
    for i, c in enumerate(data):
        small = c + 32 if 65 <= c <= 90 else c
        letter = 97 <= small <= 122 or c >= 128
        v = small if letter else 0
        if i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E:
            v += 0x20
        b.append(v)
    found = Counter()
    for i, v in enumerate(b):
        if v:
            code = (b[i - 1] if i else 0) * 65536 + v * 256 + (b[i + 1] if i + 1 < len(b) else 0)
            found[(code * 2654435761 % 2**32) >> (32 - language.BITS)] += 1
    return found


def test_language_cosine_by_hand():
    rng = np.random.default_rng(3)
    centres = np.abs(rng.normal(size=(4, language.SIZE))).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    idf = (1 + rng.random(language.SIZE)).astype(np.float32)
    model = language.Centroids(["a", "a", "b", "c"], centres, idf, np.array([0.0, 0.0, 0.9, 0.0]))
    texts = ["Hello WORLD, hello", "ÉCOLE été", "a", "123 ...", None, "Привет"]
    names, scores, rejected = model.predict(pa.array(texts))
    for text, name, score, no in zip(texts, names, scores, rejected):
        tf = trigrams(text)
        if not any(c.isalpha() for c in text or ""):
            assert (name, score, no) == ("und", 0, True)
            continue
        x = {k: math.log1p(n) * float(idf[k]) for k, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in centres]
        best = max(range(4), key=cosines.__getitem__)
        assert name == model.languages[best] and score == pytest.approx(cosines[best], abs=1e-5)
        assert no == (cosines[best] < model.reject_below[best])


def test_language_ties_take_the_first_centroid():
    centres = np.ones((2, language.SIZE), np.float32) / math.sqrt(language.SIZE)
    names, _, _ = language.Centroids(["x", "y"], centres, np.ones(language.SIZE, np.float32), np.zeros(2)).predict(pa.array(["some text"]))
    assert names == ["x"]


def test_ftrl_by_hand(spark):
    rows = [(i, f"good fine text {i}" if i % 2 else f"BAD!! {i} $$", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, label int")
    got = quality.train(df)
    feats = [(dict(zip(at.tolist(), x.tolist())), y) for (at, x), (_, _, y) in zip(quality.features(pa.array([t for _, t, _ in rows])), rows)]
    z, n = Counter(), Counter()

    def w(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(feats)):
            x, y = feats[i]
            now = {k: w(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(now[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * now[k]
                n[k] += g * g
    for k in n:
        assert got[k] == pytest.approx(w(k), rel=1e-4, abs=1e-6)
    assert np.count_nonzero(got) <= len(n)
    scored = {r.id: r.score for r in quality.score(df, got, "id").collect()}
    for i, (x, _) in enumerate(feats):
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-sum(float(got[k]) * v for k, v in x.items()))), abs=1e-6)


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    rows = [(1, "a b"), (2, "A  B"), (3, "c"), (4, "d"), (5, "d"), (None, "d"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = lambda canon: "same" if canon in (b"a b", b"c") else hashlib.md5(canon).hexdigest()
    assert fingerprint.collisions(df, wide=one) == {"same"} and fingerprint.collisions(df) == frozenset()
    got = [(r.doc_id, r.group_id, r.group_size) for r in fingerprint.exact_groups(df, wide=one).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 2), (7, 6, 2), (None, 4, 3)]
    assert len({r.fingerprint for r in fingerprint.exact_groups(df, wide=one).collect()}) == 4


def test_next_rows_with_null_and_repeated_ids(spark):
    def make(rows, following):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([f[1] for f in following])], names=["doc_id", "own", "next"])

    rows = [(i, f"t{i}") for i in range(300)] + [(None, "n1"), (None, "n1"), (7, "other"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = fingerprint.with_next(df, make, "doc_id bigint, own string, next string").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.own) for r in got)) == sorted((i is None, i or 0, t or "") for i, t in rows)
    # Each row follows one other, in one ring; ids never rise but at its end.
    assert Counter(r.own for r in got) == Counter(r.next for r in got)
    by_text = {r.own: r.next for r in got}
    assert by_text["t299"] == "t298" and by_text["t1"] == "t0" and by_text["t0"] == "n1"
    assert sorted(r.next for r in got if r.own == "n1") == ["n1", "t299"]
    assert fingerprint.with_next(df.limit(0), make, "doc_id bigint, own string, next string").count() == 0
    alone = fingerprint.with_next(df.limit(1), make, "doc_id bigint, own string, next string").collect()
    assert len(alone) == 1 and alone[0].own == alone[0].next


def test_components_of_a_long_chain(spark):
    edges = spark.range(700).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(edges.repartition(3))
    assert got.count() == 701 and got.select("component").distinct().collect()[0][0] == 0


def test_token_stretches_add_up():
    text = "one two  three ▁ four " * 2000
    parts = list(tokens.stretches(text, 1000))
    assert len(parts) > 10 and " ".join(parts) == text
    count = tokens.token_counter(queries.vocabulary(queries.COUNT_MODEL))
    assert sum(count([p])[0] for p in parts) == count([text])[0] == sum(count(parts))


def test_packing_says_when_it_stops_early():
    with pytest.warns(UserWarning, match="padding"):
        packing.column_generation(np.array([30, 45, 70]), np.array([50.0, 40.0, 30.0]), 100, rounds=1)


LONG = 1_300_000  # bytes, over every slice that the operators take


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(11)
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'aeiouaeiou'[i // 100 % 10]}{i}" for i in range(3000)]
    text = " ".join(words[i] for i in rng.integers(0, 3000, LONG // 7))
    text = "\n".join(text[i : i + 400] for i in range(0, len(text), 400))
    near = text.replace("a", "b", 40)
    return text, spark.createDataFrame([(1, text, "en"), (2, near, "en"), (3, "short one " + " ".join(text.split()[500:520]), "de"), (4, text, "en")], "doc_id bigint, text string, lang string").repartition(1)


def test_very_long_texts(spark, long_docs):
    from tokenizers import Tokenizer

    import sentencepiece
    from dealforge.llm import decontaminate, jaccard

    text, df = long_docs
    items = spark.createDataFrame([("i", " ".join(text.split()[505:517]))], "item_id string, text string")
    hit = {r.doc_id: (r.n_words, r.contaminated) for r in decontaminate.contamination(df, items).collect()}
    assert hit[1] == hit[4] and hit[1][1] and hit[3][1]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.COUNT_MODEL))
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, queries.vocabulary(queries.COUNT_MODEL)).collect()}
    assert got[1] == len(model.encode(text, num_threads=1)) == got[4]
    path = queries.vocabulary(queries.PACK_MODEL)
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    pieces = packing.pack(df, path).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == len(ids) + 1 == pieces[0].doc_tokens and len(pieces) > 100
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    kept = {r.doc_id: r for r in lines.line_dedup(df).collect()}
    assert kept[1].text == text and kept[4]._n_dropped == kept[4]._n_lines and kept[4].text == ""
    found = language.identify(df, language.train_on(df, F.lit(True))).collect()
    assert len(found) == 4 and all(0 <= r.lang_score <= 1 for r in found)
    assert quality.score(df, np.zeros(quality.SIZE + 1, np.float32)).count() == 4
    groups = {r.doc_id: r.group_id for r in fingerprint.exact_groups(df).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 1}


def test_very_long_conversation(spark):
    from dealforge.llm import chat

    text = "[INST] <x> \\ " * 100_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.format_chats(df).first()
    assert chat.parse_instruct(r.formatted) == [("user", text), ("assistant", text)]
    assert chat.unescape(r.formatted[r.loss_mask[0].start : r.loss_mask[0].end]) == text


def test_urls_on_null_repeated_and_empty(spark):
    from dealforge.llm import urls

    df = spark.createDataFrame([(1, "https://a.org/x"), (1, "https://a.org/x"), (None, None), (None, "b" * 100_000), (2, "https://z.com/de/1")], "page_id bigint, url string")
    got = urls.judge(df).collect()
    assert len(got) == 5 and {r.verdict for r in got} <= {"allow", "block"} and urls.judge(df.limit(0)).count() == 0
