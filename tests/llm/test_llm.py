"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import chat, decontaminate, fingerprint, jaccard, language, lines, packing, quality, queries, tokens, urls

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, lang string, n int"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr([r[c] for c in cols]) for r in df.collect()), cols


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    mine, cols = rows_of(queries.QUERIES[name](spark, SF))
    cur = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert mine == sorted(repr([r[i] for i in at]) for r in cur.fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and blank texts, repeated rows, a clashing column."""
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en", 1), (1, text, "en", 1), (2, text, None, 2), (3, None, "de", 3), (4, "", "fr", 4), (None, " \n\t ", None, 5), (None, text, "en", None), (7, "..." * 10, "en", 7)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def vocab(name):
    return queries.vocabulary(name)


def test_edges(spark, odd, none):
    items = spark.createDataFrame([("a", "two three"), ("b", None), ("c", "")], "item_id string, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert len(got) == 8 and sorted(r.n_hit for r in got) == [0, 0, 0, 0, 2, 2, 2, 2]
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.clean(odd, items).count() == 4
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0
    for f in (lambda d: tokens.token_counts(d, vocab(queries.COUNT_MODEL)), fingerprint.fingerprints, fingerprint.exact_groups, jaccard.jaccard_components, lines.line_dedup):
        assert f(odd).count() == 8 and f(none).count() == 0
    assert packing.pack(none, vocab(queries.PACK_MODEL)).count() == 0
    assert packing.pack(odd, vocab(queries.PACK_MODEL)).agg(F.sum("length"), F.count("*")).first()[1] == 8
    model = language.train_on(odd, F.lit(True))
    assert language.identify(odd, model).filter("lang_pred = 'und'").count() == 4 and language.identify(none, model).count() == 0
    assert quality.score(odd, np.zeros(quality.SIZE + 1, np.float32)).filter("score = 0.5").count() == 8


def test_jaccard_null_ids_and_copies(odd):
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(odd).filter("doc_id is not null").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 7: 7}


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        if i and rng.random() < 0.7:
            words = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = base[rng.integers(400)]
        else:
            words = list(rng.choice(base, rng.integers(1, 60)))
        rows.append((i, " ".join(words)))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(160))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(160):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(160)}


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocab(queries.COUNT_MODEL))
    extra = [" a  b ", "<s> x </s>", "▁ ▁a", "a \n b", "x" * 3000, "é ü", " ", "a\u00a0 b", "a\u3000 b", "\t a", "a ▁ b"]
    texts = [t for _, t, _ in docs[:60]] + extra
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, vocab(queries.COUNT_MODEL)).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for i, t in enumerate(texts)}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    extra = ["a <|endoftext|> b<|startoftext|>c", "don't 'tis it's.", "x…y “q” (Foo)bar-baz 12.5€ ½, é!", "", "word " * 9000]
    texts = [t for _, t, _ in docs[:80]] + extra
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(vocab(queries.PACK_MODEL))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, vocab(queries.PACK_MODEL)).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in enumerate(ids):
        assert sum(n for _, n in sorted(pieces[i])) == len(own) and sorted(pieces[i])[0][0] == 0
    for s in sequences.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) * 4096 <= 1.1 * sum(map(len, ids)) + 2 * 4096


def test_language_held_out(spark, docs):
    got = queries.op4_language(spark, SF).filter("held_out").collect()
    truth = {d: lang for d, _, lang in docs}
    known = [r for r in got if truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in known) >= 0.9 * len(known)
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_held_out(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    got = [r for r in queries.op5_quality(spark, SF).filter("held_out").collect() if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.75 * len(got)


def test_url_rules(spark):
    found = ["https://A.Example.org/es/x", "http://example.org/en/12?q", "http://x.com/fr/1", "https://notorg/a", "nothing", None, "http://com#a", "http://b.org?x/y"]
    df = spark.createDataFrame(list(enumerate(found)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(df).collect()}
    assert got == {0: ("a.example.org", "/es/x", "example.org/es/"), 1: ("example.org", "/en/12", "example.org/en/1"), 2: ("x.com", "/fr/1", "com/fr/"), 3: ("notorg", "/a", None), 4: ("", "", None), 5: ("", "", None), 6: ("com", "", None), 7: ("b.org", "", None)}


def test_chat_round_trip_and_rewriting(spark):
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\<[x]\\\\ </s>"), ("assistant", ""), ("", "[ROLE]")]
    r = chat.render(turns, chat.instruct_template)
    assert chat.parse_instruct(r.text) == turns and r.rewrites == 0
    assert [chat.unescape(r.text[a:b]) for a, b in r.contents] == [t for _, t in turns]
    assert chat.render(turns, lambda ts: f"{len(ts)}" + "".join(t for _, t in ts)).rewrites > 0
    df = spark.createDataFrame([(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (None, None, None, "z", 9)], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r.conv_id: (r.n_turns, len(r.loss_mask)) for r in chat.format_chats(df).collect()}
    assert got == {1: (2, 1), None: (1, 0)} and chat.format_chats(df.limit(0)).count() == 0


def test_fingerprints_against_brute_force(spark, docs):
    ordered = sorted(docs, reverse=True)
    want = {}
    for (d, t, _), (_, other, _) in zip(ordered, ordered[1:] + ordered[:1]):
        t, other = t or "", other or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(t), fingerprint.digest(edited))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in queries.op8_fingerprints(spark, SF).collect()}
    assert got == want
    assert fingerprint.digest("Straße  ﬁ\n") == fingerprint.digest("STRASSE FI")


def test_decontamination_without_broadcast(spark, monkeypatch):
    whole, cols = rows_of(queries.op1_decontaminate(spark, SF))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    assert rows_of(queries.op1_decontaminate(spark, SF)) == (whole, cols)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as P
    from dealforge.llm.common import read

    docs = read(spark, SF, "documents")
    kept = P.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.9 * docs.filter(F.col("text").rlike("[A-Za-z]")).count()
    slim = P.line_stage(spark, kept, SF)
    keys = defaultdict(set)
    for r in slim.collect():
        for line in (r.text or "").split("\n"):
            key = re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10:
                keys[key].add(r.doc_id)
    assert all(len(ids) == 1 for ids in keys.values())
    got = P.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
