"""The opN queries: each applies its operator to a whole table. ORACLE has SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, jaccard, katz, language, lines, packing, quality, ranking, tokens, trie, urls
from .common import crc32_fold, read

#: Names of vocabulary files; their place is asked of the package that holds them.
COUNT_MODEL, PACK_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), vocabulary(COUNT_MODEL))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(PACK_MODEL))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train_on(docs, crc32_fold(F.col("doc_id")) != 0)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc32_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fit = quality.labelled_sample(docs, read(spark, sf_dir, "labels"), crc32_fold(F.col("doc_id")) != 0)
    scored = quality.score(docs, quality.train(fit))
    return scored.select("doc_id", (crc32_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    kind = dict(chats.dtypes)["conv_id"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                read_back = chat.parse_instruct(text)
                turns = "".join(f"{r}\n{t}\n" for r, t in read_back)
                loss = "".join(chat.unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(read_back), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n_turns, turns, n, loss, size = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_turns, pa.int64()), pa.array(turns, pa.string()), pa.array(n, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    formatted = chat.format_chats(chats.unionByName(more)).select("conv_id", "formatted", "loss_mask")
    return formatted.mapInArrow(digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    collided = fingerprint.collisions(docs)

    def make(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        out = []
        for (doc, text), (_, other) in zip(rows, following):
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            own, changed, after = (fingerprint.digest(t, collided) for t in (text, edited, other))
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, float(own == changed), float(own == after)))
        types = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), types)], names=[n for n, _ in types])

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return fingerprint.with_groups(fingerprint.with_next(docs, make, schema))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(read(spark, sf_dir, "conversations"))
    return trie.prefix_trie(turns.select("conv_id").distinct(), trie.borrowed(turns))


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = katz.scores(read(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_packing, op4_language, op5_quality, op6_urls, op7_chat, op8_fingerprints, op9_line_dedup, op10_jaccard, op11_ranking, op12_trie, op13_katz)}

_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, l, array_to_string(w[s : s + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + l - 1)) AS p FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op7_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '[\\<\[]', '..', 'g')) AS nr, length(regexp_replace(text, '[\\<\[]', '..', 'g')) AS nt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(nr + nt + 20 + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ALPHABET}) AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op11_ranking": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_all FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY doc_id, n, t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // CAST(n_all AS BIGINT))))) AS BIGINT) AS score
  FROM i JOIN f USING (t) JOIN v USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50""",
    "op12_trie": r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id FROM t),
bits AS (SELECT conv_id, list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))) AS steps FROM ids),
h AS (SELECT conv_id, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM bits),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM (
  SELECT conv_id, pos, role, text FROM t JOIN h USING (conv_id) WHERE pos > h
  UNION ALL SELECT h.conv_id, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 WHERE pos <= h)),
p AS (SELECT conv_id, 0 AS depth, '' AS k, '' AS text FROM ids
  UNION ALL SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)), text FROM r),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS chars FROM p GROUP BY k, depth),
e AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY k),
up AS (SELECT n.k, n.depth, n.chars, n.n_convs, p.k AS top, p.depth AS top_depth FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
c AS (SELECT top AS k, count(*) AS n_children FROM up WHERE top_depth = depth - 1 GROUP BY top),
s AS (SELECT top AS k, count(*) FILTER (c.k IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM up LEFT JOIN c USING (k) GROUP BY top),
a AS (SELECT up.k, m.conv_id AS parent FROM up JOIN n m ON m.k = up.top WHERE top_depth = up.depth - 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.parent AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN c USING (k) LEFT JOIN a USING (k) LEFT JOIN e USING (k)""",
}
