"""Benchmark decontamination by a prefix-filtered containment join. DataFrame functions only.

An item's windows are its runs of `size` words. A document holds a window only if it holds all
of the window's shingles, so the rarest one is a sufficient prefix (containment 1 needs a prefix
of one). Rarity is the count over all documents. Document words meet the prefixes by an equi
join; the place of the prefix in its window fixes where the window must lie, which must be
inside the document (length and positional bounds); then the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, fresh, quoted

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_WINDOWS = 200_000  # about 30 MB; with more, prefixes are joined by a shuffle


def words_of(text: Column) -> Column:
    """Words with an empty string before or after them where the text begins or ends with a separator."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, w): the distinct windows of each item."""
    words = F.filter(words_of(F.col(text_col)), lambda w: w != "")
    rows = items.select(F.col(item_col).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("w")).distinct()


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Occurrences, with one row more (win null) for each document, and the items of each window.

    Occurrences: (id, th, n_words, start, len, win); th is a hash of the text, so that rows that
    share an id stay apart.
    """
    windows = checkpointed(windows_of(items, item_col, text_col, size))
    distinct = windows.select("w").distinct()
    small = windows.count() <= MAX_BROADCAST_WINDOWS
    mark = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    items_of = mark(windows.select(F.xxhash64("w").alias("win"), "item"))

    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("words"))
    n_words = (F.size("words") - (F.element_at("words", 1) == "").cast("int") - ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")).cast("bigint")

    # Rarity of the items' words over all documents.
    vocabulary = distinct.select(F.explode("w").alias("word")).distinct()
    seen = words.select(F.explode("words").alias("word")).join(mark(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = vocabulary.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    parts = distinct.select("w", F.posexplode("w").alias("at", "word")).join(mark(ranked), "word")
    prefix = parts.groupBy("w").agg(F.min(F.struct("n", "word", "at")).alias("p"))
    prefix = checkpointed(prefix.filter("p.n > 0").select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "w", F.xxhash64("w").alias("win")))

    # Each document has one empty word more, at its end, and that matches the row without a window.
    none = prefix.sparkSession.range(1).select(F.lit("\n").alias("word"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("w"), F.lit(None).cast("bigint").alias("win"))
    table = prefix.unionByName(none)
    if small:
        tokens = words.select("id", "th", n_words.alias("n_words"), "words", F.posexplode(F.concat("words", F.array(F.lit("\n")))).alias("pos", "word"))
        met = tokens.join(F.broadcast(table), "word").withColumn("start", F.col("pos") - F.col("at"))
        fits = (F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.size("words"))
        met = met.filter(F.col("win").isNull() | (fits & (F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("w")) == F.col("w"))))
        return met.select("id", "th", "n_words", "start", F.size("w").alias("len"), "win"), items_of
    tokens = words.select("id", "th", F.size("words").alias("size"), F.posexplode("words").alias("pos", "word"))
    met = tokens.join(prefix, "word").withColumn("start", F.col("pos") - F.col("at")).filter((F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.col("size")))
    met = met.select("id", "th", "start", "w", "win").distinct()
    found = words.alias("d").join(met.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.th") == F.col("m.th")))
    found = found.filter(F.slice("words", F.col("start") + 1, F.size("w")) == F.col("w")).select("d.id", "d.th", n_words.alias("n_words"), "start", F.size("w").alias("len"), "win").distinct()
    every = words.select("id", "th", n_words.alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("win"))
    return found.unionByName(every), items_of


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, one row for each row of docs.

    A null or wordless text has no words and no hits. Rows with null or repeated ids stay, each
    judged by its own text; items without words have no windows, items with equal windows all
    count, and a null item id is left out of item_ids. Other columns are left out; empty tables
    give no rows or no hits.
    """
    met, items_of = hits(docs, items, size, id_col, text_col, item_col)
    met = checkpointed(met.groupBy("id", "th", "n_words", "start", "len", "win").agg(F.count("*").alias("times")))
    per_doc = met.filter("win is null").select("id", "th", "n_words", "times")
    found = met.filter("win is not null")
    # Words under the union of the spans: what each adds beyond the furthest end before it.
    spans = found.groupBy("id", "th", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("end", F.col("start") + F.col("len"))
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.groupBy("id", "th").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit"))
    named = found.select("id", "th", "win").distinct().join(items_of, "win").select("id", "th", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("id", "th").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    both = covered.join(named, (covered.id.eqNullSafe(named.id)) & (covered.th == named.th), "left").select(covered.id.alias("i"), covered.th.alias("t"), "n_hit", "item_ids")
    out = per_doc.join(both, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs, with all their columns, without the rows in which some window occurs."""
    met, _ = hits(docs, items, size, id_col, text_col, item_col)
    key, bad_id, bad_key = fresh(docs, "_key", "_id", "_th")
    bad = met.filter("win is not null").select("id", "th").distinct().toDF(bad_id, bad_key)
    rows = docs.withColumn(key, F.xxhash64(text_col))
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").select(*map(quoted, docs.columns))
