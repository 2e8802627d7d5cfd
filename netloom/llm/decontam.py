"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

A window is WIDTH words of a benchmark item in a row. A document holds the window only if it holds each of its words, so
it is enough to look for one: the prefix of a containment of 1 is the window's rarest word by its count in the
documents. The join on prefix words yields places; the word's place in the window and both lengths bound where the
window could start; and the words there are compared one by one. Only the places of rare words are ever rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import store

WIDTH = 13
#: Benchmark windows that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words, after A-Z are lower-cased.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased; other letters stay."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, _UPPER, _LOWER)).otherwise(text)


def words(text: Column) -> Column:
    """The words of a text, letters as they are; null and wordless texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: window_id, words (array), items (sorted strings). An item of fewer words is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(lowered(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("window_id", F.xxhash64("words"))


def prefixes(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest word and its first place in them (from 0); ties go to the first in order."""
    each = found.select("window_id", "words", F.posexplode("words").alias("shift", "word"))
    rarest = each.join(counts, "word", "left").groupBy("window_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "shift")).alias("p"))
    return rarest.select("window_id", F.col("words").alias("window"), F.size("words").alias("width"), F.col("p.word").alias("word"), F.col("p.shift").alias("shift"), F.col("p.n").alias("n"))


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words, start, end, window_id) for each place of a window, and the windows."""
    found = store.written(windows(benchmark, width), "windows")
    small = found.count() <= BROADCAST_WINDOWS
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(lowered(F.col("text"))).alias("w"))
    placed = keyed.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "word"))
    vocabulary = found.select(F.explode("words").alias("word")).distinct()
    counts = keyed.select(F.explode("w").alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    heads = store.written(prefixes(found, counts).where("n > 0"), "prefixes")
    start = F.col("at") - F.col("shift")
    inside = (start >= 0) & (start + F.col("width") <= F.col("n_words"))
    if small:
        met = placed.join(F.broadcast(heads), "word").where(inside).where(F.slice("w", start + 1, F.col("width")) == F.col("window"))
        return met.select("doc_id", "text_key", "n_words", start.alias("start"), (start + F.col("width")).alias("end"), "window_id"), found
    likely = placed.drop("w").join(heads.select("word", "shift", "width", "window_id"), "word").where(inside)
    by_doc = likely.groupBy("doc_id", "text_key", "n_words").agg(F.collect_list(F.struct(start.alias("start"), "width", "window_id")).alias("c"))
    again = keyed.join(by_doc.withColumnsRenamed({"doc_id": "d2", "text_key": "k2"}), F.expr("doc_id <=> d2 AND text_key = k2")).select("doc_id", "text_key", "n_words", F.explode(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["width"].alias("width"), c["window_id"].alias("window_id"), F.slice("w", c["start"] + 1, c["width"]).alias("there")))).alias("c"))
    met = again.select("doc_id", "text_key", "n_words", "c.*").join(heads.select("window_id", "window"), "window_id").where("there = window")
    return met.select("doc_id", "text_key", "n_words", "start", (F.col("start") + F.col("width")).alias("end"), "window_id"), found


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, n_hit, items (sorted array) for each document that holds a window."""
    met, found = occurrences(docs, benchmark, width)
    met = store.written(met, "occurrences")
    items = met.join(found.select("window_id", F.explode("items").alias("item")), "window_id").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", none, lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n")), lambda a: a["n"])
    counted = spans.select("doc_id", "text_key", covered.cast("long").alias("n_hit"))
    return counted.join(items.withColumnsRenamed({"doc_id": "i", "text_key": "k"}), F.expr("doc_id <=> i AND text_key = k")).select("doc_id", "text_key", "n_hit", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated for each row of ``docs``.

    A document word is hit when an occurrence of a window covers it, and a document is contaminated when it has a hit and at
    least a twentieth of its words are hit. Null and empty texts have no words and no hits; so have all documents when the
    benchmark is empty. Rows that repeat are judged alike; other columns are ignored.
    """
    found = hits(docs, benchmark, width).withColumnsRenamed({"doc_id": "h", "text_key": "k"})
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(found, F.expr("doc_id <=> h AND text_key = k"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, list_slice(w, s, s + 12) AS x FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)
), ux AS (SELECT DISTINCT x, len(x) AS k FROM win),
ks AS (SELECT DISTINCT k FROM ux),
dw AS (
  SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)
), occ AS (SELECT doc_id, dw.k, s, x FROM dw JOIN ux USING (x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ JOIN win USING (x)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
