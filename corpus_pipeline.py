"""A corpus from documents to packed sequences, in five stages that each call one operator.

Without ratings (an empty ``labels``) no document is rejected; without items (an empty ``benchmark``) none is contaminated; an empty
``documents`` gives no rows. Null and blank texts are kept up to packing, where they are pieces of one id; a text whose lines all
repeat goes. Rows that repeat are one document once the near duplicates are dropped. Extra columns of any name go through all stages but
the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontam, jaccard, lines, packing, quality, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Word shingles and least similarity (in hundredths) of near duplicates.
SHINGLE, PERCENT = 5, 80


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones among them, does not reject."""
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.fit(docs, ratings))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those of which nothing is left go. n_chars follows the text."""
    cut = lines.dedup(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("cut").rlike(r"\S"))
    changed = {"text": F.col("cut"), "n_chars": F.when(F.col("n_removed") > 0, F.length("cut")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return left.select(*((changed[f.name] if f.name in changed else F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, the one with the least doc_id (nulls last), then the least hash of its text.

    Rows with equal doc_id and text are one document, of which one row stays. Wordless documents are in no group and all stay.
    """
    classes = store.written(jaccard.classes(docs, SHINGLE, PERCENT).where("root IS NOT NULL").select("doc_id", "text_key", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = classes.groupBy("root").agg(F.min(order).alias("kept"))
    gone = classes.join(kept, "root").where(order != F.col("kept")).select("doc_id", "text_key").distinct()
    left = store.without(docs, gone)
    repeated = classes.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return left
    rows = store.packed(left).alias("d").join(repeated.alias("r"), F.expr("d.doc_id <=> r.doc_id AND d.text_key = r.text_key"), "left").select("d.doc_id", "d.text_key", "d.row", "r.n")
    once = rows.where("n IS NOT NULL").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return rows.where("n IS NULL").select("row.*").union(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return store.without(docs, found.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", select_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: fitted weights, edit distance, components and tokens are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each on all that the one before kept. What a stage wrote for itself is deleted after it."""
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with store.scope(spark) as keep:
            docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
