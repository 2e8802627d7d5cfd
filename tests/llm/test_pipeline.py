"""The pipeline on a small table: each stage's decisions, and the whole run."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import store
from tests.llm import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        lines = [line(12) for _ in range(6)]
        if i % 5 == 1:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if i % 5 == 2:
            lines[1] += " scum idiot"
        docs.append((i, "\n".join(lines), "en", "s", 0))
        if i < 300:
            labels.append((i, int(i % 5 != 1), int(i % 5 == 2)))
    exam = line(40)
    docs += [(500, line(10) + "\n" + exam, "en", "s", 0), (501, docs[0][1], "en", "s", 0), (502, docs[3][1] + "\nplus " + line(6), "en", "s", 0), (503, None, "en", "s", None), (504, "", "en", "s", 0), (505, docs[4][1].replace("word1 ", "word2 "), "en", "s", 0)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: t for i, t, *_ in docs}


def test_stages(spark, folder):
    path, texts = folder
    docs = store.documents(spark, path)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, path), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i in range(400) if i % 5 not in (1, 2)}
    assert len(good & set(seen["quality"])) >= 0.97 * len(good)
    assert not [i for i in seen["quality"] if i < 400 and i % 5 == 2]
    assert 501 not in seen["line_dedup"]
    if 502 in seen["quality"]:
        assert seen["line_dedup"].get(502, "plus").startswith("plus")
    assert 500 not in seen["decontamination"]
    assert set(seen["decontamination"]) <= set(seen["near_duplicates"]) <= set(seen["line_dedup"]) <= set(seen["quality"])
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(seen["decontamination"])
    filled = defaultdict(int)
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_near_duplicates_keep_the_least_of_each_group(spark, folder):
    path, _ = folder
    docs = store.documents(spark, path)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()}
    assert 0 in kept and 501 not in kept and {503, 504} <= kept


def test_a_copy_with_short_lines_goes(spark, folder, tmp_path):
    path, texts = folder
    turned = "\n".join(" ".join(x.split()[::-1]) for x in texts[0].split("\n"))
    mixed = "Short head.\n" + turned + "\n\nThe end."
    docs = spark.createDataFrame([(1, mixed, "en", "s", len(mixed)), (2, mixed, "en", "s", len(mixed)), (3, texts[3], "en", "s", 0)], store.documents(spark, path).schema)
    out = corpus_pipeline.drop_lines(spark, docs, path)
    assert {r.doc_id for r in out.collect()} == {1, 3}
    copies = docs.where("doc_id < 3").selectExpr("doc_id + 600 AS doc_id", "text", "lang", "source", "n_chars")
    store.documents(spark, path).union(copies).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 601 in packed and 602 not in packed


def test_repeated_rows_null_ids_clashing_columns_and_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    base = store.documents(spark, path)
    text = base.where("doc_id = 0").first().text
    odd = spark.createDataFrame([(0, text), (0, text), (None, text), (None, text), (7, text + " more"), (900, None), (900, None), (901, ""), (902, "   ")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    docs = base.union(odd)
    for k, name in enumerate(cases.CLASH):
        docs = docs.withColumn(name, F.lit(k))
    left = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id IS NULL OR doc_id NOT IN (501, 502, 505)"), path)
    assert left.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in left.where(F.col("text") == text).collect())
    assert ids == ["0"] and left.where("doc_id = 900").count() == 2 and left.where("doc_id = 902").count() == 1
    nulls = docs.where("doc_id IS NULL")
    assert nulls.count() == 2 and corpus_pipeline.drop_near_duplicates(spark, nulls, path).count() == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("doc_id = 900").count() == 2 and out.where("doc_id IS NULL").count() == 0
    assert {r.doc_id for r in out.collect()} >= {i for i in range(400) if i % 5 in (1, 2)}
