import math
import random

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import language, quality, scan
from tests.llm import cases


def made(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def plain_bits(text, train, order):
    """Code length by the definition: longest context first, an escape for each that lacks the byte."""
    counts = [{} for _ in range(order + 1)]
    for t in train:
        b = t.encode().lower()
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                counts[k].setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[k][b[i - k : i]][b[i]] += 1
    bits = 0.0
    b = text.encode().lower()
    for i in range(len(b)):
        for k in range(min(order, i), -2, -1):
            if k == -1:
                bits += 8
                break
            seen = counts[k].get(b[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def trees(spark, rows):
    return language.fit(spark.createDataFrame(rows, "lang string, text string"))


def test_code_lengths_are_exact(spark):
    rnd = random.Random(4)
    rows = [("aa", made(rnd, "abcdef", 12)) for _ in range(5)] + [("bb", made(rnd, "defghé", 12)) for _ in range(5)]
    fitted = trees(spark, rows)
    probe = ["abc def", "", "d", "zz~", "défg hhh", rows[0][1], "aé"]
    data, offsets = scan.text_bytes(pa.array(probe))
    got = fitted.code_lengths(scan.LOWER[data], offsets)
    for j, name in enumerate(fitted.languages):
        train = [t for x, t in rows if x == name]
        assert np.allclose(got[:, j], [plain_bits(t, train, language.ORDER) for t in probe], rtol=1e-4, atol=1e-3)


def test_languages_are_told_apart_and_the_rest_is_und(spark):
    rnd = random.Random(6)
    rows = [("aa", made(rnd, "abcdefg", 60)) for _ in range(30)] + [("bb", made(rnd, "efghijk", 60)) for _ in range(30)] + [(None, "zzz"), ("cc", None), ("und", "qq")]
    fitted = trees(spark, rows)
    assert fitted.languages == ("aa", "bb")
    data = [(1, made(rnd, "abcdefg", 30)), (2, made(rnd, "efghijk", 30)), (3, None), (4, ""), (5, "12 !?"), (6, "é"), (7, "²")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(cases.frame(spark, data), fitted).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["aa", "bb", "und", "und", "und", got[6][0], "und"] and got[6][0] in ("aa", "bb")
    assert got[1][1] > 0.9 and got[3][1] == 0.0
    assert language.fit(spark.createDataFrame([], "lang string, text string")) is None
    assert language.predict(cases.frame(spark, data), None).count() == 7


def test_held_out_accuracy(spark):
    rows = language.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    right = rows.selectExpr("avg(CAST(lang = lang_pred AS DOUBLE)) AS r").first().r
    assert right > 0.97


def test_grades_are_learned_in_order(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    docs, ratings = [], []
    for i in range(600):
        grade = i % 3
        text = [rnd.choice(words) for _ in range(60)]
        if grade == 0:
            text[3], text[20] = "scum", "idiot"
        elif grade == 1:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        if i < 450:
            ratings.append((i, int(grade > 1), int(grade == 0)))
    df = cases.frame(spark, docs + cases.rows()[-14:])
    labels = spark.createDataFrame(ratings + [(None, 1, 0), (3, 1, 0), (9999, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, quality.graded(labels))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in quality.score(df, model).where("doc_id >= 450 AND doc_id < 600").collect()}
    for i, r in got.items():
        assert r.keep == (i % 3 == 2)
        assert 0 <= r.p_at_least_2 <= r.p_at_least_1 <= 1 and abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-9
    kept = quality.select(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(450, 600) if i % 3 == 2}
    assert quality.fit(df, quality.graded(labels.limit(0))) is None
    assert quality.score(df, None).count() == df.count()
    assert quality.score(df.limit(0), model).count() == 0


def test_the_fit_is_as_good_as_a_plain_one_and_scores_follow_the_definition(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(240):
        words = [rnd.choice("abcdefghij") * 3 for _ in range(8)]
        if rnd.random() < 0.8:
            words += [("bad", "dull", "fine")[i % 3]] * rnd.randrange(1, 3)
        docs.append(" ".join(words))
    grades = np.array([i % 3 for i in range(240)])
    found, offsets = quality.features(*scan.text_bytes(pa.array(docs)))
    model = quality.train(found, offsets, grades, least=4, rounds=6000)
    used = np.flatnonzero(model.weights)
    x = np.array([[f in set(found[a:b].tolist()) for f in used] for a, b in zip(offsets[:-1], offsets[1:])], float)

    def loss(w, t):
        p = 1 / (1 + np.exp(-(np.array([-np.inf, t[0], t[1], np.inf])[None, :] - (x @ w)[:, None])))
        return float(np.mean([-math.log(p[i, g + 1] - p[i, g]) for i, g in enumerate(grades)])) + quality.RIDGE / 20 * float(w @ w)

    w, t = np.zeros(len(used)), np.array([-0.5, 0.5])
    for _ in range(3000):  # by differences, without the formulas of the fit
        base = loss(w, t)
        slope_w = np.array([(loss(w + 1e-5 * (np.arange(len(w)) == j), t) - base) / 1e-5 for j in range(len(w))]) if len(w) < 12 else None
        assert slope_w is not None
        slope_t = np.array([(loss(w, t + 1e-5 * (np.arange(2) == j)) - base) / 1e-5 for j in range(2)])
        w, t = w - 1.0 * slope_w, t - 1.0 * slope_t
        if max(np.abs(slope_w).max(initial=0), np.abs(slope_t).max()) < 1e-3:
            break
    assert {3 <= len(used)} == {True} and loss(model.weights[used], model.thresholds) <= loss(w, t) + 0.02
    shown = quality.score(cases.frame(spark, list(enumerate(docs))), model).collect()
    for r in shown:
        z = sum(model.weights[f] for f in found[offsets[r.doc_id] : offsets[r.doc_id + 1]])
        tails = [1 / (1 + math.exp(-(z - cut))) for cut in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(tails)) and (r.p_at_least_1, r.p_at_least_2) == pytest.approx(tuple(tails))
        assert r.keep == (tails[0] >= 0.5 and tails[1] >= quality.KEEP)


def test_repeated_rows_of_a_rated_document_teach_once(spark):
    rows = [(i, ("good text " if i % 2 else "scum idiot ") + f"word{i}") for i in range(60)]
    labels = quality.graded(spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int"))
    one = quality.fit(cases.frame(spark, rows), labels)
    many = quality.fit(cases.frame(spark, rows + [rows[1], rows[2]] * 30), labels)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.thresholds, many.thresholds)


def test_copies_of_a_text_teach_a_language_once(spark):
    rnd = random.Random(5)
    rows = [("aa", made(rnd, "abcdef", 12)) for _ in range(20)] + [("bb", made(rnd, "defgh", 12)) for _ in range(20)]
    one, many = trees(spark, rows), trees(spark, rows + [rows[0]] * 300)
    probe = scan.text_bytes(pa.array(["abc def hgf", rows[3][1]]))
    assert np.allclose(one.code_lengths(*probe), many.code_lengths(*probe))
