import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import langid

SF = "/root/testdata/sf0.01"


def test_presence_equals_sets_of_ngrams():
    texts = ["Hello world ½", "été à la plage 12", "hello wörld! 漢字 ①"]
    s = langid.Spectrum.of(texts[:2])
    rows, sizes = s.common(texts)

    def grams(t):
        x = "".join(c if langid.LETTER.match(c) else " " for c in t.lower())
        return {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    assert [len(grams(t)) for t in texts] == sizes.astype(int).tolist()
    for i in range(3):
        for j in range(2):
            assert rows[i, j] == len(grams(texts[i]) & grams(texts[j]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    out = langid.predict(docs, model).where(langid.held_out())
    n, good = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and good / n > 0.97
    # lang, source and doc_id play no part in a prediction
    blind = langid.predict(docs.select(F.lit(1).alias("doc_id"), "text", F.lit("xx").alias("lang"), "n_chars"), model)
    a = {r.text: (r.lang_pred, r.score) for r in out.collect()}
    assert all(a[r.text][0] == r.lang_pred and abs(a[r.text][1] - r.score) < 1e-6 for r in blind.collect() if r.text in a)


def test_held_out_labels_are_never_learned(spark):
    docs = spark.createDataFrame([(i, "abc def" if i % 2 else "xyz uvw", "a" if i % 2 else "x") for i in range(300)], "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), "wrong").otherwise(F.col("lang")))
    model = langid.fit(wrong)
    assert model.languages == ["a", "x"]
    got = {r.text: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {"abc def": "a", "xyz uvw": "x"}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat", "en"), (None, "x", "en")], "doc_id long, text string, lang_pred string")
    rows = [(i, t, lang) for i in range(60) for t, lang in (("the cat sat", "en"), ("le chat est", "fr"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [out[i].lang_pred_ for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred_ == "en" and 0 <= out[4].score <= 1
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


@pytest.mark.parametrize("text", ["a" * 200_000, "éè" * 3])
def test_long_texts_are_read_whole(text):
    s = langid.Spectrum.of([text, "abc"])
    rows, sizes = s.common([text + " abc"])
    assert rows[0, 1] >= 6 and sizes[0] > 0


def test_many_languages_share_the_landmarks(spark):
    rows = [(20 * i + k, "".join(chr(0x4E00 + 40 * k + (i * 7 + j * j) % 40) for j in range(30)), f"l{k:02}") for i in range(30) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most=60)
    assert model.spectrum.landmarks == 60 and model.weights.shape == (60, 20)
    said = langid.predict(docs, model)
    assert said.where("lang = lang_pred").count() > 0.95 * len(rows)
    assert langid.fit(docs, most=5).spectrum.landmarks == 20


def test_letters_are_category_l_and_all_are_told_apart(spark):
    rows = [(i, t, lang) for i in range(90) for t, lang in (("".join(chr(0x4E00 + (i * 31 + k * 7) % 900) for k in range(60)), "zh"), ("".join(chr(0xAC00 + (i * 17 + k * 5) % 900) for k in range(60)), "ko"), ("the cat sat on a mat", "en"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = [(1, "² ½ ① Ⅷ 42"), (2, "".join(chr(0x4E00 + k * 11 % 900) for k in range(80))), (3, "".join(chr(0xAC00 + k * 13 % 900) for k in range(80))), (3, "a cat"), (3, "a cat")]
    got = langid.predict(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score > 0.34) for r in got if r.doc_id < 3] == [("und", False), ("zh", True)] and got[0].score == 0
    assert sorted(r.lang_pred for r in got if r.doc_id == 3) == ["en", "en", "ko"]


def test_fitted_weights_equal_dense_kernel_ridge(spark):
    """With all texts as landmarks, Nystroem ridge is kernel ridge: (K + n * ridge)^-1 y, computed here without blocks or features."""
    rng = np.random.default_rng(2)
    words = {"a": "the and of with that", "b": "der die und mit das", "c": "le et que dans les"}
    rows = []
    for i in range(60):
        lang = "abc"[i % 3]
        rows.append((i, f"{' '.join(rng.choice(words[lang].split(), 6))} {''.join(rng.choice(list('abcdefghijklm'), 9))}", lang))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10**6, landmarks=10**6)

    def grams(t):
        x = "".join(c if langid.LETTER.match(c) else " " for c in t.lower())
        return {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    sets = [grams(t) for _, t, _ in learned]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == c else -1.0 for c in "abc"] for _, _, lang in learned])
    dual = np.linalg.solve(k + langid.RIDGE * len(sets) * np.eye(len(sets)), y)
    probe = ["the und que", "mit der katze", "xyz", "les chats et le chien"]
    want = np.array([[kernel(grams(t), b) for b in sets] for t in probe]) @ dual
    assert np.allclose(model.features(probe), want, atol=2e-3)
