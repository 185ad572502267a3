"""Language identification and the quality classifier: held-out accuracy and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, quality_cnn, queries
from millrace.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_language_accuracy(spark):
    out = queries.op1_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = out.join(truth, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score", "rejected").agg(F.avg("ok"), F.avg("score"), F.count("*"), F.avg(F.when(F.col("ok") == 1, F.col("rejected").cast("int")))).first()
    assert got[2] > 2000 and got[0] > 0.97
    assert abs(got[0] - got[1]) < 0.05  # calibrated
    assert got[3] <= 0.01  # right answers that are rejected


def test_junk_and_other_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(~held_out())
    model = langid.fit(docs)
    assert 2e-4 < model.temperature < 50 and model.rejects["shuffled"] > 0.99 and model.rejects["held_back"] > 0.9
    rng = np.random.default_rng(3)
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(100)) for _ in range(100)]
    unseen = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita",
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему",
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
        "Det var så dejligt ude på landet; det var sommer, kornet stod gult, havren grøn",
    ]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(junk + unseen)], "doc_id long, text string")
    got = langid.predict(frame, model).collect()
    assert all(r.rejected and r.lang_pred in model.languages for r in got)
    left_out = langid.fit(docs.where("lang != 'fr'"))
    french = langid.predict(docs.where("lang = 'fr'"), left_out).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert french > 0.95


def test_long_texts_are_judged_as_whole_ones(monkeypatch):
    model = langid.train([("the and of with that was", "en"), ("der die das und nicht mit", "de")] * 20)
    text = ("the quick brown fox " * 500).encode()
    whole = model.means([text])
    monkeypatch.setattr(langid, "PASS_BYTES", 1000)
    assert all(np.allclose(a, b) for a, b in zip(whole, model.means([text]), strict=True))


def test_quality_accuracy(spark):
    out = queries.op4_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = out.join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert len(got) > 500 and np.mean((p >= 0.7) == y) > 0.96
    assert np.mean(p[y == 1] >= 0.7) > 0.98


ROWS = [(1, None, "xx", "a"), (2, "", "xx", "a"), (3, "123 !? 🙂", "xx", "a"), (4, "the and of with", None, "a"), (4, "the and of with", None, "a"), (None, "der die das und", "de", None), (5, "é", "fr", "b"), (6, "the of " * 60_000, "en", "b")]
SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = langid.train([("the and of with that was", "en"), ("der die das und nicht mit", "de"), ("le la les des et une é", "fr")] * 20)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, None, 5, 6)] == ["und", "und", "und", "en", "de", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == 0 and got[1].rejected
    assert langid.predict(df, model).count() == len(ROWS)
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.fit(df.limit(0)) is None
    assert langid.fit(df).languages == ["de", "en", "fr", "xx"]


def test_training_repeats_itself():
    rows = [("the and of with", "en"), ("der die das und", "de")] * 15
    a, b = langid.train(rows), langid.train(rows)
    assert np.array_equal(a.scores, b.scores) and a.temperature == b.temperature
    texts = [("fine words in a row", 1), ("### %%% $$$", 0)] * 15
    assert np.array_equal(*[quality_cnn.score(quality_cnn.train(texts, 0.5, epochs=2), [b"fine", b""]) for _ in range(2)])


def test_classifier_rows(spark):
    net = quality_cnn.train([("fine words in a row", 1), ("### %%% $$$ &&&", 0)] * 30, 0.5, epochs=20)
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "fine words in a row", 0), (3, "fine words in a row", 0), (None, "### %%% $$$ &&&", 0), (4, "fine words " * 30_000, 0)], "doc_id long, text string, predicted int")
    got = quality_cnn.classify(df, net)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 6 and rows[3].predicted == 1 and rows[None].predicted == 0
    assert rows[1].score == rows[2].score and all(0 <= r.score <= 1 for r in rows.values())
    assert quality_cnn.keep(df, net).columns == df.columns and None not in {r.doc_id for r in quality_cnn.keep(df, net).collect()}
    assert quality_cnn.classify(df.limit(0), net).count() == 0
    assert {r.score for r in quality_cnn.classify(df, None).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    assert quality_cnn.fit(df, labels) is None and quality_cnn.fit(df, labels.limit(0)) is None


def test_a_late_chunk_counts():
    """Poor bytes far behind a text's begin change its score."""
    net = quality_cnn.train([("fine words in a row " * 30, 1), ("### %%% $$$ &&& " * 30, 0), ("fine words in a row " * 20 + "### %%% $$$ &&& " * 20, 0)] * 12, 0.5, epochs=12)
    good = b"fine words in a row " * 2000
    a, b = quality_cnn.score(net, [good, good[: len(good) // 2] + b"### %%% $$$ &&& " * 1500])
    assert a > b


@pytest.mark.parametrize("text", ["Straße über Öl", "ÀÉÎ", "日本"])
def test_subwords_count_each_text_by_itself(text):
    model = langid.train([("the and of", "en"), ("der die das ß", "de")] * 12)
    one = model.probabilities([text.encode()])
    many = model.probabilities([b"the the", text.encode(), b"xyz"])
    assert np.allclose(one[0], many[1])


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h"))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
