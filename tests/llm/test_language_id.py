import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.language_id import Model, Predictor, fit, held_out, predict
from llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def judged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = held_out(F.col("doc_id"))
    model = fit(docs.where(~out))
    return model, predict(docs.withColumn("held_out", out), model).collect()


def test_held_out_accuracy(judged):
    model, rows = judged
    mine = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in mine} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == r["lang"] for r in mine) >= 0.97 * len(mine)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in model.languages for r in rows)


def test_unseen_words_fall_back_to_shorter_grams(judged):
    model, _ = judged
    judge = Predictor(model)
    assert "zzthtionly" not in model.tables[0]
    english, german, foreign = judge.word_scores(["zzthtionly", "ungschkeit", "漢字"])
    assert model.languages[english.argmax()] == "en" and model.languages[german.argmax()] == "de"
    assert not foreign.any()
    known = next(iter(model.tables[0]))
    assert (judge.word_scores([known])[0] == model.scores[model.tables[0][known]]).all()


def test_full_cache_changes_nothing(judged, monkeypatch):
    model, rows = judged
    monkeypatch.setattr("ledgerlens.llm.language_id.CACHE", 50)
    texts = [r["text"] for r in rows[:60]]
    one_by_one = Predictor(model)
    got = [one_by_one([t])[0] for t in texts]
    assert [g[0] for g in got] == [r["lang_pred"] for r in rows[:60]]
    assert [g[1] for g in got] == pytest.approx([r["score"] for r in rows[:60]])


def test_odd_rows(judged, odd, empty):
    model, _ = judged
    rows = predict(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS) and rows[0]["fallen"] == "f"
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by_id[3] == by_id[4] == by_id[5] == ("und", 0.0)
    assert by_id[2] == by_id[1] and by_id[7][0] in model.languages
    assert predict(empty, model).count() == 0


def test_no_letters(spark, judged):
    model, _ = judged
    texts = [("123 _ ½ ²", "und"), ("!?", "und"), ("漢", None), ("a", None)]
    rows = predict(spark.createDataFrame([(t,) for t, _ in texts], "text string"), model).collect()
    for (_, want), r in zip(texts, rows, strict=True):
        assert (r["lang_pred"] == "und") == (want == "und") and 0 <= r["score"] <= 1


def test_without_labels(spark, odd):
    model = fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert model.languages == []
    assert {(r["lang_pred"], r["score"]) for r in predict(odd, model).collect()} == {("und", 0.0)}
    assert fit(odd.where("false")).languages == []


def test_sample_is_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small, whole = fit(docs, sample=5), fit(docs)
    assert small.languages == whole.languages
    assert len(small.tables[0]) < len(whole.tables[0])
    few = fit(docs, max_words=5, max_grams=7)
    assert len(few.tables[0]) <= 20 and all(len(t) <= 28 for t in few.tables[1:])


def test_label_is_no_input(spark, sf, judged):
    model, rows = judged
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}  # to the last bit


def test_model_survives_packing(judged):
    model, _ = judged
    again = Model.unpacked(model.packed())
    assert again.languages == model.languages
    assert again.tables == model.tables and (again.scores == model.scores).all()
