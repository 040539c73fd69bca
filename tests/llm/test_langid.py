import zlib

import numpy as np
import pytest

from foliary.llm import langid_nb as L

EN, ES = "the other thing with that", "que señor año qué más"


def brute(model, text):
    total = model.log_prior.copy()
    points = [ord(c) for c in text.lower()]
    for order in L.ORDERS:
        for i in range(len(points) - order + 1):
            b = L.buckets_of(np.array(points[i : i + order], np.uint32), order)[0]
            total += model.log_prob[b].astype(float)
    return total


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN, "en"), (EN, "en"), (ES, "es"), (None, "es"), ("x", None)]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_scores_equal_brute_force(model, monkeypatch):
    assert model.languages == ["en", "es"]
    texts = ["", "a", EN + " y", "ñ", ES * 40, "İstanbul 😀"]
    want = np.array([brute(model, t) for t in texts])
    assert np.allclose(L.score_texts(model, texts), want, atol=1e-3)
    monkeypatch.setattr(L, "SLICE", 16)
    assert np.allclose(L.score_texts(model, texts), want, atol=1e-3)


def test_predictions(spark, model):
    rows = [(1, EN, "es"), (2, ES, "en"), (3, None, "x"), (4, "123 --", "x"), (5, "", "x"), (None, EN, "x"), (1, EN, "y"), (6, ES * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").select("*", "lang_pred", "text")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs.select("doc_id", docs["text"]), model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "es", 3: "und", 4: "und", 5: "und", None: "en", 6: "es"}
    assert all(0 <= v[1] <= 1 for v in got.values()) and got[3][1] == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    found = L.identify(docs, L.fit_on_training_rows(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
    assert L.identify(docs.limit(0), L.fit_on_training_rows(docs.limit(0))).count() == 0


def test_held_out_rows_teach_nothing_and_are_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from foliary.llm.queries import op3_language_id

    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = op3_language_id(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
